"""Line dedup: an exact set-similarity join of lines, after which later matches go.

A line is the set of its words, lower-cased and without punctuation at their
ends. Words are counted over all documents (into a table of fixed size), and
each line's words are put in order of rarity. Two lines of Jaccard similarity
``SIMILARITY`` or more share a word among the first ``n - ceil(t * n) + 1`` of
each, so lines meet under those words alone. Pairs are discarded by length, by
the overlap still possible after the shared word's positions, and by a parity
signature whose differing bits are no more than the words that differ. Of a
later line the candidate that differs least is verified, on the words of the
two texts themselves; lines whose candidate fails come again with all others. A
line goes when an earlier line, by doc_id and line number, matches it, whether
that line stays or not. Lines of equal words (by a 128-bit digest) need no
candidates: all but the first place of a set go.

Scale: a row for each word of a prefix is shuffled in packed blocks, by hash of
the word, and each task gets a bounded number of rows. Words in the prefixes of
more than ``CELL`` lines, counted exactly, are divided into cells whose pairs
are separate groups, so that no task holds a whole hot word. A first round sends
on one candidate a line and shared word at most. Places and texts are gathered
for the lines in question alone, which a bitmap of bounded size picks.

Defined results: null and empty texts have no lines to remove; lines without
words stay; lines of one to three different words match equal sets alone; rows
that share a doc_id are told apart by a digest of their text, which orders them
(rows equal in both lose the same lines, and none to each other); null ids come
first; ids of any type that Spark orders; equal lines of one document match too,
the first stays; an empty table gives an empty result; extra columns of any name
pass through :func:`remove_lines`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, stored, text_key, unpacked, whole_row

SIMILARITY = (4, 5)  # 0.8 as a fraction, so that bounds are exact
#: Smaller lines match equal ones alone and have no prefix rows; a line of four words may match one of five.
NEAR_WORDS = 4
PUNCTUATION = ".,;:!?\"'()[]"
#: Counters of words, in slots that tasks send on whole, and the most bits of a table of line ids.
COUNTERS = 1 << 20
SLOT = 1 << 12
MOST_BITS = 1 << 27
#: Lines that share a word without being divided; with so many prefix rows that over MOST_HOT words could have more, in proportion.
CELL = 1 << 15
MOST_HOT = 1 << 22
#: Rows dealt to a block of words and to a task.
BLOCK_ROWS = 100_000
TASK_ROWS = 400_000
#: Bounds of a task's memory: bytes of text, prefix rows held before they are dealt, pairs of rows looked at together.
BLOCK_BYTES = 4_000_000
ROWS_AT_ONCE = 1 << 18
PAIRS_AT_ONCE = 1 << 17
FEW_PAIRS = 1 << 14
EMIT = 20_000

#: Sets of words in more lines than this are met by broadcast, of which there are at most MOST_HOT_SETS.
HOT_SET = 4_096
MOST_HOT_SETS = 1 << 16

#: A prefix row. shape: the position in the line, and in the lowest bit whether the row is of the second of two cells.
ROW = np.dtype([("word", "<u4"), ("pair", "<u4"), ("n", "<u4"), ("shape", "<u4"), ("id", "<i8"), ("doc", "<i8"), ("s0", "<u8"), ("s1", "<u8")])


def mix(h: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mixing function, for sums that name sets."""
    x = h.astype(np.uint64) + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(values: np.ndarray, counts: np.ndarray, how=np.add) -> np.ndarray:
    """how over each run of a column; runs of no values give 0."""
    out = np.zeros(len(counts), values.dtype)
    some = counts > 0
    if some.any():
        out[some] = how.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... in each run."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def word_hashes(names: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: a polynomial of its bytes, mixed."""
    names = names.cast(pa.large_string())
    if not len(names):
        return np.zeros(0, np.uint64)
    at = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
    data = np.frombuffer(names.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].astype(np.uint64)
    size = np.diff(at)
    powers = np.cumprod(np.full(max(1, int(size.max())), 0x9E3779B97F4A7C15, np.uint64))
    return mix(runs((data + np.uint64(1)) * powers[within(size)], size), 1)


def word_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: lines by text; line and word number of each distinct word of a line; hash of each word number."""
    lines = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    counts = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    parts = pc.ascii_split_whitespace(lines.flatten())
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    plain = plain_words(coded.dictionary).dictionary_encode()
    number = plain.indices.to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
    pairs = np.sort(np.repeat(np.arange(len(sizes)), sizes) << 32 | number)
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
    if (none := pc.index(plain.dictionary, "").as_py()) >= 0:
        pairs = pairs[pairs & 0xFFFFFFFF != none]
    return counts, pairs >> 32, pairs & 0xFFFFFFFF, word_hashes(plain.dictionary)


def set_ids(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 128-bit name of each line's set of words, as two columns."""
    return np.stack([runs(mix(hashes, 0x9E3779B97F4A7C15), n), runs(mix(hashes, 0xC2B2AE3D27D4EB4F), n)], axis=1).view(np.int64)


def blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with texts of bounded size, or one text."""
    for batch in batches:
        if batch.num_rows:
            bytes_ = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            block = np.cumsum(bytes_, dtype=np.int64) // BLOCK_BYTES
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                yield batch.slice(a, b - a)


def parted(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The bytes of each run of a column."""
    at = np.concatenate([[0], np.cumsum(counts)]).tolist()
    return pa.array([values[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())


def joined(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The inverse: all values, and how many each row has."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind), np.fromiter((len(v) for v in values), np.int64, len(values)) // np.dtype(kind).itemsize


def counted(df: DataFrame, numbers) -> np.ndarray:
    """COUNTERS counts summed over all rows; numbers gives the counters that a batch touches, and how often (null: once each)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for at, often in numbers(batch):
                at = at & np.uint32(COUNTERS - 1)
                total += np.bincount(at, minlength=COUNTERS) if often is None else np.bincount(at, often, COUNTERS).astype(np.int64)
        yield from slots(total.reshape(-1, SLOT))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[slot] = total.get(slot, 0) + np.frombuffer(part, np.int64)
        yield from slots(np.stack(list(total.values())), list(total)) if total else ()

    def slots(rows: np.ndarray, numbers: list[int] | None = None) -> Iterator[pa.RecordBatch]:
        kept = [(k, r.tobytes()) for k, r in zip(numbers or range(len(rows)), rows) if r.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.int32()), pa.array([r for _, r in kept], pa.binary())], names=["slot", "counts"])

    found = df.mapInArrow(count, "slot int, counts binary").repartition("slot").mapInArrow(add, "slot int, counts binary").toArrow()  # COUNTERS counts at most
    out = np.zeros((COUNTERS // SLOT, SLOT), np.int64)
    for slot, part in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
        out[slot] = np.frombuffer(part, np.int64)
    return out.reshape(-1)


def word_counts(docs: DataFrame) -> np.ndarray:
    """How often the words of each counter stand in all texts."""

    def numbers(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for part in blocks(iter([batch]), 0):
            coded = pc.ascii_split_whitespace(part.column(0).cast(pa.large_string())).flatten().dictionary_encode()
            often = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
            plain = plain_words(coded.dictionary)
            some = pc.greater(pc.binary_length(plain), 0)
            yield word_hashes(plain.filter(some)).astype("<u4"), often[some.to_numpy(zero_copy_only=False)]

    return counted(docs.select("text"), numbers)


def plain_words(words: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(words), characters=PUNCTUATION)


def rarity_levels(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of 1024 steps."""
    return np.minimum(1023, 25 * np.log2(1 + counts)).astype(np.uint16)


def prefix_sizes(n: np.ndarray) -> np.ndarray:
    """How many of a line's words are its prefix; none of a small line's."""
    up, down = SIMILARITY
    return np.where(n >= NEAR_WORDS, n - -(-up * n // down) + 1, 0)


def order_key(ids: pa.Array) -> np.ndarray:
    """Longs in the order of the ids; ids with equal longs may be in any order."""
    if pa.types.is_integer(ids.type):
        return pc.fill_null(ids.cast(pa.int64()), -(2**63)).to_numpy(zero_copy_only=False)
    if pa.types.is_string(ids.type) or pa.types.is_large_string(ids.type):
        heads = [(x or "").encode()[:8].ljust(8, b"\0") for x in ids.to_pylist()]
        return (np.frombuffer(b"".join(heads), ">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
    return np.zeros(len(ids), np.int64)


def prefix_table(docs: DataFrame, levels) -> DataFrame:
    """doc_id, d (a digest of the text), doc (an order key) and by line n (distinct words), ids (16 bytes), signs (16 bytes) and words (of its prefix, the rarest first, then by hash)."""
    names = ["doc_id", "d", "doc", "n", "ids", "signs", "words"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, 2):
            counts, line, number, hashes = word_table(part.column(2))
            n = np.bincount(line, minlength=int(counts.sum()))
            h = hashes[number]
            word = h.astype("<u4")
            ordered = line.astype(np.uint64) << np.uint64(42) | levels.value[word & np.uint32(COUNTERS - 1)].astype(np.uint64) << np.uint64(32) | word
            ordered.sort()
            own = prefix_sizes(n)
            words = ordered[within(n) < np.repeat(own, n)].astype("<u4")
            bit = mix(h, 7) & np.uint64(127)
            one = np.left_shift(np.uint64(1), bit & np.uint64(63))
            signs = np.stack([runs(np.where(bit < 64, one, np.uint64(0)), n, np.bitwise_xor), runs(np.where(bit < 64, np.uint64(0), one), n, np.bitwise_xor)], axis=1)
            of = np.repeat(np.arange(len(counts)), counts)
            columns = (parted(n.astype("<u4"), counts), parted(set_ids(h, n), counts), parted(signs, counts), parted(words, np.bincount(of, own, len(counts)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(order_key(part.column(0))), *columns], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("d"), "text").mapInArrow(work, f"doc_id {kind}, d long, doc long, n binary, ids binary, signs binary, words binary")


class Lines:
    """The lines of rows of a prefix table that may have near matches, equal ones of one order key once; words: of their prefixes, line after line."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches)
        n, counts = joined(table.column("n"), "<u4")
        n = n.astype(np.int64)
        doc = np.repeat(table.column("doc").to_numpy(), counts)
        ids, signs = joined(table.column("ids"), "<i8")[0].reshape(-1, 2)[:, 0], joined(table.column("signs"), "<u8")[0].reshape(-1, 2)
        words = joined(table.column("words"), "<u4")[0]
        own = prefix_sizes(n)
        order = np.lexsort((doc, ids))
        first = np.zeros(len(n), bool)
        first[order[np.concatenate([[True], np.diff(ids[order]) != 0])] if len(order) else order] = True
        first &= own > 0
        self.words = words[np.repeat(first, own)]
        self.n, self.doc, self.ids, self.signs, self.own = (c[first] for c in (n, doc, ids, signs, own))

    def expanded(self) -> np.ndarray:
        """A row for each word of each prefix."""
        out = np.empty(len(self.words), ROW)
        of = np.repeat(np.arange(len(self.n)), self.own)
        out["word"], out["n"], out["shape"], out["pair"] = self.words, self.n[of], within(self.own) << 1, 0
        out["id"], out["doc"], out["s0"], out["s1"] = self.ids[of], self.doc[of], self.signs[of, 0], self.signs[of, 1]
        return out


def line_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Lines]:
    """The lines of a prefix table's rows, so many rows at once that memory is bounded."""
    held, size = [], 0
    for batch in batches:
        bytes_ = np.cumsum(pc.binary_length(batch.column("words")).to_numpy(zero_copy_only=False).astype(np.int64))
        cut_at = np.flatnonzero(np.diff(bytes_ // (4 * ROWS_AT_ONCE))) + 1
        for a, b in zip([0, *cut_at.tolist()], [*cut_at.tolist(), batch.num_rows]):
            if b > a:
                held.append(batch.slice(a, b - a))
                size += int(bytes_[b - 1] - (bytes_[a - 1] if a else 0))
            if size >= 4 * ROWS_AT_ONCE:
                yield Lines(held)
                held, size = [], 0
    if held:
        yield Lines(held)


def hot_words(prefixed: DataFrame, crowd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words in the prefixes of more lines than a cell may have (sorted), and their numbers of cells."""
    spark = prefixed.sparkSession
    cell = max(CELL, -(-int(crowd.sum()) // MOST_HOT))  # so at most MOST_HOT words
    suspect = spark.sparkContext.broadcast(np.packbits(crowd > cell))
    if not (crowd > cell).any():
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.unpackbits(suspect.value).astype(bool)
        for lines in line_blocks(batches):
            word, n = np.unique(lines.words[often[lines.words & np.uint32(COUNTERS - 1)]], return_counts=True)
            for a in range(0, len(word), EMIT):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + EMIT].astype(np.int64)) for c in (word, n)], names=["word", "n"])

    found = prefixed.mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > cell).orderBy("word").toArrow()
    return found.column(0).to_numpy().astype(np.uint32), -(-found.column(1).to_numpy() // cell).astype(np.uint32)


def dealt_rows(rows: np.ndarray, hot: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Rows of hot words once for each pair of cells that they are in."""
    if not len(hot):
        return rows
    at = np.minimum(np.searchsorted(hot, rows["word"]), len(hot) - 1)
    many = np.where(hot[at] == rows["word"], cells[at], 1).astype(np.int64)
    cell = (rows["id"].view(np.uint64) % many.astype(np.uint64)).astype(np.int64)
    out, other, cell, many = np.repeat(rows, many), within(many), np.repeat(cell, many), np.repeat(many, many)
    out["pair"] = np.minimum(other, cell) * many + np.maximum(other, cell)
    out["shape"] |= (cell > other).astype(np.uint32)
    return out


def prefix_rows(prefixed: DataFrame, hot, count: int, crowd=None, only=None) -> DataFrame:
    """block and rows: prefix rows, packed by hash of word and cells into so many blocks. crowd: of lines by counter, as words of one line meet none; only: the counters wanted."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines in line_blocks(batches):
            rows = lines.expanded()
            at = rows["word"] & np.uint32(COUNTERS - 1)
            rows = dealt_rows(rows[(only.value if only is not None else crowd.value)[at]], *hot.value)
            block = (mix(rows["word"].astype(np.uint64) << np.uint64(32) | rows["pair"], 3) % np.uint64(count)).astype(np.int64)
            order = np.argsort(block.astype(np.uint16) if count <= 1 << 16 else block, kind="stable")
            rows, block = rows[order], block[order]
            edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else block
            for a in range(0, len(edges), 64):
                own = edges[a : a + 65].tolist() + ([len(rows)] if a + 65 > len(edges) else [])
                packed = [rows[x:y].view(np.uint8).reshape(-1, ROW.itemsize).T.tobytes() for x, y in zip(own[:-1], own[1:])]  # byte by byte, so that equal high bytes compress
                yield pa.RecordBatch.from_arrays([pa.array(block[own[:-1]]), pa.array(packed, pa.binary())], names=["block", "rows"])

    return prefixed.mapInArrow(work, "block long, rows binary")


def unpack(packed: list[bytes]) -> np.ndarray:
    parts = [np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(ROW.itemsize, -1).T).view(ROW).ravel() for p in packed]
    return np.concatenate(parts) if parts else np.zeros(0, ROW)


def needed(size: np.ndarray) -> np.ndarray:
    """The overlap that lines of a summed size must have."""
    up, down = SIMILARITY
    return -(-size * up // (up + down))


class Group:
    """Prefix rows in order of word, cells and size, so that those of fitting size are a window before each row; equal lines of a word once, the earliest."""

    def __init__(self, rows: np.ndarray):
        up, down = SIMILARITY
        if rows["pair"].any() or rows["n"].max() >= 4096:
            order = np.lexsort((rows["id"], rows["n"], rows["pair"], rows["word"]))
        else:  # the same in one key, in which unlike ids may rarely mix; equal lines that stay apart so are merely compared
            order = np.argsort(rows["word"].astype(np.uint64) << np.uint64(32) | rows["n"].astype(np.uint64) << np.uint64(20) | rows["id"].view(np.uint64) & np.uint64(0xFFFFF))
        rows = rows[order]
        same = [rows[c][1:] == rows[c][:-1] for c in ("word", "pair", "id", "n")]
        new = np.flatnonzero(np.concatenate([[True], ~(same[0] & same[1] & same[2] & same[3])]))
        doc = np.minimum.reduceat(rows["doc"], new)
        rows = rows[new]
        rows["doc"] = doc
        head = np.concatenate([[True], (rows["word"][1:] != rows["word"][:-1]) | (rows["pair"][1:] != rows["pair"][:-1])])
        group = np.cumsum(head) - 1
        self.ids, self.doc, self.s0, self.s1 = (np.ascontiguousarray(rows[c]) for c in ("id", "doc", "s0", "s1"))
        self.n, self.left = rows["n"].astype(np.int32), rows["n"].astype(np.int32) - (rows["shape"] >> 1).astype(np.int32)
        self.side = (rows["shape"] & 1).astype(np.int8)
        heads = np.flatnonzero(head)
        self.split = (np.maximum.reduceat(self.side, heads) != np.minimum.reduceat(self.side, heads))[group]
        n = self.n.astype(np.int64)
        self.width = np.arange(len(n)) - np.searchsorted(group << 32 | n, group << 32 | -(-n * up // down), "left")

    def pairs(self, open_: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Rows, rows before them, and words apart and at most apart of those that may match, by distance, where one of both is open (which may change meanwhile)."""
        j, step = np.flatnonzero(self.width > 0), 1
        while len(j):
            several = max(1, min(64, FEW_PAIRS // len(j)))  # distances at once
            for a in range(0, len(j), PAIRS_AT_ONCE):
                y = j[a : a + PAIRS_AT_ONCE]
                if several > 1:
                    back = np.tile(np.arange(step, step + several), len(y))
                    y = np.repeat(y, several)
                    y, back = y[back <= self.width[y]], back[back <= self.width[y]]
                    x = y - back
                else:
                    x = y - step
                some = open_[x] | open_[y]
                x, y = x[some], y[some]
                size = self.n[x] + self.n[y]
                need = needed(size)
                most = size - 2 * need
                apart = np.bitwise_count(self.s0[x] ^ self.s0[y]).astype(np.int32)
                ok = np.flatnonzero(apart <= most)
                x, y, need, most, apart = x[ok], y[ok], need[ok], most[ok], apart[ok]
                apart += np.bitwise_count(self.s1[x] ^ self.s1[y])
                ok = (apart <= most) & (np.minimum(self.left[x], self.left[y]) >= need) & (self.ids[x] != self.ids[y]) & (~self.split[x] | (self.side[x] != self.side[y]))
                if ok.any():
                    yield x[ok], y[ok], apart[ok], most[ok]
            step += several
            j = j[self.width[j] >= step]

    def directed(self, x: np.ndarray, y: np.ndarray, *more: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Later and earlier rows of pairs, by the order key; both ways where it is the same."""
        forth, back = self.doc[x] <= self.doc[y], self.doc[y] <= self.doc[x]
        yield (y[forth], x[forth], *(c[forth] for c in more))
        yield (x[back], y[back], *(c[back] for c in more))


def best_candidates(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """later, earlier (ids), apart and more: of each line the earlier one that differs least, and whether there may be others.

    A line whose candidate differs by clearly less than it may is not compared any more, so that a
    group of near copies takes a few comparisons a line, not one for each pair.
    """
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int16), np.zeros(0, bool)
    g = Group(rows)
    open_, more = np.ones(len(g.n), bool), np.zeros(len(g.n), bool)
    least, other = np.full(len(g.n), 2**15 - 1, np.int32), np.full(len(g.n), -1)
    for pair in g.pairs(open_):
        for later, earlier, apart, most in g.directed(*pair):
            order = np.lexsort((apart, later))
            later, earlier, apart, most = (c[order] for c in (later, earlier, apart, most))
            head = np.concatenate([[True], later[1:] != later[:-1]])[: len(later)]
            more[later[~head]] = True
            later, earlier, apart, most = (c[head] for c in (later, earlier, apart, most))
            more[later] |= other[later] >= 0
            better = apart < least[later]
            at = later[better]
            least[at], other[at] = apart[better], earlier[better]
            sure = later[4 * apart <= 3 * most]
            open_[sure], more[sure] = False, True
    at = np.flatnonzero(other >= 0)
    order = np.lexsort((g.ids[other[at]], least[at], g.ids[at]))  # under one of the block's words
    at = at[order]
    head = np.flatnonzero(np.concatenate([[True], g.ids[at][1:] != g.ids[at][:-1]])) if len(at) else at
    found, earlier = g.ids[at], g.ids[other[at]]
    if len(head):
        many = np.maximum.reduceat(earlier, head) != np.minimum.reduceat(earlier, head)
        some = np.maximum.reduceat(more[at], head)
        return found[head], earlier[head], least[at][head].astype(np.int16), some | many
    return found, earlier, least[at].astype(np.int16), more[at]


def all_candidates(rows: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """later, earlier, apart and more (false) of all pairs that may match and whose later line is wanted."""
    if not len(rows):
        return
    g = Group(rows)
    open_ = wanted(g.ids)
    for pair in g.pairs(open_):
        for later, earlier, apart in g.directed(*pair[:3]):
            hit = open_[later]
            if hit.any():
                yield g.ids[later[hit]], g.ids[earlier[hit]], apart[hit].astype(np.int16), np.zeros(hit.sum(), bool)


def candidates(rows: DataFrame, parts: int, only=None, bits: int = 0) -> DataFrame:
    """later, earlier, apart and more: pairs of line ids that may match, of a later line the best of each block; only: a broadcast bitmap of the later ones of which all are wanted."""
    names = ["later", "earlier", "apart", "more"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def matched() -> Iterator[pa.RecordBatch]:
            own = unpack(held)
            held.clear()
            found, size = [], 0
            for part in [best_candidates(own)] if only is None else all_candidates(own, lambda ids: in_table(ids, only.value, bits)):
                found.append(part)
                size += len(part[0])
                if size >= EMIT:
                    yield from emitted(found)
                    found, size = [], 0
            yield from emitted(found)

        def emitted(found: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*found)]
            for a in range(0, len(columns[0]) if columns else 0, EMIT):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + EMIT]) for c in columns], names=names)

        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != at:
                    yield from matched()
                    at = block
                held.append(packed.as_py())
        yield from matched()

    return rows.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(work, "later long, earlier long, apart short, more boolean")


def bit_table(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of ids (column id), 64 bits an entry, of bounded size, and its number of bits."""
    size = min(MOST_BITS, max(1 << 20, 1 << int(64 * ids.count()).bit_length()))
    at = F.col("id").bitwiseAND(F.lit(size - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    found = ids.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out, size


def in_table(ids: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    masked = ids & (bits - 1)
    return (table[masked >> 6] >> (masked & 63).astype(np.uint64)) & np.uint64(1) == 1


def line_ids(prefixed: DataFrame) -> DataFrame:
    """id and k, the two halves of the name of each line with words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = joined(batch.column("ids"), "<i8")[0].reshape(-1, 2)[joined(batch.column("n"), "<u4")[0] > 0]
            for a in range(0, len(ids), EMIT):
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + EMIT, 0]), pa.array(ids[a : a + EMIT, 1])], names=["id", "k"])

    return prefixed.mapInArrow(work, "id long, k long")


def places(prefixed: DataFrame, wanted, bits: int) -> DataFrame:
    """id, k, doc_id, d and line of each line whose id may be wanted."""
    names = ["id", "k", "doc_id", "d", "line"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, counts = joined(batch.column("n"), "<u4")
            ids = joined(batch.column("ids"), "<i8")[0].reshape(-1, 2)
            hit = np.flatnonzero(in_table(ids[:, 0], wanted.value, bits) & (n > 0))
            row, line = pa.array(np.repeat(np.arange(len(counts)), counts)[hit]), within(counts)[hit]
            for a in range(0, len(hit), EMIT):
                own = row[a : a + EMIT]
                columns = [*(pa.array(ids[hit[a : a + EMIT], c]) for c in (0, 1)), batch.column("doc_id").take(own), batch.column("d").take(own), pa.array(line[a : a + EMIT])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return prefixed.mapInArrow(work, f"id long, k long, doc_id {prefixed.schema['doc_id'].dataType.simpleString()}, d long, line long")


def place() -> Column:
    """Where a line stands, in the order of all lines."""
    return F.struct("doc_id", "d", "line")


def place_key(d, line):
    """A long by which a bitmap finds places: the text's digest, its low bits by line."""
    return d.bitwiseXOR(line) if hasattr(d, "bitwiseXOR") else d ^ line


def line_texts(docs: DataFrame, wanted, bits: int) -> DataFrame:
    """doc_id, d, line and text of each line whose place may be wanted."""
    names = ["doc_id", "d", "line", "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, 2):
            lines = pc.split_pattern(pc.fill_null(part.column(2).cast(pa.large_string()), ""), "\n")
            counts = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
            line, row = within(counts), np.repeat(np.arange(len(counts)), counts)
            hit = np.flatnonzero(in_table(place_key(part.column(1).to_numpy()[row], line), wanted.value, bits))
            own = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), pa.array(line[hit]), lines.flatten().take(pa.array(hit)).cast(pa.string())], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("d"), "text").mapInArrow(work, f"doc_id {kind}, d long, line long, text string")


def similar(one: pa.Array, other: pa.Array) -> np.ndarray:
    """Which pairs of lines have sets of words of the similarity asked for."""
    up, down = SIMILARITY
    n = len(one)
    _, line, number, _ = word_table(pa.concat_arrays([one.cast(pa.large_string()), other.cast(pa.large_string())]))
    size = np.bincount(line, minlength=2 * n)
    pairs = (line % n if n else line) << 32 | number
    both = np.sort(pairs)
    shared = np.bincount(both[1:][both[1:] == both[:-1]] >> 32, minlength=n)
    return shared * (up + down) >= up * (size[:n] + size[n:])


def verified(pairs: DataFrame, docs: DataFrame, prefixed: DataFrame) -> DataFrame:
    """later, doc_id, d and line: the first places of the lines whose words match those of an earlier one."""
    context = pairs.sparkSession.sparkContext
    table, bits = bit_table(pairs.select(F.explode(F.array("later", "earlier")).alias("id")).distinct())
    wanted = context.broadcast(table)
    firsts = stored(places(prefixed, wanted, bits).groupBy("id").agg(F.min(place()).alias("place")))
    table, bits = bit_table(firsts.select(place_key(F.col("place.d"), F.col("place.line")).alias("id")))
    texts = line_texts(docs, context.broadcast(table), bits).distinct()  # equal rows give a place more than once
    at = firsts.select("id", "place", F.col("place.doc_id").alias("_doc"), F.col("place.d").alias("_d"), F.col("place.line").alias("_line"))
    lines = stored(at.join(texts, (F.col("_d") == F.col("d")) & (F.col("_line") == F.col("line")) & F.col("_doc").eqNullSafe(F.col("doc_id"))).select("id", "place", "text"))
    later, earlier = (lines.select(F.col("id").alias(x), F.col("place").alias(f"{x}_at"), F.col("text").alias(f"{x}_text")) for x in ("later", "earlier"))
    both = pairs.select("later", "earlier").join(later, "later").join(earlier, "earlier").where("earlier_at < later_at").select("later", "later_at.*", "later_text", "earlier_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, EMIT):
                part = batch.slice(a, EMIT)
                yield part.select(["later", "doc_id", "d", "line"]).filter(pa.array(similar(part.column("later_text"), part.column("earlier_text"))))

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = stored(both.mapInArrow(work, f"later long, doc_id {kind}, d long, line long").distinct())
    forget(firsts, lines)
    return found


def near_lines(docs: DataFrame, prefixed: DataFrame) -> list[DataFrame]:
    """Tables of the first places (later, doc_id, d, line) of lines that an earlier, different one matches."""
    spark = docs.sparkSession
    context = spark.sparkContext

    def words_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        return ((x.words, None) for x in line_blocks(iter([batch])))

    crowd = counted(prefixed, words_of)
    hot = context.broadcast(hot_words(prefixed, crowd))
    total = int((crowd + crowd // CELL * crowd).sum())
    count, parts = max(1, total // BLOCK_ROWS), max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_ROWS)
    rows = prefix_rows(prefixed, hot, count, context.broadcast(crowd > 1))
    best = candidates(rows, parts).groupBy("later").agg(
        F.min_by("earlier", "apart").alias("earlier"),
        (F.max("more") | (F.min("earlier") != F.max("earlier"))).alias("more"),
    )
    pairs = stored(best)
    gone = [verified(pairs, docs, prefixed)]
    late = stored(pairs.where("more").select("later").join(gone[0], "later", "left_anti"))
    forget(pairs)
    if not late.isEmpty():  # with all their candidates
        table, bits = bit_table(late.select(F.col("later").alias("id")))
        seen = context.broadcast(table)

        def words_of_late(batch: pa.RecordBatch) -> Iterator[tuple]:
            return ((x.words[np.repeat(in_table(x.ids, seen.value, bits), x.own)], None) for x in line_blocks(iter([batch])))

        rows = prefix_rows(prefixed, hot, count, only=context.broadcast(counted(prefixed, words_of_late) > 0))
        again = stored(candidates(rows, parts, seen, bits).join(late, "later", "left_semi").select("later", "earlier").distinct())
        gone.append(verified(again, docs, prefixed))
        forget(again)
    forget(late)
    return gone


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """doc_id, d (a digest of the text) and line (from 0) of each line that an earlier one matches, each once."""
    context = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text")
    prefixed = stored(prefix_table(docs, context.broadcast(rarity_levels(word_counts(docs)))))  # COUNTERS levels
    near = near_lines(docs, prefixed)
    repeated = stored(line_ids(prefixed).groupBy("id", "k").agg(F.count("*").alias("n")).where("n > 1"))
    table, bits = bit_table(repeated)
    every = stored(places(prefixed, context.broadcast(table), bits))
    gone = stored(equal_lines(every, repeated.agg(F.sum("n")).first()[0] or 0).unionByName(reduce(DataFrame.unionByName, [part.select("doc_id", "d", "line") for part in near])))
    forget(prefixed, repeated, every, *near)
    return gone


def equal_lines(every: DataFrame, total: int) -> DataFrame:
    """doc_id, d and line of all but the first place of each set of words (id, k); total: of lines whose set is not their own alone."""
    firsts = every.groupBy("id", "k").agg(F.min(place()).alias("first"), F.count("*").alias("n")).where("n > 1")
    hot = F.col("n") > max(HOT_SET, total // MOST_HOT_SETS)
    most = stored(firsts.where(hot))  # MOST_HOT_SETS rows at most
    out = every.join(F.broadcast(most), ["id", "k"])
    rest = every.join(F.broadcast(most.select("id", "k")), ["id", "k"], "left_anti").join(firsts.where(~hot), ["id", "k"])
    return out.unionByName(rest).where(place() != F.col("first")).select("doc_id", "d", "line")


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, d and lines (sorted) of each document that loses lines."""
    lines = duplicate_lines(docs)
    gone = stored(lines.groupBy("doc_id", "d").agg(F.array_sort(F.collect_set("line")).alias("lines")))
    forget(lines)
    return gone.select(F.col("doc_id").alias("_doc"), F.col("d").alias("_d"), F.col("lines").alias("_lines"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and removed (line numbers from 0, comma-joined) of each document."""
    counts = docs.select("doc_id", text_key().alias("d"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    both = counts.join(removals(docs), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("d") == F.col("_d")), "left")
    return both.select("doc_id", "n_lines", F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.col("_lines").cast("array<string>"), ","), F.lit("")).alias("removed"))


def remove_lines(docs: DataFrame) -> DataFrame:
    """docs without the lines that earlier ones match; n_chars follows where there is one."""
    rows = docs.select(F.col("doc_id").alias("_id"), text_key().alias("_key"), whole_row(docs).alias("_row"))
    both = rows.join(removals(docs), F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_d")), "left")
    own = F.split("_row.text", "\n")
    stay = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(own).cast("long") - 1), F.col("_lines"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(own, i.cast("int"))), "\n")
    changed = {"text": F.when(F.col("_lines").isNull(), F.col("_row.text")).otherwise(kept)}
    out = both.withColumn("_text", changed["text"])
    changed["text"] = F.col("_text")
    if "n_chars" in docs.columns:
        chars = F.when(F.col("_lines").isNull(), F.col("_row.n_chars")).otherwise(F.length("_text"))
        changed["n_chars"] = chars.cast(docs.schema["n_chars"].dataType)
    return out.select(*unpacked("_row", docs.columns, changed))
