"""SimHash near-duplicates by pivot distance tables.

Fingerprints: 64 majority bits over the XXH64 of a text's word shingles, made
in Arrow batches of bounded size. Equal fingerprints are gathered first, so a
group of copies is one row from then on. Each distinct fingerprint gets its
Hamming distances to ``PIVOTS`` reference fingerprints once. By the triangle
inequality two fingerprints within ``MOST_BITS`` differ by no more than that in
every coordinate, so pairs are discarded by their largest coordinate
difference and only survivors are verified bit by bit.

Which pairs are looked at: linked fingerprints differ in at most 4 bits, so of
six blocks at least two are equal (of eight, four); every choice of that many
blocks is a key, and pairs meet under an equal key. (Pivot distances alone bound a pair only
from below and would need every pair of the table.) Rows are sorted by key and
first pivot distance; a key with more than ``CELL`` fingerprints is divided into
cells, each pair of cells being its own group, so no task holds a whole hot
key. A task keeps a forest of the links it found, so a group of near copies
gives a link for each member, not for each pair, and members already joined
are not compared again.

Defined results: null, empty and blank texts have no words and fingerprint
zero, and link like any other; equal rows share a fingerprint; null ids come
after all others; ids may be of any type that Spark orders; an empty table gives
an empty result; extra columns stay out of :func:`near_duplicates` and pass
through :func:`firsts_only` whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import cut, text_key, unpacked, whole_row
from .components import components

SEED = 42
SHINGLE = 4
MOST_BITS = 4
#: Bits of each block, 64 in all: 15 keys of 21 bits, or for tables of more than ``MANY`` fingerprints 70 of 32 bits.
BLOCKS = (11, 11, 11, 11, 10, 10)
FINE_BLOCKS = (8,) * 8
MANY = 1 << 24
#: Reference fingerprints: eight, so that their distances (0 to 64) fill the bytes of one long.
PIVOTS = 8
CELL = 8_192
#: Keys of rows to drop that are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 1 << 18
WINDOW = 1 << 16
BATCH = 500


def fingerprint_text(text: str | None, size: int = SHINGLE) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :]
    ones = np.zeros(64, np.int64)
    digest, seed = xxhash.xxh64_intdigest, SEED
    for a in range(0, n, WINDOW):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[a : min(a + WINDOW, n)].tolist(), last[a : a + WINDOW].tolist())], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", size: int = SHINGLE, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns and fp (the fingerprint as a signed long)."""
    names = [*carry, "fp"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                fps = np.array([fingerprint_text(t.as_py(), size) for t in part.column(len(carry))], "<u8").view("<i8")
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], pa.array(fps)], names=names)

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    return df.select(*carry, text).mapInArrow(work, f"{fields}, fp long")


def pivots(count: int = PIVOTS) -> list[int]:
    """Reference fingerprints as signed longs, drawn from a fixed generator."""
    return np.random.default_rng(SEED).integers(0, 2**64, count, np.uint64).view(np.int64).tolist()


def pivot_table(fp: Column) -> Column:
    """The distances to all pivots, a byte each, in one long."""
    parts = [F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long"), 8 * j) for j, p in enumerate(pivots())]
    out = parts[0]
    for part in parts[1:]:
        out = out.bitwiseOR(part)
    return out


def keys(fp: Column, blocks: tuple[int, ...] = BLOCKS, most: int = MOST_BITS) -> Column:
    """Every choice of len(blocks) - most blocks, as a number and the bits of those blocks packed into one long."""
    at = np.concatenate([[0], np.cumsum(blocks)]).tolist()
    block = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << n) - 1).cast("long")) for a, n in zip(at, blocks)]
    out = []
    for number, chosen in enumerate(itertools.combinations(range(len(blocks)), len(blocks) - most)):
        key = F.lit(number).cast("long")
        for i in chosen:
            key = F.shiftleft(key, blocks[i]).bitwiseOR(block[i])
        out.append(key)
    return F.array(*out)


class Forest:
    """Links between fingerprints, each joining two groups that were apart."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((max(x, y), min(x, y)))


def near(fp: np.ndarray, table: np.ndarray, other: np.ndarray, other_table: np.ndarray, most: int) -> np.ndarray:
    """Which pairs of two columns are within most bits: the largest pivot difference first, then the bits of the rest."""
    d = table.view(np.uint8).reshape(-1, PIVOTS).astype(np.int16) - other_table.view(np.uint8).reshape(-1, PIVOTS)
    left = np.flatnonzero(np.abs(d).max(axis=1) <= most)
    return left[np.bitwise_count((fp[left] ^ other[left]).view(np.uint64)) <= most]


def link_sorted(group: np.ndarray, cell: np.ndarray, fp: np.ndarray, table: np.ndarray, forest: Forest, most: int = MOST_BITS, small: int = 24) -> None:
    """Links within each run of equal groups. Rows come sorted by group; in a group of two cells pairs across them alone are compared."""
    n = len(fp)
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if n else np.zeros(1, int)
    sizes = np.diff(edges)
    run = np.repeat(sizes, sizes)
    for step in range(1, min(small, int(sizes.max(initial=1)))):  # small groups together
        i = np.flatnonzero((group[step:] == group[:-step]) & (run[step:] <= small))
        i = i[near(fp[i], table[i], fp[i + step], table[i + step], most)]
        for x, y in zip(fp[i].tolist(), fp[i + step].tolist()):
            forest.join(x, y)
    for k in np.flatnonzero(sizes > small).tolist():
        a, b = edges[k], edges[k + 1]
        link_large(cell[a:b], fp[a:b], table[a:b], forest, most)


def link_large(cell: np.ndarray, fp: np.ndarray, table: np.ndarray, forest: Forest, most: int) -> None:
    """One group: each row against those after it within most of its first pivot distance, without those joined already."""
    first = table.view(np.uint8).reshape(-1, PIVOTS)[:, 0]
    order = np.argsort(first, kind="stable")
    cell, fp, table, first = cell[order], fp[order], table[order], first[order].astype(np.int64)
    until = np.searchsorted(first, first + most, "right")
    across = cell[0] != cell[-1] or (cell != cell[0]).any()
    label = np.array([forest.root(x) for x in fp.tolist()], np.int64)
    for i in range(len(fp)):
        window = slice(i + 1, until[i])
        apart = label[window] != label[i]
        if across:
            apart &= cell[window] != cell[i]
        j = np.flatnonzero(apart) + i + 1
        if not len(j):
            continue
        hit = j[near(np.broadcast_to(fp[i], len(j)), np.repeat(table[i : i + 1], len(j)), fp[j], table[j], most)]
        if len(hit):
            for y in fp[hit].tolist():
                forest.join(int(fp[i]), y)
            joined = np.unique(np.concatenate([label[hit], label[i : i + 1]]))
            label[np.isin(label, joined)] = forest.root(int(fp[i]))


def links(distinct: DataFrame, most: int = MOST_BITS, cell: int = CELL, blocks: tuple[int, ...] = BLOCKS) -> DataFrame:
    """hi and lo: links that join all distinct fingerprints (column fp) within most bits, of which each task gives a forest."""
    keyed = distinct.select("fp", pivot_table(F.col("fp")).alias("pivots")).withColumn("key", F.explode(keys(F.col("fp"), blocks, most)))
    large = cut(keyed.groupBy("key").count().where(F.col("count") > cell).select("key", F.ceil(F.col("count") / cell).cast("int").alias("cells")))
    if large.isEmpty():
        dealt = keyed.select("fp", "pivots", "key", F.lit(0).alias("pair"), F.lit(0).alias("cell"))
    else:
        sized = keyed.join(large, "key", "left").withColumn("cells", F.coalesce("cells", F.lit(1))).withColumn("cell", F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int"))
        # each two cells of a key, and each alone; pair names them
        others = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda o: F.least(o, F.col("cell")) * F.col("cells") + F.greatest(o, F.col("cell")))
        dealt = sized.withColumn("pair", F.explode(others)).select("fp", "pivots", "key", "pair", "cell")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), []

        def flush(last: bool) -> None:
            table = pa.Table.from_batches(held)
            key, pair, fp, pivot, c = (table.column(x).to_numpy() for x in ("key", "pair", "fp", "pivots", "cell"))
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])])
            end = len(fp) if last else int(np.flatnonzero(new)[-1])
            link_sorted(np.cumsum(new)[:end], c[:end], fp[:end], np.ascontiguousarray(pivot[:end]), forest, most)
            held[:] = [b for b in table.slice(end).combine_chunks().to_batches() if b.num_rows]

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= 8 * WINDOW:
                    flush(False)
        if held:
            flush(True)
        for a in range(0, len(forest.links), 10_000):
            hi, lo = zip(*forest.links[a : a + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["hi", "lo"])

    return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(work, "hi long, lo long")


def near_duplicates(df: DataFrame, text: str = "text", size: int = SHINGLE, most: int = MOST_BITS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carry columns, fp, component_id (the smallest doc_id reachable over links of most bits or fewer) and first (doc_id and carry columns of the first row reachable)."""
    key = ("doc_id", *carry)
    docs = cut(fingerprints(df, text, size, key))
    place = F.struct(F.col("doc_id").isNull().alias("last"), *key)
    distinct = cut(docs.groupBy("fp").agg(F.min(place).alias("first")))
    blocks = BLOCKS if distinct.count() <= MANY else FINE_BLOCKS
    roots = components(links(distinct, most, blocks=blocks))
    rooted = cut(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    lowest = cut(rooted.groupBy("root").agg(F.min("first").alias("first")))
    labels = cut(rooted.select("fp", "root").join(lowest, "root").select("fp", F.struct(*[F.col(f"first.{c}") for c in key]).alias("first")))
    return docs.join(labels, "fp").select(*key, "fp", F.col("first.doc_id").alias("component_id"), "first")


def firsts_only(df: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id, then of the smallest digest of its text; rows equal in both stay together."""
    rows = df.select(F.col("doc_id").alias("_id"), text_key().alias("_key"), whole_row(df).alias("_row"))
    linked = near_duplicates(df.select("doc_id", text_key().alias("d"), "text"), carry=("d",))
    later = cut(linked.where(F.struct("doc_id", "d") != F.col("first")).select(F.col("doc_id").alias("_doc"), F.col("d").alias("_d")).distinct())
    if isinstance(df.schema["doc_id"].dataType, IntegralType) and later.count() <= BROADCAST_KEYS:  # 16 bytes a key
        later = F.broadcast(later)
    left = rows.join(later, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_d")), "left_anti")
    return left.select(*unpacked("_row", df.columns))
