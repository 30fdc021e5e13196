"""Substring dedup by hashing units whose edges the words themselves set.

A text is its words, lower-cased and without punctuation, whatever its lines
and sentences. It is cut after each word whose hash, taken with the word before,
is the least of some ``WINDOW`` words in a row, so that the cuts within a passage
are the same wherever it stands but for those near its ends. A unit begins at a
cut and ends at the first cut from ``RUN_WORDS`` words on. Cuts are at most
``WINDOW`` words apart, so that a repeated passage of 51 words or more holds a
whole unit in both places; what stays of it is near its ends. Digests of units are grouped globally; the
occurrence with the smallest doc_id and offset stays and later ones go. A span is
a run of repeated units; two may overlap where passages of two sources meet.
With ``whole_lines``, as in the query, a line whose words an earlier whole line
has goes too, however short. Offsets are of the original text, in code points,
end exclusive.

Scale: a group of equal units is one row of a partial aggregate (its first
place), then only units with a repeated digest meet it in a join of plain
shuffles, of which adaptive execution splits a hot digest's.

Defined results: null, empty and blank texts and those under ``RUN_WORDS`` words
have no units; rows that share a doc_id are told apart by a digest of their
text, which orders them (rows equal in both lose the same spans, and none to
each other); null ids come first; ids of any type that Spark orders; repeats within a document go too; an empty table gives an
empty result; extra columns of any name pass through :func:`remove_spans`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, stored, text_key, unpacked, whole_row

PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
RUN_WORDS = 20
WINDOW = 8
EMIT = 20_000
#: Bytes of text taken up at once.
BLOCK_BYTES = 1_000_000
#: Numbers of whole lines as units lie below those of others.
FIRST_LINE = -(2**31)
#: Bytes of words: white space, and what is neither it nor punctuation.
WHITE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
PLAIN = ~WHITE & ~np.isin(np.arange(256), list(PUNCTUATION))
#: Odd factors of the polynomials that name words (by their bytes) and runs of words, and their inverses modulo 2^64.
BYTES = 0x9E3779B97F4A7C15
RUNS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class Powers:
    """The powers of a number modulo 2^64, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.known = base % 2**64, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.known):
            self.known = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n, 2 * len(self.known)), self.base, np.uint64))])
        return self.known[:n]


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(RUNS[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(RUNS[1])
    return x ^ (x >> np.uint64(31))


def lowered(text: str) -> str:
    """The text in lower case, of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


class Words:
    """The normalised words of some texts as hashes, where each starts and ends in its text, and the texts' lines.

    A run of words is named by two polynomials of their hashes, which prefix sums
    give for any run at once: the sum over a run, times the inverse power of where it begins.
    """

    byte_powers = Powers(BYTES)
    run_powers = [Powers(k) for k in RUNS]
    inverse_powers = [Powers(pow(k, -1, 2**64)) for k in RUNS]

    def __init__(self, texts: list[str]):
        parts = [lowered(t).encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join(parts), np.uint8)  # a text ends as its last line does
        begins = np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1]
        edges = np.flatnonzero(np.diff(~WHITE[data], prepend=False, append=False))
        first, last = edges[::2], edges[1::2]
        plain = PLAIN[data]
        size = np.add.reduceat(plain, first, dtype=np.int64) if len(first) else first
        kept = size > 0
        counts = size[kept]
        own = data[plain].astype(np.uint64) + np.uint64(1)
        heads = np.cumsum(counts) - counts
        at = np.arange(len(own)) - np.repeat(heads, counts)
        powers = self.byte_powers.upto(int(counts.max(initial=0)))
        self.hash = mix(np.add.reduceat(own * powers[at], heads), 1) if len(counts) else np.zeros(0, np.uint64)
        words_before = np.concatenate([[0], np.cumsum(kept)])
        # lines: their tokens, and of these their words
        ends = np.flatnonzero(data == 10)
        self.token_bounds = np.concatenate([[0], np.searchsorted(first, ends), [len(first)]])
        self.word_bounds = words_before[self.token_bounds]
        self.first_line = np.concatenate([np.searchsorted(ends, begins), [len(ends) + 1]])
        # texts: their words
        self.text_bounds = words_before[np.concatenate([np.searchsorted(first, begins), [len(first)]])]
        if len(data) and (data & 0x80).any():
            place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            first, last, begins = place[first], place[last], place[begins]
        self.begins, self.token_starts, self.token_ends = begins, first, last
        self.starts, self.ends = first[kept], last[kept]
        n = len(self.hash)
        self.sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(self.hash, salt) * k.upto(n))]) for k, salt in zip(self.run_powers, (2, 3))]

    def names(self, a: np.ndarray, b: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit digests of the words from a to b."""
        out = []
        for sums, inverse in zip(self.sums, self.inverse_powers):
            powers = inverse.upto(len(sums))
            out.append(mix((sums[b] - sums[a]) * powers[a] + (b - a).astype(np.uint64) * np.uint64(BYTES), salt).view(np.int64))
        return tuple(out)

    def cuts(self) -> np.ndarray:
        """Numbers of words before each cut, with the ends of all texts."""
        n = len(self.hash)
        ends = self.text_bounds
        if n < WINDOW:
            return np.unique(ends)
        h = self.hash.copy()
        h[1:] += self.hash[:-1] * np.uint64(RUNS[1])  # single words are too often the same
        inner = ends[:-1][ends[:-1] < n]
        h[inner] = self.hash[inner]
        windows = np.lib.stride_tricks.sliding_window_view(mix(h, 5)[::-1], WINDOW)  # of equal words the last
        low = n - WINDOW - np.arange(len(windows))  # the first word of each window
        whole = np.searchsorted(ends, low, "right") == np.searchsorted(ends, low + WINDOW - 1, "right")
        least = windows[whole].argmin(axis=1) + np.flatnonzero(whole)
        return np.unique(np.concatenate([ends, n - least]))

    def units(self, run_words: int) -> tuple[np.ndarray, ...]:
        """text, number in it, start, end and digest (two columns) of each unit."""
        edge = self.cuts()
        last = np.searchsorted(edge, edge + run_words)
        a, b = edge[last < len(edge)], edge[last[last < len(edge)]]
        text = np.searchsorted(self.text_bounds, a, "right") - 1
        inside = b <= self.text_bounds[np.minimum(text + 1, len(self.text_bounds) - 1)]
        a, b, text = a[inside], b[inside], text[inside]
        number = np.arange(len(text)) - np.searchsorted(text, text)
        return text, number, self.starts[a] - self.begins[text], self.ends[b - 1] - self.begins[text], *self.names(a, b, 7)

    def lines(self) -> tuple[np.ndarray, ...]:
        """text, number in it, start, end and digest (two columns) of each line that has words."""
        k = np.flatnonzero(np.diff(self.word_bounds) > 0)
        text = np.searchsorted(self.first_line, k, "right") - 1
        start, end = self.token_starts[self.token_bounds[k]], self.token_ends[self.token_bounds[k + 1] - 1]
        return text, k - self.first_line[text], start - self.begins[text], end - self.begins[text], *self.names(self.word_bounds[k], self.word_bounds[k + 1], 11)


def units_of(text: str, run_words: int = RUN_WORDS) -> list[tuple]:
    """number, start, end and digest of each unit."""
    return [(*u[1:4], u[4:]) for u in zip(*(c.tolist() for c in Words([text]).units(run_words)))]


def lines_of(text: str) -> list[tuple]:
    """number, start, end and digest of each line that has words."""
    return [(*x[1:4], x[4:]) for x in zip(*(c.tolist() for c in Words([text]).lines()))]


def units(docs: DataFrame, run_words: int = RUN_WORDS, whole_lines: bool = False) -> DataFrame:
    """doc_id, d (a digest of the text), unit (from 0; of whole lines from FIRST_LINE), start, end and the digest's halves h1 and h2."""
    names = ["doc_id", "d", "unit", "start", "end", "h1", "h2"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bytes_ = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            edges = (np.flatnonzero(np.diff(np.cumsum(bytes_, dtype=np.int64) // BLOCK_BYTES)) + 1).tolist()
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                words = Words([t or "" for t in part.column(2).to_pylist()])
                yield from made(part, *words.units(run_words))
                if whole_lines:
                    text, number, *rest = words.lines()
                    yield from made(part, text, FIRST_LINE + number, *rest)

    def made(part: pa.RecordBatch, text: np.ndarray, *rest: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(text), EMIT):
            of = pa.array(text[a : a + EMIT])
            unit, start, end, h1, h2 = (c[a : a + EMIT] for c in rest)
            columns = [part.column(0).take(of), part.column(1).take(of), *(pa.array(c.astype(np.int32)) for c in (unit, start, end)), pa.array(h1), pa.array(h2)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_key().alias("d"), "text").mapInArrow(work, f"doc_id {kind}, d long, unit int, start int, end int, h1 long, h2 long")


def repeated_spans(docs: DataFrame, run_words: int = RUN_WORDS, whole_lines: bool = False) -> DataFrame:
    """doc_id, d (a digest of the text), n_removed (units) and spans (start and end, sorted) of each document with repeated passages.

    With whole_lines also those of repeated lines, of any length; spans that overlap are then joined.
    """
    every = units(docs, run_words, whole_lines)
    place = F.struct("doc_id", "d", "unit")
    firsts = stored(every.select("h1", "h2", place.alias("p")).groupBy("h1", "h2").agg(F.min("p").alias("first"), F.max("p").alias("last")).where("first <> last").drop("last"))
    # dealt by document once; what follows asks for no other order
    later = every.join(firsts, ["h1", "h2"]).where(place != F.col("first")).select("doc_id", "d", "unit", "start", "end").repartition("doc_id", "d").distinct()
    run = F.col("unit") - F.row_number().over(Window.partitionBy("doc_id", "d").orderBy("unit"))
    if whole_lines:
        by_start = Window.partitionBy("doc_id", "d").orderBy("start", "end", "unit")
        before = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
        later = later.withColumn("apart", F.coalesce(before < F.col("start"), F.lit(True)).cast("int"))
        run = F.sum("apart").over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    runs = later.withColumn("run", run).groupBy("doc_id", "d", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))
    spans = stored(runs.groupBy("doc_id", "d").agg(F.sum("n").alias("n_removed"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans")))
    forget(firsts)
    return spans


def _gone(docs: DataFrame, run_words: int, whole_lines: bool) -> DataFrame:
    found = repeated_spans(docs, run_words, whole_lines)
    return found.select(F.col("doc_id").alias("_doc"), F.col("d").alias("_d"), "n_removed", F.col("spans").alias("_spans"))


def report(docs: DataFrame, run_words: int = RUN_WORDS, whole_lines: bool = False) -> DataFrame:
    """doc_id, n_chars, n_removed (units), removed_chars and spans (start:end, comma-joined) of each document."""
    sizes = docs.select("doc_id", text_key().alias("d"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
    joined = sizes.join(_gone(docs, run_words, whole_lines), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("d") == F.col("_d")), "left")
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))  # characters so far, each once
    more = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(s["end"], a["upto"]).alias("upto"))
    return joined.select(
        "doc_id",
        "n_chars",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce(F.aggregate("_spans", none, more)["n"], F.lit(0)).alias("removed_chars"),
        F.coalesce(F.array_join(F.transform("_spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ","), F.lit("")).alias("spans"),
    )


def remove_spans(docs: DataFrame, run_words: int = RUN_WORDS, whole_lines: bool = False) -> DataFrame:
    """docs without their repeated passages."""
    rows = docs.select(F.col("doc_id").alias("_id"), text_key().alias("_key"), whole_row(docs).alias("_row"))
    joined = rows.join(_gone(docs, run_words, whole_lines), F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("_d")), "left")
    own = F.col("_row.text")
    ends = F.concat(F.array(F.lit(0)), F.transform("_spans", lambda s: s["end"]))
    starts = F.concat(F.transform("_spans", lambda s: s["start"]), F.array(F.length(own)))
    pieces = F.zip_with(ends, starts, lambda a, b: F.substr(own, a + 1, b - a))
    text = F.when(F.col("_spans").isNull(), own).otherwise(F.array_join(pieces, ""))
    return joined.select(*unpacked("_row", docs.columns, {"text": text}))
