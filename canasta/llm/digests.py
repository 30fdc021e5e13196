"""Document fingerprints: quartile bucket digests of hashed byte triplets.

A window of five bytes slides over the UTF-8 text; its byte triplets are hashed
into ``BUCKETS`` counters. The digest is the length on a logarithmic scale and,
for each bucket, the quartile of its count among all buckets, two bits each, in
hexadecimal. Two digests are compared by the summed steps between quartiles and
lengths, bounded by what unrelated digests differ by, as a likeness of 0 to 1.

The neighbour in ascending doc_id is found without a global sort in one task:
documents are dealt to ranges between quantiles of doc_id, each range gets the
first document of the next as its last, and one pass over the sorted rows of a
range pairs neighbours.

Defined results: null texts count as empty; texts under five bytes have empty
counters, so that empty texts share a digest and are wholly alike; equal texts
have equal digests; ids are integers or strings; rows without an id come first,
and rows that share one follow each other by a digest of their text; a single
document is its own successor; an empty table gives an empty result; extra
columns stay out.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from .common import text_key

BUCKETS = 256
#: Offsets of the triplets in a window.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 4), (0, 3, 4))
WINDOW = 5
BLOCK = 1 << 18
#: The difference at which digests count as unrelated.
UNRELATED = 192
#: Rows sought in a range, and rows that a task takes up at once.
RANGE_ROWS = 2_000
MOST_RANGES = 50_000
#: Ids sampled for each range where they are strings.
SAMPLED = 20
BATCH = 200


def counts(data: bytes) -> np.ndarray:
    """Hashed triplets of all windows by bucket, block by block."""
    total = np.zeros(BUCKETS, np.int64)
    for start in range(0, max(0, len(data) - WINDOW + 1), BLOCK):
        b = np.frombuffer(data, np.uint8, count=min(len(data) - start, BLOCK + WINDOW - 1), offset=start).astype(np.uint32)
        n = len(b) - WINDOW + 1
        for salt, (i, j, k) in enumerate(TRIPLETS):
            h = b[i : n + i] * np.uint32(0x9E3779B1) + b[j : n + j] * np.uint32(0x85EBCA6B) + b[k : n + k] * np.uint32(0xC2B2AE35) + np.uint32(0x27D4EB2F * (salt + 1) & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            total += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return total


def digest(data: bytes) -> str:
    """Two digits of length, then the buckets' quartiles."""
    found = counts(data)
    cuts = np.sort(found)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    quartiles = np.searchsorted(cuts, found, "left").astype(np.uint8)  # how many cuts a count is above
    packed = quartiles.reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
    return f"{min(255, len(data).bit_length() * 8 + (len(data) << 3 >> max(0, len(data).bit_length() - 1) & 7)):02x}" + packed.astype(np.uint8).tobytes().hex()


def unpacked(fingerprint: str) -> tuple[int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return int(raw[0]), np.stack([raw[1:] >> s & 3 for s in (6, 4, 2, 0)], axis=1).ravel().astype(np.int16)


def likeness(one: str, other: str) -> float:
    """1 less the bounded difference of two digests."""
    if one == other:
        return 1.0
    (size, a), (other_size, b) = unpacked(one), unpacked(other)
    difference = int(np.abs(a - b).sum()) + max(0, abs(size - other_size) - 1)
    return max(0.0, 1.0 - difference / UNRELATED)


def fingerprints(df: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """carry columns and the fingerprint of each text."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(len(carry))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(found, pa.string())], names=[*carry, "fingerprint"])

    return df.select(*carry, text).mapInArrow(work, f"{fields}, fingerprint string")


def id_bounds(df: DataFrame, parts: int) -> np.ndarray:
    """Ids that part a table with a column doc_id into about equal ranges."""
    if isinstance(df.schema["doc_id"].dataType, IntegralType):
        found = df.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / (parts + 1) for i in range(1, parts + 1)], 10 * parts).alias("q")).first()["q"]
        return np.array(sorted(set(found or [])), np.int64)
    if not isinstance(df.schema["doc_id"].dataType, StringType):
        raise ValueError("doc_id must be an integer or a string")
    # a sample by hash, which sets where ranges end and no result
    ids = df.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id")).limit(SAMPLED * parts).toArrow().column(0).to_pylist()
    return np.array(sorted(set(sorted(ids)[SAMPLED // 2 :: SAMPLED])), object)


def ranges(df: DataFrame) -> DataFrame:
    """doc_id, text, range, copy (1 for the next range's first document), rows sorted by doc_id within a range of one partition."""
    spark = df.sparkSession
    rows = df.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    parts = max(1, min(MOST_RANGES, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), rows["n"] // RANGE_ROWS)))
    bounds, nulls = id_bounds(df.select("doc_id"), parts), 1 + min(MOST_RANGES, rows["nulls"] // RANGE_ROWS)

    @F.pandas_udf("int")
    def reached(ids: pd.Series) -> pd.Series:
        """How many bounds are at or under an id."""
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), "right").astype(np.int32))

    # rows without an id come first, in ranges of their texts' digests, below those of ids
    at_null = (F.floor((F.shiftright("d", 32) + F.lit(1 << 31)) * F.lit(nulls) / F.lit(1 << 32)) - nulls).cast("int")
    plain = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) if bounds.dtype != object else F.coalesce("doc_id", F.lit(""))
    dealt = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_key().alias("d"))
    dealt = dealt.withColumn("range", F.when(F.col("doc_id").isNull(), at_null).otherwise(reached(plain)))
    firsts = sorted((r["range"], r["doc_id"], r["d"]) for r in dealt.groupBy("range").agg(F.min(F.struct("doc_id", "d")).alias("first")).select("range", "first.*").collect())  # a row for each range
    # the first row of a range by doc_id, then digest, is also the last of the range before it
    heads = spark.createDataFrame([(doc_id, d, firsts[i - 1][0]) for i, (_, doc_id, d) in enumerate(firsts)], f"head {df.schema['doc_id'].dataType.simpleString()}, key long, before int")
    head = dealt.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("d") == F.col("key"))).groupBy("doc_id", "d", "before").agg(F.min("text").alias("text"))
    copied = head.select("doc_id", "text", "d", F.col("before").alias("range"), F.lit(1).alias("copy"))
    both = dealt.withColumn("copy", F.lit(0)).unionByName(copied)
    return both.repartition("range").sortWithinPartitions("range", "copy", "doc_id", "d", "text")


def with_edits(df: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness to each other and to the next document's."""
    kind = df.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before: range, doc_id, text, fingerprint
        out: list[tuple] = []
        id_type = pa.int64()

        def made() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t or id_type) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for row in range(batch.num_rows):
                doc_id, text, at, copy = (batch.column(i)[row].as_py() for i in range(4))
                mark = digest(text.encode("utf-8", "surrogatepass"))
                if held and held[0] == at:
                    _, before, own, own_mark = held
                    k = len(own) // 4
                    edited = (own[: len(own) - k] + text[:k]).encode("utf-8", "surrogatepass")
                    edited_mark = digest(edited)
                    out.append((before, len(own), hashlib.sha256(edited).hexdigest(), own_mark, edited_mark, likeness(own_mark, edited_mark), likeness(own_mark, mark)))
                held = None if copy else (at, doc_id, text, mark)
                if len(out) >= BATCH:
                    yield made()
        if out:
            yield made()

    return ranges(df.select("doc_id", "text")).select("doc_id", "text", "range", "copy").mapInArrow(
        work, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
