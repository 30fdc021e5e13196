"""Mixing sources to target weights by repetition rates.

One aggregate gives each source's size in words. Targets share the total by
weight and stop at ``MOST_REPEATS`` times a source's size; what is over is
shared again by weight among the others until none is above, which is the level
``L`` with ``sum(min(3 * size, weight * L)) = total``. A source's rate is its
target over its size: a document is taken floor(rate) times, and once more when
its hash draws below the fraction. Digests of the document's key
hold ``DRAWS`` independent draws; each source uses the one whose words taken
come nearest its target, found by one more aggregate, so that even a source of
a few long documents comes near.

Only counts by source are gathered. Sources are ranked by range partitions, so
that their number is not bounded by one task, and joined by broadcast only
while they are few (``BROADCAST_SOURCES``); beyond that by a salted join.

Defined results: null and blank texts have size 0, are taken floor(rate) times
plus their draw and count no words; a null source ranks last; a source without
words has target 0 and rate 0, so its documents are not taken; repeated rows
share their draw; an empty table gives an empty result; other columns pass
through :func:`mix` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, unpacked, whole_row

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Draws of five hexadecimal digits each, twelve from a digest.
DRAWS = 48
DRAW_DIGITS = 5
IN_DIGEST = 12
BROADCAST_SOURCES = 5_000
LONGEST_BROADCAST_NAME = 1_000
SALTS = 32


def size_in_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def draw(key: Column, k: Column | int) -> Column:
    """The k-th draw of a key, a fraction of 0 to 1."""
    k = F.lit(k) if isinstance(k, int) else k
    digest = F.sha2(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.floor(k / IN_DIGEST)), 256)
    digits = F.substr(digest, (k % IN_DIGEST) * DRAW_DIGITS + 1, F.lit(DRAW_DIGITS))
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16**DRAW_DIGITS))


def ranked_weights(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds weight: the weights in turn over the sources by code point, null last."""
    ordered = cut(sources.withColumn("_last", F.col("source").isNull()).repartitionByRange("_last", "source").withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["_part"], r["n"]) for r in ordered.groupBy("_part").agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, total = {}, 0
    for part, n in counts:
        before[part] = total
        total += n
    offset = F.lit(0).cast("long")
    if before:
        offset = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]), F.col("_part").cast("long"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_last", "source")) - 1 + offset
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (rank % len(weights) + 1).cast("int"))
    return ordered.withColumn("weight", weight).drop("_last", "_part")


def level(weighted: DataFrame, most: int = MOST_REPEATS) -> float:
    """Words for a unit of weight, such that capped targets add up to all words."""
    total = weighted.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    at = None
    while True:
        over = F.lit(False) if at is None else F.col("weight") * F.lit(at) > F.col("source_size") * most
        row = weighted.agg(
            F.sum(F.when(over, F.col("source_size") * most).otherwise(0)).alias("capped"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weights"),
        ).first()
        if not row["weights"]:
            return at or 0.0
        new = (total - row["capped"]) / row["weights"]
        if new == at:
            return at
        at = new


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, weight, target and rate of a table with source and size."""
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighted = cut(ranked_weights(per_source, weights))
    target = F.least(F.col("source_size") * F.lit(float(most)), F.col("weight") * F.lit(level(weighted, most)))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return weighted.withColumn("target", target).withColumn("rate", rate)


def join_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with the columns of their source; one row for each source, in a few of which most rows may be."""
    bound = sources.agg(F.count("*").alias("n"), F.max(F.length("source")).alias("longest")).first()
    if bound["n"] <= BROADCAST_SOURCES and (bound["longest"] or 0) <= LONGEST_BROADCAST_NAME:
        near = F.broadcast(sources.withColumnRenamed("source", "_source"))
        return rows.join(near, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    spread = sources.withColumnRenamed("source", "_source").withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_at"))).drop("_source", "_salt", "_at")


def copies(rate: Column, key: Column, k: Column | int) -> Column:
    return (F.floor(rate) + F.when(draw(key, k) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def plan(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken (words) of each row of a table with text and source."""
    sized = cut(df.select("doc_id", "source", size_in_words(F.col("text")).alias("size")))
    sources = source_targets(sized, weights, most)
    joined = join_sources(sized, sources)
    sums = joined.groupBy("source").agg(
        F.first("target").alias("target"),
        F.array(*[F.sum(copies(F.col("rate"), F.col("doc_id"), k) * F.col("size")) for k in range(DRAWS)]).alias("taken"),
    )
    gaps = F.transform(F.col("taken"), lambda t: F.abs(t - F.col("target")))
    best = sums.select(F.col("source").alias("_s"), (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int").alias("draw_no"))
    chosen = cut(sources.join(best, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    planned = join_sources(sized, chosen).withColumn("copies", copies(F.col("rate"), F.col("doc_id"), F.col("draw_no")))
    return planned.withColumn("taken", F.col("copies") * F.col("size")).drop("weight")


def mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """df's rows, each as often as the mix takes it.

    The rates of the sources are found on keys and sizes alone; each row's
    copies then follow from its own source and doc_id, so texts are not shuffled.
    """
    rows = df.select("doc_id", "source", whole_row(df).alias("_row"))
    sources = plan(df.select("doc_id", "source", "text"), weights, most).groupBy("source").agg(F.first("rate").alias("_rate"), F.first("draw_no").alias("_draw"))
    joined = join_sources(rows, cut(sources))
    times = copies(F.col("_rate"), F.col("doc_id"), F.col("_draw"))
    # no copy: the sequence is null, and so explodes to no row
    numbers = F.when(times > 0, F.sequence(F.lit(1).cast("long"), times))
    return joined.select("_row", F.explode(numbers)).select(*unpacked("_row", df.columns))
