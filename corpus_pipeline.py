"""The corpus pipeline: five stages from raw documents to token counts.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. :func:`run`
writes each result as Parquet in the shared checkpoint folder and reads it
back, so a stage works on all that its predecessor kept and a lost executor
costs no earlier stage.

Null and empty texts fail the quality rules and leave at the first stage; an
empty table passes every stage as one; extra columns stay until the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canasta.llm import line_dedup, mixing, quality_rules, sentencepiece_codec, simhash
from canasta.llm.common import forget, stored, table, unpacked, whole_row


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    rows = docs.select("text", whole_row(docs).alias("_row"))
    return quality_rules.apply_rules(rows).where("kept").select(*unpacked("_row", docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that earlier ones match."""
    return line_dedup.remove_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id."""
    return simhash.firsts_only(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return sentencepiece_codec.codec_digests(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near_duplicates), ("mixing", mix), ("sentencepiece", encode)]

#: SimHash groups and the vocabulary's merges are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            forget(before)
        before = docs
    return docs
