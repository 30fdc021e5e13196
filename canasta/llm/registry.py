"""Registered queries of the corpus operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotraining, digests, fill_in_middle, line_dedup, lm_scoring, mixing, quality_rules, secrets, sentencepiece_codec, simhash, substring_dedup, toxicity, whitening
from .common import own_names, table
from .oracle import ORACLE as ORACLE


def _documents(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return own_names(table(spark, sf_dir, "documents"), *names)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.codec_digests(_documents(spark, sf_dir, "doc_id", "text"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(_documents(spark, sf_dir, "doc_id", "source", "text"))
    return planned.select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(_documents(spark, sf_dir, "doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.near_duplicates(_documents(spark, sf_dir, "doc_id", "text"))
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(_documents(spark, sf_dir, "doc_id", "text"), own_names(table(spark, sf_dir, "labels"), "doc_id", "toxic"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.with_edits(_documents(spark, sf_dir, "doc_id", "text"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir, "doc_id", "text"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(_documents(spark, sf_dir, "doc_id", "text"), whole_lines=True)


def op9_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.score(_documents(spark, sf_dir, "doc_id", "text", "lang", "source", "n_chars"), own_names(table(spark, sf_dir, "labels"), "doc_id", "quality"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_documents(spark, sf_dir, "doc_id", "text"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(own_names(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.transform(_documents(spark, sf_dir, "doc_id", "text"), digests=True)


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_documents(spark, sf_dir, "doc_id", "text"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_mixing": op2_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_digests": op6_digests,
    "op7_secrets": op7_secrets,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_cotraining": op9_cotraining,
    "op10_line_dedup": op10_line_dedup,
    "op11_whitening": op11_whitening,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_lm_scoring": op13_lm_scoring,
    "pipeline": corpus_pipeline.run,
}
