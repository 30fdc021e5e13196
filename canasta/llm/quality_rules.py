"""Quality rules: a threshold table compiled into one projection.

Every document is measured with built-in functions alone (lengths, symbols,
stop words, line and repetition counts), and a table of thresholds becomes a
boolean column for each rule in the same select. Nothing is shuffled. Measures
and verdict leave the projection as the fields of one generated struct, so that
a filter on them stays above it: pushed below, it would compute every measure
anew for each rule that reads it.

Defined results: a null or blank text has no words and fails ``min_words``;
repeated rows are judged alike; an empty table gives an empty result; other
columns of any name pass through :func:`apply_rules` untouched (its own columns
win where names clash).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, unpacked, whole_row, words

SYMBOLS = r"[#*$%&|<>]"
#: Lines that begin as list items, trail off, or end as sentences do; in a form that Java and RE2 read alike.
BULLET = r"^[\x20\x09-\x0D]*[-*•‣▪●◦–]"
ELLIPSIS = r"(?:\.\.\.|…)[\x20\x09-\x0D]*\z"
SENTENCE_END = r"""[.!?:;…"'”’»)\]][\x20\x09-\x0D]*\z"""

#: Frequent function words of the four languages, sentence starts included.
STOP_WORDS = tuple(
    w
    for word in (
        "the of and to in is that it for was on are as with be this by at from or an he a "
        "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch er es an "
        "le la les et des en un une du dans que pour qui sur au par est il ne pas de ce se son "
        "el los las y que del con una por para no su al lo como más o pero sus"
    ).split()
    for w in (word, word.capitalize())
)


@dataclass(frozen=True)
class Rule:
    """A document fails when ``metric`` is under ``least`` or over ``most``."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


BASE_RULES = (Rule("min_words", "n_words", least=50), Rule("repeats", "repeat_percent", most=50))

#: Thresholds of the verdict, as published web-text filters set them.
RULES = (
    Rule("word_length", "mean_word_chars", least=2.0, most=15.0),
    Rule("symbols", "symbols_per_word", most=0.25),
    Rule("stop_words", "stop_word_ratio", least=0.01),
    Rule("dup_lines", "dup_line_ratio", most=0.5),
    Rule("bullets", "bullet_line_ratio", most=0.9),
    Rule("ellipses", "ellipsis_line_ratio", most=0.3),
    Rule("sentences", "sentence_line_ratio", least=0.1),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_sentence_lines", "n_repeat_words", "n_stop_words")


def measure(rows: DataFrame) -> DataFrame:
    """The columns _row and _text, with a column for each of MEASURES."""
    body = F.coalesce(F.col("_text"), F.lit(""))
    staged = (
        rows.withColumns({"_w": words(F.col("_text")), "_lines": F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD)), "n_symbols": F.regexp_count(body, F.lit(SYMBOLS))})
        .withColumns({"n_words": F.size("_w"), "n_lines": F.size("_lines"), "_tri": _windows(F.col("_w"))})
        .withColumn("_sorted", _repeats_sorted(F.col("_tri")))
    )
    lines_like = lambda pattern: F.size(F.filter("_lines", lambda line: line.rlike(pattern)))
    found = staged.withColumns({
        "word_chars": F.length(F.array_join("_w", "")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_bullet_lines": lines_like(BULLET),
        "n_ellipsis_lines": lines_like(ELLIPSIS),
        "n_sentence_lines": lines_like(SENTENCE_END),
        "n_repeat_words": _covered(F.col("_sorted")),
        "n_stop_words": F.size(F.filter("_w", lambda w: w.isin(*STOP_WORDS))),
    })
    return found.select("_row", *[F.col(m).cast("long").alias(m) for m in MEASURES])


def _windows(w: Column) -> Column:
    """A 64-bit hash of each window of three words."""
    return F.when(F.size(w) >= 3, F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def _repeats_sorted(tri: Column) -> Column:
    """Windows with their positions in the order of their hashes; null where none repeats, as a hash set shows."""
    return F.when(F.size(F.array_distinct(tri)) < F.size(tri), F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def _covered(ordered: Column) -> Column:
    """Words in windows found twice or more: those of windows equal to a neighbour in the sorted column."""
    repeated = F.filter(
        ordered,
        lambda x, i: x["h"].eqNullSafe(F.get(ordered, i - 1)["h"]) | x["h"].eqNullSafe(F.get(ordered, i + 1)["h"]),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return F.when(ordered.isNotNull(), covered).otherwise(0)


def _ratio(over: str, under: str) -> Column:
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(0.0)


#: Metrics of the threshold tables as fractions of measures; a rule on repeats is of whole numbers, free of rounding.
METRICS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "stop_word_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "bullet_line_ratio": ("n_bullet_lines", "n_lines"),
    "ellipsis_line_ratio": ("n_ellipsis_lines", "n_lines"),
    "sentence_line_ratio": ("n_sentence_lines", "n_lines"),
}


def failed(rule: Rule) -> Column:
    if rule.metric == "repeat_percent":
        return F.lit(100) * F.col("n_repeat_words") > F.lit(int(rule.most)) * F.col("n_words")
    value = _ratio(*METRICS[rule.metric]) if rule.metric in METRICS else F.col(rule.metric)
    parts = ([value < rule.least] if rule.least is not None else []) + ([value > rule.most] if rule.most is not None else [])
    return parts[0] if len(parts) == 1 else parts[0] | parts[1]


def apply_rules(df: DataFrame, text: str = "text", base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with MEASURES, failed_rules (names, null-free), base_failed and kept."""
    rows = df.select(whole_row(df).alias("_row"), F.col(f"`{text}`").alias("_text"))
    names = F.array_compact(F.array(*[F.when(failed(r), F.lit(r.name)) for r in (*base, *rules)]))
    judged = measure(rows).withColumn("failed_rules", names)
    own = F.struct(
        *MEASURES,
        "failed_rules",
        F.arrays_overlap("failed_rules", F.array(*[F.lit(r.name) for r in base])).alias("base_failed"),
        (F.size("failed_rules") == 0).alias("kept"),
    )
    fixed = (*MEASURES, "failed_rules", "base_failed", "kept")
    one = judged.select("_row", F.explode_outer(F.array(own)).alias("_own"))
    return one.select(*unpacked("_row", [c for c in df.columns if c not in fixed]), *[F.col(f"_own.{c}").alias(c) for c in fixed])
