"""Text functions as Column expressions: normalising, folding, tokens, prefixes and trigrams."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Accented letters of Peruvian Spanish and their plain forms (fixed values).
ACCENTED, PLAIN = "áéíóúüñàèìòùâêîôûäëïöç", "aeiouunaeiouaeiouaeioc"


def collapse_whitespace(text: Column) -> Column:
    """Runs of white space, no-break spaces included, as one space, trimmed."""
    return F.trim(F.regexp_replace(text, "[\\s\\u00A0]+", " "))


def collapse_ascii_space(text: Column) -> Column:
    """Runs of ASCII white space (the vertical tab is none) as one space, then spaces of any kind trimmed, as DuckDB has them."""
    return F.regexp_replace(F.regexp_replace(text, "[ \\t\\n\\f\\r]+", " "), "^\\p{Zs}+|\\p{Zs}+\\z", "")


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    there = texts.notna()
    return texts.where(~there, texts[there].map(lambda t: unicodedata.normalize("NFKC", t))) if there.any() else texts


def nfkc(text: Column) -> Column:
    """Compatibility composition. Spark runs a Python function on all rows, so text in plain ASCII, which stays as it is, goes to it as null."""
    other = F.when(text.rlike("[^\\x00-\\x7F]"), text)
    return F.coalesce(_nfkc(other), text)


def normalize_title(text: Column) -> Column:
    """Lower case, straight quotes and dashes, separators as spaces, single spaces."""
    out = F.lower(nfkc(text))
    for pattern, to in (("[\\u2018\\u2019]", "'"), ("[\\u2010-\\u2015]", "-"), ("[;|]", " ")):
        out = F.regexp_replace(out, pattern, to)
    return collapse_whitespace(out)


def fold_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def search_text(text: Column) -> Column:
    """A normalised title with digits and letters parted and all else as spaces."""
    out = normalize_title(text)
    out = F.regexp_replace(out, "(\\d)(\\p{L})", "$1 $2")
    out = F.regexp_replace(out, "(\\p{L})(\\d)", "$1 $2")
    return collapse_whitespace(F.regexp_replace(out, "[^\\p{L}\\p{N}]+", " "))


def tokens(text: Column) -> Column:
    return F.filter(F.split(search_text(text), " "), lambda w: w != "")


def matches_prefixes(words: Column, wanted: Column) -> Column:
    """Whether each wanted token is a number among the words or begins one of them."""
    return F.forall(wanted, lambda t: F.exists(words, lambda w: F.when(t.rlike("^\\d+$"), w == t).otherwise(F.startswith(w, t))))


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text's words, two spaces before and one after each; a text without words counts as one empty word, as in the SQL."""
    each = F.transform(
        F.split(search_text(text), " "),
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(each))


def shared_trigrams(a: Column, b: Column) -> tuple[Column, Column]:
    """How many trigrams two sets share, and how many there are in all."""
    shared = F.size(F.array_intersect(a, b))
    return shared.cast("long"), (F.size(a) + F.size(b) - shared).cast("long")


def useful_query(text: Column, most: int = 120) -> Column:
    """Long enough after normalising, and not too long before."""
    return (F.length(text) <= most) & (F.length(search_text(text)) >= 2)


def valid_demand(text: Column, controls: bool = False) -> Column:
    """3 to 80 characters, three letters or digits at least, and no control characters unless they are let in. White space is that of :func:`collapse_ascii_space`."""
    plain = collapse_ascii_space(F.lower(text))
    valid = F.length(plain).between(3, 80) & (F.length(F.regexp_replace(plain, "[^\\p{L}\\p{N}]", "")) >= 3)
    return valid if controls else valid & ~text.rlike("[\\x00-\\x1F\\x7F]")


def format_pen(cents: Column) -> Column:
    """``S/ 12.05``; null for negative amounts."""
    return F.when(cents >= 0, F.concat(F.lit("S/ "), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")))


def parse_pen(text: Column) -> Column:
    """Integer cents of ``S/ 1,234.5`` and the like; null for anything else."""
    bare = F.regexp_replace(F.trim(text), "^S/\\s*", "")
    grouped = bare.rlike("^[1-9]\\d{0,2}(,\\d{3})+(\\.\\d{1,2})?$")
    plain = F.when(grouped, F.regexp_replace(bare, ",", "")).when(bare.rlike("^\\d+(\\.\\d{1,2})?$"), bare)
    return (plain.try_cast("decimal(14,2)") * 100).cast("long")
