"""Exact unit prices: gates in order, then a fraction of cents for a kilogram, litre, piece or roll."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import bound, word
from .text import fold_accents

# Fixed values (UPR01): families of staples, pack words with a known meaning, and words of detergent pieces and drained weights.
STAPLES = ["rice", "sugar", "flour", "oats", "pasta"]
PACK_WORDS = ["tripack", "fourpack", "sixpack", "doypack"]
PIECES = "pods?|capsulas?"
DRAINED = "escurrid[oa]|drenad[oa]"
#: Staples under this many grams are taken for a slip.
LEAST_STAPLE = 10
BASES = ("mass", "volume", "item-count", "roll")


def unit_price(cents: Column, title: Column, attributes: Column, family: Column, fresh: Column, available: Column, by_weight: Column) -> Column:
    """basis, quality, num and den (cents for a whole unit), or the first reason against a price.

    attributes: a struct of :func:`canasta.functions.catalog.attributes`; by_weight: whether the source quotes a kilogram.
    """
    return bound(title_terms(title, attributes, family, by_weight), lambda terms: priced(cents, fresh, available, terms))


def title_terms(title: Column, attributes: Column, family: Column, by_weight: Column) -> Column:
    """What a title says of unit prices, whatever the offer: reason, basis, quality, times (of the price) and den.

    Made once a title, it leaves nothing but comparisons to each of its offers.
    """
    known = F.struct(fold_accents(F.lower(title)).alias("text"), F.lower(title).alias("low"), attributes.alias("attributes"), family.alias("family"), by_weight.alias("by_weight"))
    return bound(known, lambda k: bound(F.struct(k.alias("k"), _stopped(k).alias("stopped")), lambda s: _terms(s["k"], s["stopped"])))


def _stopped(k: Column) -> Column:
    """The first gate of a title, or by what its price is given."""
    text, attributes, family = k["text"], k["attributes"], k["family"]
    total, unit, issues = attributes["total"], attributes["unit"], attributes["issues"]
    paper = F.coalesce(family == "toilet_paper", F.lit(False))
    detergent = F.coalesce(family == "detergent", F.lit(False))
    odd_packs = F.size(F.filter(F.regexp_extract_all(k["low"], F.lit("(?<![a-z0-9_])[a-z]+pack(?![a-z0-9_])"), F.lit(0)), lambda w: ~w.isin(PACK_WORDS))) > 0
    both = text.rlike(r"\d\s*(?:kg|g)(?![a-z0-9_])") & text.rlike(r"\d\s*(?:ml|l)(?![a-z0-9_])")
    gates = [
        (F.coalesce(family == "canned_tuna", F.lit(False)) | text.rlike(word("atun")) | text.rlike(word(DRAINED)), "ambiguous-semantics"),
        (F.array_contains(issues, "ambiguous-quantity") & both, "conflicting-dimensions"),
        (k["by_weight"], "by-weight"),
        ((unit == "g") & (total < LEAST_STAPLE) & family.isin(STAPLES), "ambiguous-quantity"),
        ((F.size(issues) > 0) | odd_packs, "ambiguous-quantity"),
        (total.isNull(), "missing-quantity"),
        ((total <= 0) | ~unit.isin("g", "ml", "unit"), "invalid-quantity"),
        ((paper & (unit != "unit")) | (detergent & (unit == "unit") & ~text.rlike(word(PIECES))), "ambiguous-semantics"),
    ]
    return F.coalesce(*[F.when(gate, F.lit(name)) for gate, name in gates], F.lit("by-total"))


def _terms(k: Column, stopped: Column) -> Column:
    unit = k["attributes"]["unit"]
    paper = F.coalesce(k["family"] == "toilet_paper", F.lit(False))
    weighed, given = stopped == "by-weight", stopped.isin("by-weight", "by-total")
    basis = F.when(weighed | (unit == "g"), BASES[0]).when(unit == "ml", BASES[1]).when(paper, BASES[3]).otherwise(BASES[2])
    return F.struct(
        F.when(~given, stopped).alias("reason"),
        F.when(given, basis).alias("basis"),
        F.when(given, F.when(paper & ~weighed, "approximate").otherwise("strong")).alias("quality"),
        F.when(given, F.when(weighed | (unit == "unit"), F.lit(1)).otherwise(1000)).cast("long").alias("times"),
        F.when(weighed, F.lit(1).cast("long")).when(given, k["attributes"]["total"]).alias("den"),
    )


def priced(cents: Column, fresh: Column, available: Column, terms: Column) -> Column:
    """The unit price of an offer, by the terms of its title."""
    against = F.when(cents.isNull() | (cents < 0), "invalid-price").when(~F.coalesce(available, F.lit(True)), "unavailable").when(~fresh, "not-fresh").otherwise(terms["reason"])
    given = against.isNull()
    return F.struct(
        F.when(given, terms["basis"]).alias("basis"),
        F.when(given, terms["quality"]).alias("quality"),
        F.when(given, cents * terms["times"]).alias("num"),
        F.when(given, terms["den"]).alias("den"),
        against.alias("reason"),
    )
