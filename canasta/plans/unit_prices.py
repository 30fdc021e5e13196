"""Exact unit prices: ordered gates, rational comparison, half-up rounding and benefits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.catalog import attributes, family
from ..functions.unit_price import BASES, priced, title_terms
from ..sources.domain import latest_offers, with_
from ..sources.groceries import SQL as GROCERIES
from ..sources.groceries import groceries
from . import query
from .offers import CURRENT, FRESHNESS, current_offers, freshness

#: The gates of a unit price, by what the columns of a product say of its title.
REASON_SQL = f"""CASE WHEN cents < 0 THEN 'invalid-price' WHEN flag = 'R' THEN 'unavailable' WHEN {FRESHNESS} <> 'fresh' THEN 'not-fresh' WHEN noun = 'gizmo' THEN 'ambiguous-semantics'
WHEN issues LIKE '%ambiguous-quantity%' AND u <> v THEN 'conflicting-dimensions' WHEN type = 'LARGE' THEN NULL
WHEN unit = 'g' AND total < 10 AND title_family IN ('rice', 'sugar', 'flour', 'oats', 'pasta') THEN 'ambiguous-quantity' WHEN issues <> '' THEN 'ambiguous-quantity' WHEN total IS NULL THEN 'missing-quantity' END"""
PRICED = with_("latest", "parts") + f""", {GROCERIES}, reasons AS (SELECT l.part, l.retailer, l.cents, g.size, g.brand, g.name, g.type, g.unit, g.total, g.title_family, {REASON_SQL} AS reason FROM latest l JOIN groceries g USING (part)),
priced AS (SELECT *, CASE WHEN reason IS NULL THEN CASE WHEN type = 'LARGE' OR unit = 'g' THEN 'mass' WHEN unit = 'ml' THEN 'volume' WHEN title_family = 'toilet_paper' THEN 'roll' ELSE 'item-count' END END AS basis,
CASE WHEN reason IS NULL THEN CASE WHEN title_family = 'toilet_paper' AND type <> 'LARGE' THEN 'approximate' ELSE 'strong' END END AS quality,
CASE WHEN reason IS NULL THEN CASE WHEN type = 'LARGE' THEN cents WHEN unit = 'unit' THEN cents ELSE cents * 1000 END END AS num, CASE WHEN reason IS NULL THEN CASE WHEN type = 'LARGE' THEN 1 ELSE total END END AS den FROM reasons)"""


def priced_offers(spark, sf_dir):
    """The latest offer of each listing with the unit price that its title gives; types sold large are quoted by weight."""
    titled = groceries(spark, sf_dir).select("part", "brand", "name", "size", "title", (F.col("type") == "LARGE").alias("weighed"), attributes(F.col("title")).alias("a"), family(F.col("title")).alias("family"))
    terms = titled.select("part", "brand", "name", "size", "family", "weighed", title_terms(F.col("title"), F.col("a"), F.col("family"), F.col("weighed")).alias("terms"))
    u = priced(F.col("cents"), freshness() == "fresh", F.col("flag") != "R", F.col("terms"))
    return latest_offers(spark, sf_dir).join(terms, "part").withColumn("u", u).select("part", "retailer", "cents", "brand", "name", "size", "family", "weighed", "u.*")


@query("upr01_unit_price", PRICED + " SELECT part, retailer, basis, quality, num, den, reason FROM priced")
def upr01(spark, sf_dir):
    return priced_offers(spark, sf_dir).select("part", "retailer", "basis", "quality", "num", "den", "reason")


@query("upr02_unit_metadata", PRICED + """ SELECT basis, CASE basis WHEN 'mass' THEN 'kg' WHEN 'volume' THEN 'l' WHEN 'roll' THEN 'rollo' WHEN 'item-count' THEN CASE WHEN title_family = 'eggs' THEN 'huevo' ELSE 'unidad' END END AS label, count(*) AS n FROM priced WHERE reason IS NULL GROUP BY 1, 2""")
def upr02(spark, sf_dir):
    """What a price is for, in words; eggs are counted as such."""
    told = priced_offers(spark, sf_dir).where("reason is null").withColumn("eggs", F.split_part("name", F.lit(" "), F.lit(2)) == "ring")
    label = F.when(F.col("basis") == "mass", "kg").when(F.col("basis") == "volume", "l").when(F.col("basis") == "roll", "rollo").when(F.col("eggs"), "huevo").otherwise("unidad")
    return told.groupBy("basis", label.alias("label")).agg(F.count("*").alias("n"))


def exact_key(num: str = "num", den: str = "den"):
    """A decimal that orders fractions as cross-multiplication does."""
    return F.col(num).cast("decimal(23,10)") / F.col(den).cast("decimal(10,0)")


@query("upr03_exact_comparison", PRICED + """, strong AS (SELECT part, retailer, basis, num, den FROM priced WHERE quality = 'strong')
SELECT a.part, a.retailer AS one, b.retailer AS other, CASE WHEN a.num * b.den < b.num * a.den THEN -1 WHEN a.num * b.den > b.num * a.den THEN 1 ELSE 0 END AS sign FROM strong a JOIN strong b ON a.part = b.part AND a.retailer < b.retailer""")
def upr03(spark, sf_dir):
    """Signs of comparison by cross-multiplication, of one product's offers."""
    s = priced_offers(spark, sf_dir).where("quality = 'strong'")
    a = s.select("part", F.col("retailer").alias("one"), F.col("num").alias("n1"), F.col("den").alias("d1"))
    b = s.select("part", F.col("retailer").alias("other"), F.col("num").alias("n2"), F.col("den").alias("d2"))
    left, right = F.col("n1") * F.col("d2"), F.col("n2") * F.col("d1")
    return a.join(b, "part").where("one < other").select("part", "one", "other", F.when(left < right, -1).when(left > right, 1).otherwise(0).alias("sign"))


@query("upr04_half_up_rounding", PRICED + " SELECT part, retailer, (2 * num + den) // (2 * den) AS unit_cents FROM priced WHERE reason IS NULL")
def upr04(spark, sf_dir):
    return priced_offers(spark, sf_dir).where("reason is null").select("part", "retailer", F.expr("(2 * num + den) div (2 * den)").alias("unit_cents"))


@query("upr05_reprice", PRICED + " SELECT part, retailer, num * (cents - cents // 10) AS num, den * cents AS den FROM priced WHERE reason IS NULL AND cents > 0")
def upr05(spark, sf_dir):
    """The unit price at another payable price, a tenth less, as a fraction."""
    return priced_offers(spark, sf_dir).where("reason is null and cents > 0").select("part", "retailer", F.expr("num * (cents - cents div 10)").alias("num"), (F.col("den") * F.col("cents")).alias("den"))


@query("upr06_canonical_unit_price", PRICED + """ SELECT brand, name, size, basis, part, retailer, unit_cents FROM (SELECT *, (2 * num + den) // (2 * den) AS unit_cents,
row_number() OVER (PARTITION BY brand, name, size, basis ORDER BY num * 1000000 // den, part, retailer) AS rn FROM priced WHERE reason IS NULL) WHERE rn = 1""")
def upr06(spark, sf_dir):
    """The lowest unit price of each product by basis, as an aggregate: no row of a product is sorted."""
    given = priced_offers(spark, sf_dir).where("reason is null")
    least = F.min(F.struct(F.expr("num * 1000000 div den").alias("key"), "part", "retailer", F.expr("(2 * num + den) div (2 * den)").alias("unit_cents")))
    return given.groupBy("brand", "name", "size", "basis").agg(least.alias("l")).select("brand", "name", "size", "basis", "l.part", "l.retailer", "l.unit_cents")


@query("upr07_basis_order", PRICED + " SELECT basis, list_position(['mass', 'volume', 'item-count', 'roll'], basis) AS position, count(*) AS n FROM priced WHERE basis IS NOT NULL GROUP BY 1")
def upr07(spark, sf_dir):
    order = F.array(*[F.lit(b) for b in BASES])
    return priced_offers(spark, sf_dir).where("basis is not null").groupBy("basis").agg(F.count("*").alias("n")).select("basis", F.array_position(order, F.col("basis")).alias("position"), "n")


BENEFIT = "benefits AS (SELECT part, retailer, flag AS program, min(cents) AS cents FROM obs WHERE flag IN ('A', 'N') AND seen_at >= TIMESTAMP '2001-01-01' GROUP BY 1, 2, 3)"
BENEFITS = CURRENT + ", " + BENEFIT


def benefits(spark, sf_dir):
    from ..sources.domain import price_observations

    since = F.lit("2001-01-01 00:00:00").cast("timestamp_ntz")
    return price_observations(spark, sf_dir).where(F.col("flag").isin("A", "N") & (F.col("at") >= since)).groupBy("part", "retailer", F.col("flag").alias("program")).agg(F.min("cents").alias("cents"))


@query("con01_current_benefits", BENEFITS + " SELECT b.part, b.retailer, b.program, b.cents FROM benefits b JOIN current c USING (part, retailer)")
def con01(spark, sf_dir):
    """Benefits inside their period, of listings that are current."""
    return benefits(spark, sf_dir).join(current_offers(spark, sf_dir), ["part", "retailer"], "left_semi").select("part", "retailer", "program", "cents")


@query("con02_ranked_price", BENEFITS + """ SELECT c.part, c.retailer, coalesce(min(b.cents) FILTER (WHERE b.cents < c.cents), c.cents) AS ranked,
min_by(b.program, b.cents * 10 + CASE b.program WHEN 'A' THEN 0 ELSE 1 END) FILTER (WHERE b.cents < c.cents) AS program FROM current c LEFT JOIN benefits b ON b.part = c.part AND b.retailer = c.retailer GROUP BY c.part, c.retailer, c.cents""")
def con02(spark, sf_dir):
    """The lowest benefit strictly under the ordinary price, else that."""
    b = benefits(spark, sf_dir).select("part", "retailer", F.struct(F.col("cents").alias("low"), "program").alias("b"))
    joined = current_offers(spark, sf_dir).select("part", "retailer", "cents").join(b, ["part", "retailer"], "left")
    best = F.min(F.when(F.col("b.low") < F.col("cents"), F.col("b")))
    return joined.groupBy("part", "retailer", "cents").agg(best.alias("best")).select("part", "retailer", F.coalesce("best.low", "cents").alias("ranked"), F.col("best.program").alias("program"))
