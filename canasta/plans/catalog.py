"""Normalisation and classification of the titles of all products; the SQL knows each answer from the product's columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions.text import fold_accents, normalize_title
from ..sources.domain import read, with_
from ..sources.groceries import RETAILERS, groceries, sold
from ..sources.groceries import SQL as GROCERIES
from . import query

KNOWN = with_("parts") + ", " + GROCERIES
#: The same titles at each retailer, with the evidence of its category.
SOLD = with_("obs", "parts") + ", " + GROCERIES + f""", sold AS (SELECT g.*, [{", ".join(f"'{r}'" for r in RETAILERS)}][l.retailer + 1] AS retailer FROM (SELECT DISTINCT part, retailer FROM obs) l JOIN groceries g USING (part)),
judged AS (SELECT *, CASE WHEN bundle THEN 'mixed-bundle-or-property/accessory' WHEN retailer = 'plaza-vea' AND category = '439' THEN '439' WHEN retailer = 'metro' AND category = '1000766' THEN '1000766'
WHEN retailer IN ('plaza-vea', 'makro') AND category = '859' THEN 'category-mismatch:859' WHEN family IS NOT NULL THEN 'product-noun:' || family ELSE 'no-confident-product-noun' END AS evidence FROM sold),
classed AS (SELECT *, CASE evidence WHEN '439' THEN 'rice' WHEN '1000766' THEN 'flour' ELSE CASE WHEN starts_with(evidence, 'product-noun') THEN family END END AS sold_family,
CASE WHEN evidence IN ('439', '1000766') THEN 'source-category' WHEN starts_with(evidence, 'product-noun') THEN 'title' END AS origin FROM judged)"""


def normalized(spark, sf_dir):
    """part, title, retail columns and a, the attributes of each title."""
    return groceries(spark, sf_dir).withColumn("a", C.attributes(F.col("title")))


@query("qty05_listing_normalization", KNOWN + " SELECT part, title, quantity, unit, count_, total FROM groceries")
def qty05(spark, sf_dir):
    return normalized(spark, sf_dir).select("part", "title", "a.quantity", "a.unit", F.col("a.count").alias("count_"), "a.total")


def classified(spark, sf_dir):
    """Each product at each retailer with the family that category and title give."""
    return sold(spark, sf_dir).withColumn("f", C.family_evidence(F.col("title"), F.col("retailer"), F.col("category")))


@query("cls01_product_family", SOLD + " SELECT part, retailer, sold_family AS family, origin, evidence FROM classed")
def cls01(spark, sf_dir):
    return classified(spark, sf_dir).select("part", "retailer", "f.family", "f.origin", "f.evidence")


def profiles(spark, sf_dir):
    return groceries(spark, sf_dir).select("part", "title", "list_cents", C.substitution_profile(F.col("title")).alias("profile"))


@query("cls05_substitution_profile", KNOWN + " SELECT part, title_profile AS profile FROM groceries")
def cls05(spark, sf_dir):
    return profiles(spark, sf_dir).select("part", "profile")


@query("cls06_safe_substitutes", KNOWN + """, known_profiles AS (SELECT title_profile, count(*) - 1 AS substitutes, min(list_cents) AS low FROM groceries WHERE title_profile IS NOT NULL GROUP BY 1)
SELECT part, title_profile AS profile, substitutes, list_cents - low AS saving FROM groceries JOIN known_profiles USING (title_profile)""")
def cls06(spark, sf_dir):
    """How many others can stand in for a product and what the cheapest would save; by profile, so no pairs are made."""
    p = profiles(spark, sf_dir).where("profile is not null")
    others = p.groupBy("profile").agg((F.count("*") - 1).alias("substitutes"), F.min("list_cents").alias("low"))
    return p.join(others, "profile").select("part", "profile", "substitutes", (F.col("list_cents") - F.col("low")).alias("saving"))


NEEDS = [("arroz", "kg"), ("huevos", "unit"), ("aceite de girasol", "L"), ("detergente líquido matic", "L"), ("leche", "L"), ("aceite", "L")]
NEED_ROWS = "needs AS (SELECT * FROM (VALUES ('arroz', 'rice:white'), ('huevos', 'eggs:regular'), ('aceite de girasol', 'oil:sunflower'), ('detergente líquido matic', 'detergent:liquid:machine'), ('leche', NULL), ('aceite', 'oil:vegetable')) t(need, profile))"


def need_profile(query_, unit):
    """The profile that a need names, else that of bare oil or detergent by its unit."""
    plain = normalize_title(query_)
    bare = F.when(plain == "aceite", "oil:vegetable").when((plain == "detergente") & (unit == "L"), "detergent:liquid").when((plain == "detergente") & (unit == "kg"), "detergent:powder")
    return F.coalesce(C.substitution_profile(query_), bare)


@query("cls08_need_compatibility", KNOWN + ", " + NEED_ROWS + " SELECT need, count(*) AS n, min(g.part) AS first_part FROM needs n JOIN groceries g ON g.title_profile = n.profile GROUP BY 1")
def cls08(spark, sf_dir):
    """Needs (a fixed few) and the products of the profile that each infers."""
    needs = spark.createDataFrame(NEEDS, "need string, unit string").select("need", need_profile(F.col("need"), F.col("unit")).alias("profile"))
    return profiles(spark, sf_dir).join(F.broadcast(needs), "profile").groupBy("need").agg(F.count("*").alias("n"), F.min("part").alias("first_part"))


@query("cls04_family_selection", SOLD + " SELECT sold_family AS family, CASE origin WHEN 'source-category' THEN 0 ELSE 1 END AS tier, retailer, count(*) AS n, min(title) AS first_title FROM classed WHERE sold_family IS NOT NULL GROUP BY 1, 2, 3")
def cls04(spark, sf_dir):
    """Members of each family, those that a category tells before those of a title."""
    members = classified(spark, sf_dir).where("f.family is not null")
    tier = F.when(F.col("f.origin") == "source-category", 0).otherwise(1)
    return members.groupBy(F.col("f.family").alias("family"), tier.alias("tier"), "retailer").agg(F.count("*").alias("n"), F.min("title").alias("first_title"))


@query("cls03_family_prefilter", SOLD + " SELECT part, retailer FROM sold WHERE noun = 'widget' OR (retailer = 'plaza-vea' AND category IN ('439', '440', '442')) OR (retailer = 'metro' AND category IN ('1001283', '1001284', '1001285'))")
def cls03(spark, sf_dir):
    """Listings that may be rice, by hint in the title or leaf category."""
    listed = [f"{r}/{c}" for r, own in C.CATEGORIES.items() for c in own.get("rice", "").split()]
    hint = fold_accents(F.lower("title")).contains("arroz")
    return sold(spark, sf_dir).where(hint | F.concat_ws("/", "retailer", "category").isin(listed)).select("part", "retailer")


@query("qty01_unit_alias", KNOWN + """ SELECT unit, count(*) AS n FROM (SELECT CASE u WHEN 'un' THEN 'unit' ELSE u END AS unit FROM groceries UNION ALL
SELECT CASE v WHEN 'un' THEN 'unit' ELSE v END FROM groceries WHERE two) GROUP BY 1""")
def qty01(spark, sf_dir):
    """The base units that the words of all titles name."""
    words = F.explode(F.regexp_extract_all(normalize_title(F.col("title")), F.lit(r"\d\s*(\p{L}+)"), F.lit(1)))
    return groceries(spark, sf_dir).select(words.alias("raw")).select(C.unit_of(F.col("raw")).alias("unit")).where("unit is not null").groupBy("unit").agg(F.count("*").alias("n"))


@query("qty02_base_conversion", """WITH v AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_discount AS DECIMAL(18,2)) AS VARCHAR) AS value, CASE l_returnflag WHEN 'R' THEN 'kg' WHEN 'A' THEN 'l' ELSE 'g' END AS unit FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN CAST(value AS DECIMAL(18,6)) > 0 AND (CAST(value AS DECIMAL(18,6)) * CASE unit WHEN 'g' THEN 1 ELSE 1000 END) % 1 = 0 THEN CAST(CAST(value AS DECIMAL(18,6)) * CASE unit WHEN 'g' THEN 1 ELSE 1000 END AS BIGINT) END AS base FROM v""")
def qty02(spark, sf_dir):
    """Written decimals in grams or millilitres; null where that is no whole number."""
    unit = F.when(F.col("l_returnflag") == "R", "kg").when(F.col("l_returnflag") == "A", "l").otherwise("g")
    value = F.col("l_discount").cast("decimal(18,2)").cast("string")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.base_quantity(value, unit)["value"].alias("base"))


@query("qty03_quantity_extraction", KNOWN + """ SELECT part, CAST(base AS VARCHAR) || base_unit || CASE WHEN two THEN ',' || CAST((size + 1) * CASE WHEN v IN ('kg', 'l') THEN 1000 ELSE 1 END AS VARCHAR) ||
CASE WHEN v IN ('kg', 'g') THEN 'g' WHEN v IN ('l', 'ml') THEN 'ml' ELSE 'unit' END ELSE '' END AS found FROM groceries""")
def qty03(spark, sf_dir):
    told = F.transform(C.quantities(normalize_title(F.col("title"))), lambda q: F.concat(q["value"].cast("string"), q["unit"]))
    return groceries(spark, sf_dir).select("part", F.array_join(told, ",").alias("found"))


@query("qty04_pack_counts", KNOWN + " SELECT part, coalesce(CAST(packs AS VARCHAR), '') AS counts FROM groceries")
def qty04(spark, sf_dir):
    text = normalize_title(F.col("title"))
    measured = F.exists(C.quantities(text), lambda q: q["unit"] != "unit")
    return groceries(spark, sf_dir).select("part", F.array_join(C.pack_counts(text, measured).cast("array<string>"), ",").alias("counts"))


@query("qty06_issue_taxonomy", KNOWN + " SELECT part, issues FROM groceries")
def qty06(spark, sf_dir):
    return normalized(spark, sf_dir).select("part", F.array_join("a.issues", ",").alias("issues"))


@query("qty07_quality_counters", KNOWN + """ SELECT brand, count(*) AS titles, count(quantity) AS with_quantity, count(total) AS with_total, count(*) FILTER (WHERE quantity IS NULL) AS unresolved,
count(*) FILTER (WHERE issues <> '') AS with_issues FROM groceries GROUP BY 1""")
def qty07(spark, sf_dir):
    n = lambda c: F.count_if(F.col(c).isNotNull())
    return normalized(spark, sf_dir).groupBy("brand").agg(
        F.count("*").alias("titles"), n("a.quantity").alias("with_quantity"), n("a.total").alias("with_total"), F.count_if(F.col("a.quantity").isNull()).alias("unresolved"),
        F.count_if(F.size("a.issues") > 0).alias("with_issues"),
    )


@query("qty08_shopping_unit", KNOWN + " SELECT CASE unit WHEN 'g' THEN 'kg' WHEN 'ml' THEN 'L' WHEN 'unit' THEN 'unit' END AS shopping, count(*) AS n, CAST(sum(total) AS BIGINT) AS total FROM groceries GROUP BY 1")
def qty08(spark, sf_dir):
    shopping = F.when(F.col("a.unit") == "g", "kg").when(F.col("a.unit") == "ml", "L").when(F.col("a.unit") == "unit", "unit")
    return normalized(spark, sf_dir).groupBy(shopping.alias("shopping")).agg(F.count("*").alias("n"), F.sum("a.total").alias("total"))


@query("str10_dictionary_brand", KNOWN + " SELECT part, own_brand AS brand FROM groceries")
def str10(spark, sf_dir):
    return groceries(spark, sf_dir).select("part", C.title_brand(F.col("title")).alias("brand"))


@query("str12_comparison_title", KNOWN + " SELECT part, trim(regexp_replace(concat_ws(' ', compared, container_kept, replace(pack_kept, '{u}', u)), ' +', ' ', 'g')) AS compared FROM groceries")
def str12(spark, sf_dir):
    return groceries(spark, sf_dir).select("part", C.comparison_title(F.col("title"), C.title_brand(F.col("title"))).alias("compared"))


@query("hlp02_market_query", "SELECT DISTINCT p_name AS name, CASE WHEN split_part(p_name, ' ', 2) IN ('widget', 'gear') THEN split_part(p_name, ' ', 2) ELSE p_name END AS query FROM part")
def hlp02(spark, sf_dir):
    """The family noun where there is one, the text itself otherwise."""
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    return read(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.when(noun.isin("widget", "gear"), noun).otherwise(F.col("p_name")).alias("query")).distinct()
