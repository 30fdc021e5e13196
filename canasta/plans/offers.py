"""Current offers: latest rows, freshness, admission, ties and comparison of products."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.domain import latest_offers, parts, price_observations, read, with_
from . import query

#: The evaluation time and the freshness window of the driver data, in days.
NOW = "2001-11-04 00:00:00"
FRESH_DAYS = 180
VISIBLE_DAYS = 360

AGE = f"date_diff('day', seen_at, TIMESTAMP '{NOW}')"
FRESHNESS = f"CASE WHEN {AGE} < 0 THEN 'too-stale' WHEN {AGE} <= {FRESH_DAYS} THEN 'fresh' WHEN {AGE} <= {VISIBLE_DAYS} THEN 'stale' ELSE 'too-stale' END"


def age_days(at: str = "at"):
    return F.datediff(F.lit(NOW).cast("timestamp_ntz"), F.col(at)).cast("long")


def freshness(at: str = "at"):
    """fresh up to one bound, stale up to another, too stale beyond or in the future."""
    age = age_days(at)
    return F.when(age < 0, "too-stale").when(age <= FRESH_DAYS, "fresh").when(age <= VISIBLE_DAYS, "stale").otherwise("too-stale")


def fresh_offers(spark, sf_dir):
    return latest_offers(spark, sf_dir).where(freshness() == "fresh").where("cents > 0")


FRESH = with_("latest", "parts") + f", fresh AS (SELECT * FROM latest WHERE {FRESHNESS} = 'fresh' AND cents > 0)"


@query("cheapest_offer_by_product", FRESH + """
SELECT f.part, p.name, f.retailer, f.cents FROM fresh f JOIN parts p USING (part)
JOIN (SELECT part, min(cents) AS low, count(DISTINCT retailer) AS n FROM fresh GROUP BY part) g ON g.part = f.part AND g.low = f.cents WHERE g.n >= 2""")
def cheapest_offer_by_product(spark, sf_dir):
    """Every cheapest fresh offer, ties included, of products at two retailers or more."""
    w = Window.partitionBy("part")
    offers = fresh_offers(spark, sf_dir).withColumns({"low": F.min("cents").over(w), "n": F.count("*").over(w)})
    return offers.where("cents = low and n >= 2").join(parts(spark, sf_dir), "part").select("part", "name", "retailer", "cents")


@query("jon07_latest_row", with_("latest") + " SELECT part, retailer, cents, CAST(seen_at AS DATE) AS day, n_seen FROM latest")
def jon07(spark, sf_dir):
    """The lateral latest row of each listing."""
    return latest_offers(spark, sf_dir).select("part", "retailer", "cents", F.col("at").cast("date").alias("day"), "n_seen")


@query("elg01_offer_freshness", with_("latest") + f" SELECT retailer, {FRESHNESS} AS freshness, count(*) AS n FROM latest GROUP BY 1, 2")
def elg01(spark, sf_dir):
    return latest_offers(spark, sf_dir).groupBy("retailer", freshness().alias("freshness")).agg(F.count("*").alias("n"))


@query("elg02_retailer_freshness", with_("ev") + """, last AS (SELECT listing % 4 AS retailer, max(seen_at) FILTER (WHERE type = 'purchase') AS seen_at FROM ev GROUP BY 1)
SELECT retailer, CASE WHEN seen_at IS NULL THEN 'unknown' WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(seen_at) <= 18 * 3600000000 THEN 'healthy'
WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(seen_at) <= 30 * 3600000000 THEN 'delayed' ELSE 'stale' END AS state FROM last""")
def elg02(spark, sf_dir):
    """Hours since the last successful run: healthy up to 18, delayed up to 30."""
    from ..sources.domain import event_observations

    last = event_observations(spark, sf_dir).groupBy((F.col("listing") % 4).alias("retailer")).agg(F.max(F.when(F.col("type") == "purchase", F.col("at"))).alias("at"))
    age = F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))
    state = F.when(F.col("at").isNull(), "unknown").when(age <= 18 * 3_600_000_000, "healthy").when(age <= 30 * 3_600_000_000, "delayed").otherwise("stale")
    return last.select("retailer", state.alias("state"))


CURRENT = FRESH + ", current AS (SELECT f.*, p.name, p.brand, p.type, p.size, p.list_cents FROM fresh f JOIN parts p USING (part) WHERE f.flag <> 'R')"


def current_offers(spark, sf_dir):
    """Fresh, payable offers that were not returned, with their product's attributes."""
    return fresh_offers(spark, sf_dir).where("flag <> 'R'").join(parts(spark, sf_dir), "part")


@query("elg03_current_offers", CURRENT + " SELECT part, retailer, cents, name, brand, size FROM current")
def elg03(spark, sf_dir):
    return current_offers(spark, sf_dir).select("part", "retailer", "cents", "name", "brand", "size")


ADMITTED = CURRENT + """, bad AS (SELECT DISTINCT p.brand, p.name, p.size FROM fresh f JOIN parts p USING (part) WHERE f.flag = 'R'),
admitted AS (SELECT c.brand, c.name, c.size FROM current c LEFT JOIN bad b ON b.brand = c.brand AND b.name = c.name AND b.size = c.size
WHERE b.brand IS NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT c.retailer) >= 2)"""
KEY = ["brand", "name", "size"]


def admitted_products(spark, sf_dir):
    """Products at two retailers or more, of which no member is bad."""
    bad = fresh_offers(spark, sf_dir).where("flag = 'R'").join(parts(spark, sf_dir), "part").select(*KEY).distinct()
    good = current_offers(spark, sf_dir).join(bad, KEY, "left_anti")
    return good.groupBy(*KEY).agg(F.count_distinct("retailer").alias("n")).where("n >= 2").select(*KEY)


@query("elg05_canonical_admission", ADMITTED + " SELECT brand, name, size FROM admitted")
def elg05(spark, sf_dir):
    return admitted_products(spark, sf_dir)


@query("elg06_eligible_products", ADMITTED + """ SELECT brand, name, size, min(cents) AS low, count(*) AS n_offers,
string_agg(retailer || ':' || cents, ',' ORDER BY retailer, cents, part) AS offers FROM current JOIN admitted USING (brand, name, size) GROUP BY 1, 2, 3""")
def elg06(spark, sf_dir):
    """Admitted products with their offers in order."""
    offers = current_offers(spark, sf_dir).join(admitted_products(spark, sf_dir), KEY)
    told = F.transform(F.array_sort(F.collect_list(F.struct("retailer", "cents", "part"))), lambda o: F.concat_ws(":", o["retailer"], o["cents"]))
    return offers.groupBy(*KEY).agg(F.min("cents").alias("low"), F.count("*").alias("n_offers"), F.array_join(told, ",").alias("offers"))


@query("sea10_product_comparison", ADMITTED + """, ranked AS (SELECT *, rank() OVER (PARTITION BY brand, name, size ORDER BY cents) AS place,
min(cents) OVER (PARTITION BY brand, name, size) AS low FROM current JOIN admitted USING (brand, name, size))
SELECT brand, name, size, part, retailer, cents, place, cents = low AS cheapest, cents - low AS more_cents FROM ranked""")
def sea10(spark, sf_dir):
    """Each offer of a product against the cheapest, ties sharing the first place."""
    w = Window.partitionBy(*KEY)
    offers = current_offers(spark, sf_dir).join(admitted_products(spark, sf_dir), KEY)
    low = F.min("cents").over(w)
    return offers.select(*KEY, "part", "retailer", "cents", F.rank().over(w.orderBy("cents")).cast("long").alias("place"), (F.col("cents") == low).alias("cheapest"), (F.col("cents") - low).alias("more_cents"))


@query("sea11_cheapest_ties", FRESH + " SELECT part, retailer, cents FROM (SELECT *, min(cents) OVER (PARTITION BY part) AS low FROM fresh) WHERE cents = low")
def sea11(spark, sf_dir):
    return fresh_offers(spark, sf_dir).withColumn("low", F.min("cents").over(Window.partitionBy("part"))).where("cents = low").select("part", "retailer", "cents")


@query("sea12_reference_price", FRESH + " SELECT f.part, f.retailer, f.cents, CASE WHEN p.list_cents > f.cents THEN p.list_cents END AS reference FROM fresh f JOIN parts p USING (part)")
def sea12(spark, sf_dir):
    """A reference price counts only above the current one."""
    return fresh_offers(spark, sf_dir).join(parts(spark, sf_dir), "part").select("part", "retailer", "cents", F.when(F.col("list_cents") > F.col("cents"), F.col("list_cents")).alias("reference"))


@query("sea13_home_example", ADMITTED + " SELECT brand, name, size FROM admitted ORDER BY name, brand, size LIMIT 1")
def sea13(spark, sf_dir):
    return admitted_products(spark, sf_dir).orderBy("name", "brand", "size").limit(1)


@query("sea14_product_by_id", CURRENT + " SELECT part, retailer, cents, name, brand FROM current WHERE part = 42")
def sea14(spark, sf_dir):
    return current_offers(spark, sf_dir).where("part = 42").select("part", "retailer", "cents", "name", "brand")


@query("sea15_listing_detail", with_("latest", "parts") + f""" SELECT l.part, l.retailer, p.name, l.cents, CAST(l.seen_at AS DATE) AS day,
{FRESHNESS} = 'fresh' AS current_offer, {FRESHNESS} <> 'fresh' AS historical_only FROM latest l JOIN parts p USING (part)""")
def sea15(spark, sf_dir):
    """The latest state of each listing, whether it is open or only history."""
    fresh = freshness() == "fresh"
    return latest_offers(spark, sf_dir).join(parts(spark, sf_dir), "part").select("part", "retailer", "name", "cents", F.col("at").cast("date").alias("day"), fresh.alias("current_offer"), (~fresh).alias("historical_only"))


@query("sea16_overflow_sentinel", CURRENT + " SELECT count(*) AS n, count(*) > 50000 AS overflow FROM current")
def sea16(spark, sf_dir):
    return current_offers(spark, sf_dir).agg(F.count("*").alias("n"), (F.count("*") > 50_000).alias("overflow"))


@query("jon01_inner_join", """SELECT s_suppkey AS supplier, n_name AS nation, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def jon01(spark, sf_dir):
    return (read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("supplier"), F.col("n_name").alias("nation"), F.col("r_name").alias("region")))


@query("jon02_left_join", FRESH + " SELECT p.part, count(f.part) AS n_fresh FROM parts p LEFT JOIN fresh f USING (part) GROUP BY 1")
def jon02(spark, sf_dir):
    counted = fresh_offers(spark, sf_dir).groupBy("part").agg(F.count("*").alias("n"))
    return parts(spark, sf_dir).join(counted, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n_fresh"))


@query("jon03_composite_key", with_("obs", "latest") + " SELECT o.part, o.retailer, count(*) AS n_same FROM obs o JOIN latest l ON o.part = l.part AND o.retailer = l.retailer AND o.cents = l.cents GROUP BY 1, 2")
def jon03(spark, sf_dir):
    return price_observations(spark, sf_dir).join(latest_offers(spark, sf_dir), ["part", "retailer", "cents"]).groupBy("part", "retailer").agg(F.count("*").alias("n_same"))


@query("jon04_semi_join", FRESH + " SELECT part, name FROM parts WHERE EXISTS (SELECT 1 FROM fresh f WHERE f.part = parts.part)")
def jon04(spark, sf_dir):
    return parts(spark, sf_dir).join(fresh_offers(spark, sf_dir), "part", "left_semi").select("part", "name")


@query("jon05_anti_join", FRESH + " SELECT part, name FROM parts WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.part = parts.part)")
def jon05(spark, sf_dir):
    return parts(spark, sf_dir).join(fresh_offers(spark, sf_dir), "part", "left_anti").select("part", "name")


@query("jon12_self_join", with_("parts") + " SELECT a.part AS one, b.part AS other FROM parts a JOIN parts b ON a.brand = b.brand AND a.name = b.name AND a.part < b.part")
def jon12(spark, sf_dir):
    p = parts(spark, sf_dir)
    a, b = p.select(F.col("part").alias("one"), "brand", "name"), p.select(F.col("part").alias("other"), "brand", "name")
    return a.join(b, ["brand", "name"]).where("one < other").select("one", "other")


@query("jon13_null_safe_join", with_("ev") + """, k AS (SELECT listing, day, max(band) FILTER (WHERE available) AS band FROM ev GROUP BY 1, 2)
SELECT a.listing, count(*) AS n_same FROM k a JOIN k b ON a.listing = b.listing AND b.day = a.day + 1 AND a.band IS NOT DISTINCT FROM b.band GROUP BY 1""")
def jon13(spark, sf_dir):
    """Days whose best band, unknown included, equals the next day's."""
    from ..sources.domain import event_observations

    k = event_observations(spark, sf_dir).groupBy("listing", "day").agg(F.max(F.when(F.col("available"), F.col("band"))).alias("band"))
    b = k.select(F.col("listing").alias("l"), F.date_sub("day", 1).alias("d"), F.col("band").alias("next"))
    return k.join(b, (F.col("listing") == F.col("l")) & (F.col("day") == F.col("d")) & F.col("band").eqNullSafe(F.col("next"))).groupBy("listing").agg(F.count("*").alias("n_same"))


@query("jon14_benefit_array", with_("latest") + """, b AS (SELECT part, retailer, string_agg(ok || ':' || cents, ',' ORDER BY ok, ln) AS benefits FROM obs WHERE flag = 'A' GROUP BY 1, 2)
SELECT l.part, l.retailer, coalesce(b.benefits, '') AS benefits FROM latest l LEFT JOIN b USING (part, retailer)""")
def jon14(spark, sf_dir):
    """An ordered array for each listing, aggregated before the join."""
    told = F.transform(F.array_sort(F.collect_list(F.struct("ok", "ln", "cents"))), lambda x: F.concat_ws(":", x["ok"], x["cents"]))
    b = price_observations(spark, sf_dir).where("flag = 'A'").groupBy("part", "retailer").agg(F.array_join(told, ",").alias("b"))
    return latest_offers(spark, sf_dir).join(b, ["part", "retailer"], "left").select("part", "retailer", F.coalesce("b", F.lit("")).alias("benefits"))


@query("rdm05_bounded_sample", CURRENT + " SELECT part, retailer, cents FROM (SELECT *, row_number() OVER (PARTITION BY retailer ORDER BY part) AS rn FROM current) WHERE rn <= 20")
def rdm05(spark, sf_dir):
    """Twenty listings of each retailer, by identity."""
    rank = F.row_number().over(Window.partitionBy("retailer").orderBy("part"))
    return current_offers(spark, sf_dir).withColumn("rn", rank).where("rn <= 20").select("part", "retailer", "cents")


@query("src18_catalog_sample", CURRENT + " SELECT retailer, part, cents FROM current WHERE retailer = 1 ORDER BY retailer, part LIMIT 50")
def src18(spark, sf_dir):
    return current_offers(spark, sf_dir).where("retailer = 1").orderBy("retailer", "part").limit(50).select("retailer", "part", "cents")


@query("cls09_category_membership", FRESH + " SELECT lower(trim(split_part(type, ' ', 1))) AS department, count(*) AS n FROM parts WHERE part IN (SELECT part FROM fresh) GROUP BY 1")
def cls09(spark, sf_dir):
    """Listings with a fresh offer by the folded first segment of their category."""
    members = parts(spark, sf_dir).join(fresh_offers(spark, sf_dir), "part", "left_semi")
    return members.groupBy(F.lower(F.trim(F.split_part(F.col("type"), F.lit(" "), F.lit(1)))).alias("department")).agg(F.count("*").alias("n"))
