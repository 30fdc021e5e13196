"""Landed pages and streams: parsers over the landing zone, page extraction, and the streamed states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import parse_pen
from ..session import shared_path
from ..sources import landed as L
from ..sources import landing_zone as Z
from ..sources.domain import price_observations, read, with_
from . import query


LAST = with_("obs", "parts") + """, last_ AS (SELECT l.*, p.* EXCLUDE (part), l.part * 4 + l.retailer AS id, l.part // 20 AS page FROM (SELECT *, row_number() OVER (PARTITION BY part, retailer ORDER BY seen_at DESC, ok DESC, ln DESC, flag DESC, cents DESC) AS rn FROM obs) l JOIN parts p USING (part) WHERE rn = 1)"""


def storefront_sql(retailer: str, label: str) -> str:
    """What a storefront's parser must find: rows of whole pages, and one for the page that is cut off."""
    return LAST + f""", judged AS (SELECT *, CASE WHEN ln = 5 THEN 'error:url' WHEN ln = 7 THEN 'error:two-offers' WHEN ln = 4 THEN 'skip:no-seller' WHEN flag = 'R' THEN 'skip:unavailable' WHEN ln = 3 THEN 'error:zero-price' WHEN ln = 6 AND size > 10 THEN 'error:multiplier' ELSE 'observed' END AS verdict FROM last_ WHERE retailer = {Z.RETAILERS[retailer]})
SELECT page, CAST(id AS VARCHAR) AS external_id, name AS title, CASE WHEN size <= 10 THEN 'KG' ELSE 'UN' END AS unit, '{label}' || type || CASE WHEN size <= 10 THEN '; unitMultiplier: 0.5 kg' ELSE '' END AS package, verdict, CASE WHEN verdict = 'observed' THEN cents END AS cents,
CASE WHEN verdict = 'observed' AND list_cents > cents THEN list_cents END AS regular_cents FROM judged WHERE page > 0 UNION ALL SELECT DISTINCT 0, NULL, NULL, NULL, NULL, 'corrupt', NULL, NULL FROM judged WHERE page = 0"""


@query("src01_product_page", storefront_sql("metro", "Envase: "))
def src01(spark, sf_dir):
    """All landed pages of one storefront, with prices or reasons, corrupt pages told."""
    return L.product_page(Z.storefront_pages(spark, sf_dir, "metro"), "metro")


@query("src02_storefront_page", storefront_sql("plaza-vea", "").replace("SELECT page, CAST(id", "SELECT 'plaza-vea' AS storefront, page, CAST(id").replace("SELECT DISTINCT 0,", "SELECT DISTINCT 'plaza-vea', 0,")
       + " UNION ALL " + "SELECT * FROM (" + storefront_sql("makro", "").replace("SELECT page, CAST(id", "SELECT 'makro' AS storefront, page, CAST(id").replace("SELECT DISTINCT 0,", "SELECT DISTINCT 'makro', 0,") + ")")
def src02(spark, sf_dir):
    """All landed pages of the two storefronts of another chain, which tell the package in one field, each with its own site."""
    rows = [L.product_page(Z.storefront_pages(spark, sf_dir, r), r).select(F.lit(r).alias("storefront"), "*") for r in ("plaza-vea", "makro")]
    return rows[0].union(rows[1])


@query("src03_hydration_page", LAST + """ SELECT page, CASE WHEN page = 0 THEN 'corrupt' ELSE 'read' END AS state, CASE WHEN page > 0 THEN page END AS number, CASE WHEN page > 0 THEN count(*) END AS discovered, CASE WHEN page > 0 THEN count(*) FILTER (WHERE ln = 4) END AS skipped FROM last_ WHERE retailer = 0 GROUP BY page""")
def src03(spark, sf_dir):
    """What the data script of each landed page holds: products found, and those skipped for want of a unit."""
    pages = L.hydration_rows(Z.hydration_pages(spark, sf_dir))
    read_ = F.col("state") == "read"
    without = F.size(F.filter("results", lambda r: r["measurements"]["unit"].isNull()))
    return pages.select("page", "state", F.col("number").cast("long").alias("number"), F.when(read_, F.size("results").cast("long")).alias("discovered"), F.when(read_, without.cast("long")).alias("skipped"))


@query("src04_product_normalise", LAST + """, judged AS (SELECT *, CASE WHEN ln = 4 THEN 'skip:no-unit' WHEN ln IN (3, 7) THEN 'error:price' WHEN ln = 6 THEN 'error:currency' WHEN ln = 5 THEN 'error:url' ELSE 'observed' END AS verdict FROM last_ WHERE retailer = 0 AND page > 0)
SELECT CAST(id AS VARCHAR) AS external_id, name AS title, verdict, CASE WHEN verdict = 'observed' THEN cents END AS cents, CASE WHEN verdict = 'observed' AND list_cents > cents THEN list_cents END AS regular_cents, CASE WHEN verdict = 'observed' AND type = 'PROMO' AND cents * 9 // 10 > 0 THEN cents * 9 // 10 END AS benefit_cents FROM judged""")
def src04(spark, sf_dir):
    """Each product of the landed pages: one uncrossed price, one normal price at most, and the card's price where it is a benefit."""
    return L.hydration_page(Z.hydration_pages(spark, sf_dir)).select("external_id", "title", "verdict", "cents", "regular_cents", "benefit_cents")


@query("src04_page_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '<li>')) AS items FROM pages")
def src04_titles(spark, sf_dir):
    """Extraction from raw pages by patterns."""
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_count("html", F.lit("<li>")).cast("long").alias("items"))


@query("src06_money_parse", with_("obs") + " SELECT ok, ln, CASE WHEN flag <> 'R' THEN cents END AS cents FROM obs")
def src06(spark, sf_dir):
    """Every price as text and back: with the currency's sign, with groups of thousands, and with a third decimal, which no price has."""
    o = price_observations(spark, sf_dir)
    plain = Z.number(F.col("cents")).cast("string")
    text = F.when(F.col("flag") == "R", F.concat(plain, F.lit("0"))).when(F.col("flag") == "A", F.concat(F.lit("S/ "), plain)).otherwise(Z.money(F.col("cents")))
    return o.select("ok", "ln", parse_pen(text).alias("cents"))


@query("src07_listing_validation", with_("obs") + """ SELECT o.part, o.retailer, o.ok, o.ln, CASE WHEN cents <= 0 THEN 'price' WHEN ln > 6 THEN 'currency' WHEN flag = 'R' THEN 'unit' WHEN part % 50 = 0 THEN 'url' END AS reject FROM obs o""")
def src07(spark, sf_dir):
    from ..sources.domain import price_observations

    o = price_observations(spark, sf_dir)
    reject = L.reject_reason(F.col("cents"), F.when(F.col("ln") > 6, "USD").otherwise("PEN"), F.when(F.col("flag") == "R", "LB").otherwise("UN"), F.concat(F.when(F.col("part") % 50 == 0, "http").otherwise("https"), F.lit("://shop.pe/p")), F.lit("title"))
    return o.select("part", "retailer", "ok", "ln", reject.alias("reject"))


DEPARTMENTS = tuple(f"Brand#{i}" for i in range(1, 13))


@query("src09_category_tree", with_("parts") + f""" SELECT type || '/' || split_part(name, ' ', 2) AS key, max(brand || ' / ' || type || ' / ' || split_part(name, ' ', 2)) AS path FROM parts WHERE brand IN ({', '.join(f"'{d}'" for d in DEPARTMENTS)}) GROUP BY 1""")
def src09(spark, sf_dir):
    """The leaves of the landed trees in the departments that are sold, each key once, the last path of it."""
    return L.category_leaves(Z.category_trees(spark, sf_dir), allowed=DEPARTMENTS)


@query("src12_page_ranges", "SELECT page_id, page_id * 20 AS from_, least(page_id * 20 + 19, 2519) AS to_, page_id * 20 > 2500 AS coverage_limited FROM pages")
def src12(spark, sf_dir):
    start = F.col("page_id") * 20
    return read(spark, sf_dir, "pages").select("page_id", start.alias("from_"), F.least(start + 19, F.lit(2519)).alias("to_"), (start > 2500).alias("coverage_limited"))


@query("src14_lookup_outcome", with_("latest") + """ SELECT p_partkey AS part, r.retailer, CASE WHEN l.part IS NULL THEN 'not-found' WHEN l.cents <= 0 THEN 'error' WHEN l.flag = 'R' THEN 'unavailable' ELSE 'observed' END AS outcome, CASE WHEN l.flag <> 'R' AND l.cents > 0 THEN l.cents END AS cents
FROM part CROSS JOIN (VALUES (0), (1), (2), (3)) r(retailer) LEFT JOIN latest l ON l.part = p_partkey AND l.retailer = r.retailer""")
def src14(spark, sf_dir):
    """Each product looked up at each of the four retailers: what is found, or that it is not; a price of nothing is an error, no absence."""
    from ..sources.domain import latest_offers

    asked = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.explode(F.array(*[F.lit(r).cast("long") for r in range(4)])).alias("retailer"))
    found = asked.join(latest_offers(spark, sf_dir), ["part", "retailer"], "left")
    outcome = F.when(F.col("at").isNull(), "not-found").when(F.col("cents") <= 0, "error").when(F.col("flag") == "R", "unavailable").otherwise("observed")
    return found.select("part", "retailer", outcome.alias("outcome"), F.when(outcome == "observed", F.col("cents")).alias("cents"))


@query("src15_bounded_search", with_("obs", "parts") + """, f AS (SELECT part, retailer, min(ok * 10 + ln) AS position, max_by(cents, (ok * 10 + ln) * 1000000000 + cents) AS cents FROM obs GROUP BY 1, 2)
SELECT part, retailer, cents FROM f JOIN parts USING (part) ORDER BY name NOT LIKE '%widget%', position, part, retailer LIMIT 60""")
def src15(spark, sf_dir):
    """Each listing once, at its first position with its last value; relevant ones first; the first sixty."""
    from ..sources.domain import parts, price_observations

    at = F.col("ok") * 10 + F.col("ln")
    f = price_observations(spark, sf_dir).groupBy("part", "retailer").agg(F.min(at).alias("position"), F.max_by("cents", F.struct(at, "cents")).alias("cents"))
    return f.join(parts(spark, sf_dir), "part").orderBy(~F.col("name").contains("widget"), "position", "part", "retailer").limit(60).select("part", "retailer", "cents")


@query("src17_coverage_union", with_("parts") + " SELECT brand, name, size, max_by(part, type || lpad(CAST(part AS VARCHAR), 20, '0')) AS part, max(type) AS category, count(DISTINCT type) AS n_categories, count(*) AS n FROM parts GROUP BY 1, 2, 3")
def src17(spark, sf_dir):
    """All categories (types, in order) in one union; a later category's product overwrites an earlier one's of the same SKU (brand, name and size)."""
    from ..sources.domain import parts

    last = F.max(F.struct("type", "part"))
    return parts(spark, sf_dir).groupBy("brand", "name", "size").agg(last.alias("l"), F.count_distinct("type").alias("n_categories"), F.count("*").alias("n")).select("brand", "name", "size", "l.part", F.col("l.type").alias("category"), "n_categories", "n")


@query("snk02_list_export", """SELECT o_orderkey AS list, '{"version":2,"status":"' || o_orderstatus || '","items":' || n || '}' AS exported FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def snk02(spark, sf_dir):
    """Lists as canonical JSON."""
    n = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("items"))
    row = F.struct(F.lit(2).alias("version"), F.col("o_orderstatus").alias("status"), "items")
    return read(spark, sf_dir, "orders").join(n, "o_orderkey").select(F.col("o_orderkey").alias("list"), F.to_json(row).alias("exported"))


@query("str_ing02_streamed_states", with_("changes") + " SELECT listing, epoch_us(valid_from) AS from_us, band, previous_band FROM changes")
def streamed_states(spark, sf_dir):
    """The stateful fold over the event stream gives the batch's changes."""
    from ..streaming import ingest

    folder = shared_path(spark, "stream")
    ingest.run_once(ingest.price_changes(ingest.event_stream(spark, sf_dir)), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select("listing", F.unix_micros("valid_from").alias("from_us"), "band", "previous_band")
