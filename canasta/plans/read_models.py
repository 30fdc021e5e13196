"""Read models, contracts and the remaining helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import catalog as C
from ..functions.text import normalize_title, parse_pen, search_text
from ..session import shared_path
from ..sources import landed, landing_zone
from ..sources.domain import event_observations, latest_offers, parts, price_observations, price_states, read, with_
from ..sources.groceries import SQL as GROCERIES
from ..sources.groceries import groceries
from . import query, values
from .catalog import need_profile
from .offers import CURRENT, FRESHNESS, current_offers, freshness
from .states import coverage_days, micros, usable
from .unit_prices import PRICED, priced_offers


@query("src05_grouped_price", "SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(18,6)) * 100) AS BIGINT) AS cents FROM lineitem")
def src05(spark, sf_dir):
    """Amounts as storefronts write them, thousands grouped, read back as cents."""
    told = F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", parse_pen(told).alias("cents"))


@query("src08_benefit_validation", with_("obs") + """, p AS (SELECT *, max(seen_at) OVER (PARTITION BY part, retailer) AS ends FROM obs)
SELECT part, retailer, ok, ln, CASE WHEN flag NOT IN ('A', 'N') THEN 'type' WHEN cents <= 0 THEN 'price' WHEN seen_at >= ends THEN 'period' END AS reject FROM p""")
def src08(spark, sf_dir):
    """Only two kinds of benefit, a positive price, and a start before the end, which is the listing's last sight."""
    o = price_observations(spark, sf_dir)
    ends = o.groupBy("part", "retailer").agg(F.max("at").alias("ends"))
    reject = F.when(~F.col("flag").isin("A", "N"), "type").when(F.col("cents") <= 0, "price").when(F.col("at") >= F.col("ends"), "period")
    return o.join(ends, ["part", "retailer"]).select("part", "retailer", "ok", "ln", reject.alias("reject"))


@query("src10_category_menu", "SELECT DISTINCT link, regexp_extract(link, '^/([^/]+)', 1) AS department FROM (SELECT unnest(regexp_extract_all(html, '<a href=\"(/[^\"]+)\"', 1)) AS link FROM pages) WHERE NOT regexp_matches(link, '^/(the|The|and)')")
def src10(spark, sf_dir):
    """The links of each page's menu, once, without excluded departments."""
    links = read(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"]+)"'), F.lit(1))).alias("link")).distinct()
    return links.where(~F.col("link").rlike("^/(the|The|and)")).select("link", F.regexp_extract("link", "^/([^/]+)", 1).alias("department"))


@query("src11_source_validation", "SELECT page_id, regexp_full_match(url, 'https?://[a-z0-9.]+/[a-z]{2}/[0-9]+([?].*)?') AS valid FROM pages")
def src11(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.col("url").rlike("^https?://[a-z0-9.]+/[a-z]{2}/[0-9]+([?].*)?$").alias("valid"))


@query("src13_resumable_pages", with_("ev") + """, tries AS (SELECT event_id, listing % 4 AS retailer, day, epoch_us(seen_at) AS t, NOT available AND band = 1 AS redirect FROM ev WHERE type <> 'signup'),
islands AS (SELECT *, count(*) FILTER (WHERE NOT redirect) OVER (PARTITION BY retailer, day ORDER BY t, event_id) AS island FROM tries),
streaks AS (SELECT *, CASE WHEN redirect THEN count(*) FILTER (WHERE redirect) OVER (PARTITION BY retailer, day, island ORDER BY t, event_id) ELSE 0 END AS streak FROM islands)
SELECT event_id, retailer, day, streak, coalesce(max(CASE WHEN streak >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY retailer, day ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS attempted FROM streaks""")
def src13(spark, sf_dir):
    """Landed page attempts read to the end by a stream whose checkpoint is the cursor, a second run of which finds nothing new; runs stop after three redirects in a row."""
    from ..streaming import acquisition, ingest

    folder = shared_path(spark, "run")
    for _ in range(2):
        ingest.run_once(acquisition.page_stream(spark, sf_dir), f"{folder}/out", f"{folder}/checkpoint")
    return acquisition.stop_rule(spark.read.parquet(f"{folder}/out"))


@query("src16_ingest_run", with_("ev") + " SELECT count(*) AS accepted, count(DISTINCT listing) AS listings, 'success' AS status FROM ev WHERE available AND listing % 4 = 1")
def src16(spark, sf_dir):
    """One retailer's run through the sink, and its log row."""
    from ..streaming import ingest

    folder = shared_path(spark, "run")
    ingest.run_once(ingest.event_stream(spark, sf_dir).where("listing % 4 = 1"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").agg(F.count("*").alias("accepted"), F.count_distinct("listing").alias("listings"), F.lit("success").alias("status"))


@query("snk01_report_sink", "SELECT l_returnflag AS flag, count(*) AS n, 'refused' AS second FROM lineitem GROUP BY 1")
def snk01(spark, sf_dir):
    """A report written as JSON; a second write to its place is refused."""
    from pyspark.errors import AnalysisException

    path = shared_path(spark, "run")
    report = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"))
    report.write.mode("errorifexists").json(path)
    try:
        report.write.mode("errorifexists").json(path)
        second = "written"
    except AnalysisException:
        second = "refused"
    return spark.read.schema("flag string, n long").json(path).withColumn("second", F.lit(second))


@query("cls02_family_query", with_("parts") + ", " + GROCERIES + """ SELECT DISTINCT phrase AS query, family, CASE noun WHEN 'widget' THEN 'extra' WHEN 'gear' THEN 'de girasol gloria' WHEN 'bolt' THEN 'leche deslactosada laive' WHEN 'ring' THEN 'pardos la calera'
WHEN 'plate' THEN 'suiza' WHEN 'rod' THEN 'liquido matic' WHEN 'anvil' THEN 'rubia bell s' WHEN 'gizmo' THEN 'costeno' END AS rest FROM groceries""")
def cls02(spark, sf_dir):
    """The family that the leading noun of each product phrase names, and the tokens left."""
    phrases = groceries(spark, sf_dir).select(F.trim(F.regexp_replace("title", "( (Bolsa|Caja|Botella|Frasco|Aprox\\.))? *((Pack|PACK|Paquete|Tripack) .*|\\d.*)$", "")).alias("query")).distinct()
    text = C.fold_accents(search_text(F.col("query")))
    named = C.leading_noun(text)
    rest = F.when(named["family"].isNotNull(), F.trim(F.substr(text, F.length(named["noun"]) + 1))).otherwise(text)
    return phrases.select("query", named["family"].alias("family"), rest.alias("rest"))


@query("cls07_need_profile", with_("parts") + ", " + GROCERIES + """ SELECT noun, unit, count(*) AS n, any_value(title_profile) AS profile FROM groceries WHERE NOT bundle AND unit IS NOT NULL GROUP BY 1, 2""")
def cls07(spark, sf_dir):
    """The profile that each product infers as a need: what its title says, else that of bare oil or detergent by its unit."""
    unit = F.when(F.col("a.unit") == "g", "kg").when(F.col("a.unit") == "ml", "L").otherwise("unit")
    needs = groceries(spark, sf_dir).withColumn("a", C.attributes(F.col("title"))).where("a.unit is not null")
    told = needs.select(F.split_part("name", F.lit(" "), F.lit(2)).alias("noun"), F.col("a.unit").alias("unit"), need_profile(F.col("title"), unit).alias("profile"))
    return told.groupBy("noun", "unit").agg(F.count("*").alias("n"), F.max("profile").alias("profile"))


@query("cls10_diagnostics", with_("ev") + " SELECT type, CASE WHEN type = 'error' THEN CASE WHEN band < 2 THEN 'timeout' WHEN band < 4 THEN 'parse' ELSE 'unexpected' END END AS reason, count(*) AS n FROM ev GROUP BY 1, 2")
def cls10(spark, sf_dir):
    """Errors under an allowed list of reasons."""
    reason = F.when(F.col("type") == "error", F.when(F.col("band") < 2, "timeout").when(F.col("band") < 4, "parse").otherwise("unexpected"))
    return event_observations(spark, sf_dir).groupBy("type", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("elg04_offer_validation", PRICED + """ SELECT part, retailer, title_family AS family, CASE WHEN reason IN ('invalid-price', 'unavailable', 'not-fresh') THEN reason END AS reject,
CASE WHEN reason IS NULL THEN (2 * num + den) // (2 * den) END AS unit_cents, CASE WHEN reason NOT IN ('invalid-price', 'unavailable', 'not-fresh') THEN reason END AS withheld FROM priced""")
def elg04(spark, sf_dir):
    """Offers with their family and unit price; those that are not payable, fresh and available are rejected, others merely lack a unit price."""
    barred = F.col("reason").isin("invalid-price", "unavailable", "not-fresh")
    return priced_offers(spark, sf_dir).select(
        "part", "retailer", "family", F.when(barred, F.col("reason")).alias("reject"),
        F.when(F.col("reason").isNull(), F.expr("(2 * num + den) div (2 * den)")).alias("unit_cents"), F.when(~barred, F.col("reason")).alias("withheld"))


@query("elg07_shared_prices", CURRENT + " SELECT a.part, a.retailer, a.cents, g.n, g.low FROM current a JOIN (SELECT part, count(*) AS n, min(cents) AS low FROM current GROUP BY 1) g USING (part)")
def elg07(spark, sf_dir):
    """One relation of open prices used twice; its shuffle is reused."""
    c = current_offers(spark, sf_dir)
    return c.join(c.groupBy("part").agg(F.count("*").alias("n"), F.min("cents").alias("low")), "part").select("part", "retailer", "cents", "n", "low")


@query("his03_history_query", with_("states", "days") + """, n AS (SELECT listing, count(*) AS n_days FROM days WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY 1)
SELECT s.listing, epoch_us(s.valid_from) AS from_us, s.band, s.previous_band, coalesce(n.n_days, 0) AS n_days FROM states s LEFT JOIN n USING (listing) WHERE s.valid_from < TIMESTAMP '2024-01-21' AND (s.valid_until IS NULL OR s.valid_until > TIMESTAMP '2024-01-10')""")
def his03(spark, sf_dir):
    """States of a range, each with the one before and the listing's covered days."""
    ts = lambda t: F.lit(t).cast("timestamp_ntz")
    n = coverage_days(spark, sf_dir).where(F.col("day").between("2024-01-10", "2024-01-20")).groupBy("listing").agg(F.count("*").alias("n_days"))
    states = price_states(usable(spark, sf_dir)).where((F.col("valid_from") < ts("2024-01-21 00:00:00")) & (F.col("valid_until").isNull() | (F.col("valid_until") > ts("2024-01-10 00:00:00"))))
    return states.join(n, "listing", "left").select("listing", micros("valid_from").alias("from_us"), "band", "previous_band", F.coalesce("n_days", F.lit(0)).alias("n_days"))


@query("his11_weekday_series", with_("ev") + " SELECT listing, isodow(day) AS weekday, count(DISTINCT day) AS days, min(band) AS low FROM ev WHERE available GROUP BY 1, 2")
def his11(spark, sf_dir):
    e = usable(spark, sf_dir)
    return e.groupBy("listing", (F.weekday("day") + 1).cast("long").alias("weekday")).agg(F.count_distinct("day").alias("days"), F.min("band").alias("low"))


#: Answers of a site: events stand for requests, their type and price band for the status.
STATUS = """answers AS (SELECT event_id, CAST(CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 301 WHEN 'purchase' THEN 204 WHEN 'signup' THEN 404 ELSE 400 + CAST(floor(value / 25) AS BIGINT) END AS INTEGER) AS status FROM events)"""


@query("orc04_response_status", f"WITH {STATUS} SELECT event_id, status, CASE WHEN status IN (401, 403, 429) THEN 'restricted' WHEN status = 404 THEN 'missing' WHEN status BETWEEN 300 AND 399 THEN 'redirect' WHEN status BETWEEN 200 AND 299 THEN 'ok' ELSE 'failed' END AS outcome FROM answers")
def orc04(spark, sf_dir):
    """What each answer means: access restricted, gone, moved, fine or failed."""
    kind = F.col("event_type")
    s = F.when(kind == "view", 200).when(kind == "click", 301).when(kind == "purchase", 204).when(kind == "signup", 404).otherwise(400 + F.floor(F.col("value") / 25)).cast("int")
    outcome = F.when(s.isin(401, 403, 429), "restricted").when(s == 404, "missing").when(s.between(300, 399), "redirect").when(s.between(200, 299), "ok").otherwise("failed")
    return read(spark, sf_dir, "events").select("event_id", s.alias("status"), outcome.alias("outcome"))


@query("orc05_source_registry", """SELECT c_nationkey % 4 AS retailer, count(DISTINCT c_mktsegment || '/' || c_nationkey) AS sources, min(c_mktsegment || '/' || c_nationkey) AS first_source, max(c_mktsegment || '/' || c_nationkey) AS last_source FROM customer GROUP BY 1""")
def orc05(spark, sf_dir):
    """The registry of each retailer in one pass: its sources (a segment of a nation), each once."""
    source = F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string"))
    listed = read(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") % 4).alias("retailer"), source.alias("source")).count()
    return listed.groupBy("retailer").agg(F.count("*").alias("sources"), F.min("source").alias("first_source"), F.max("source").alias("last_source"))


@query("orc06_single_product_page", with_("obs") + """, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY seen_at DESC, ok DESC, ln DESC, flag DESC, cents DESC) AS rn FROM obs WHERE retailer = 0) WHERE rn = 1)
SELECT CAST(part * 4 AS VARCHAR) AS sku, CASE WHEN ln = 7 THEN 'ambiguous' WHEN flag = 'A' THEN 'observed' WHEN flag = 'R' THEN 'unavailable' ELSE 'unknown' END AS outcome, CASE WHEN ln <> 7 AND flag = 'A' THEN cents END AS cents FROM l""")
def orc06(spark, sf_dir):
    """Landed pages of one product each: sold, flagged as unavailable, without a flag, or of several variants."""
    return landed.product_detail(landing_zone.detail_pages(spark, sf_dir))


@query("rdm06_matching_inspection", with_("latest", "parts") + " SELECT p.brand, count(*) AS listings, count(*) FILTER (WHERE (CASE WHEN l.part % 9 = 0 THEN NULL ELSE p.size END) IS DISTINCT FROM p.size) AS stale FROM latest l JOIN parts p USING (part) GROUP BY 1")
def rdm06(spark, sf_dir):
    """Derived attributes are made again and rows that differ are told, null-safe."""
    again = F.when(F.col("part") % 9 == 0, F.lit(None)).otherwise(F.col("size"))
    return latest_offers(spark, sf_dir).join(parts(spark, sf_dir), "part").groupBy("brand").agg(F.count("*").alias("listings"), F.count_if(~again.eqNullSafe(F.col("size"))).alias("stale"))


@query("rdm07_listing_detail_rows", with_("latest", "parts") + " SELECT p.part, l.retailer, l.cents FROM parts p LEFT JOIN latest l USING (part) WHERE p.size < 10")
def rdm07(spark, sf_dir):
    return parts(spark, sf_dir).where("size < 10").join(latest_offers(spark, sf_dir), "part", "left").select("part", "retailer", "cents")


@query("rdm08_listing_benefits", with_("latest") + """ SELECT l.part, l.retailer, string_agg(o.flag || ':' || o.cents, ',' ORDER BY o.flag, o.cents) AS benefits, CAST(max(l.at_) AS DATE) AS stamped FROM (SELECT *, seen_at AS at_ FROM latest) l JOIN obs o ON o.part = l.part AND o.retailer = l.retailer WHERE o.flag <> 'R' GROUP BY 1, 2""")
def rdm08(spark, sf_dir):
    """Benefits in order of program, stamped with the listing's last observation."""
    told = F.transform(F.array_sort(F.collect_list(F.struct("flag", "cents"))), lambda b: F.concat_ws(":", b["flag"], b["cents"]))
    b = price_observations(spark, sf_dir).where("flag <> 'R'").groupBy("part", "retailer").agg(F.array_join(told, ",").alias("benefits"))
    return b.join(latest_offers(spark, sf_dir), ["part", "retailer"]).select("part", "retailer", "benefits", F.col("at").cast("date").alias("stamped"))


@query("rdm09_price_source", with_("states") + " SELECT listing, band FROM states WHERE valid_until IS NULL")
def rdm09(spark, sf_dir):
    """Current prices as the open states."""
    return price_states(usable(spark, sf_dir)).where("valid_until is null").select("listing", "band")


@query("rdm11_scope_guard", CURRENT + " SELECT retailer, count(*) AS n, count(*) <= 5000 AS within FROM current GROUP BY 1")
def rdm11(spark, sf_dir):
    return current_offers(spark, sf_dir).groupBy("retailer").agg(F.count("*").alias("n"), (F.count("*") <= 5000).alias("within"))


@query("rdm12_sync_contracts", """SELECT c_custkey AS user_, coalesce(n, 0) AS revision, CASE WHEN n IS NULL AND lists > 0 THEN 'list-without-revision' WHEN n > 0 AND coalesce(lists, 0) = 0 THEN 'revision-without-list' END AS reject FROM customer
LEFT JOIN (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS lists, nullif(count(*) FILTER (WHERE o_orderstatus <> 'O'), 0) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def rdm12(spark, sf_dir):
    """Revision 0 exactly where there is no list: settled orders are the revisions, open ones the list."""
    settled = F.col("o_orderstatus") != "O"
    n = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_")).agg(F.count_if(settled).alias("revision"), F.count_if(~settled).alias("lists"))
    u = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_")).join(n, "user_", "left").na.fill(0, ["revision", "lists"])
    reject = F.when((F.col("revision") == 0) & (F.col("lists") > 0), "list-without-revision").when((F.col("revision") > 0) & (F.col("lists") == 0), "revision-without-list")
    return u.select("user_", "revision", reject.alias("reject"))


@query("hlp05_search_quantity", with_("parts") + ", " + GROCERIES + """ SELECT part, CASE WHEN title_family = 'eggs' THEN 30 ELSE 1 END AS amount, CASE base_unit WHEN 'g' THEN 'kg' WHEN 'ml' THEN 'L' ELSE 'unit' END AS unit FROM groceries""")
def hlp05(spark, sf_dir):
    """A kilo, a litre or thirty eggs, by the first measure of the title."""
    first = F.get(C.quantities(normalize_title(F.col("title"))), F.lit(0))["unit"]
    unit = F.when(first == "g", "kg").when(first == "ml", "L").otherwise("unit")
    amount = F.when(F.coalesce(C.family(F.col("title")) == "eggs", F.lit(False)), 30).otherwise(1)
    return groceries(spark, sf_dir).select("part", amount.alias("amount"), unit.alias("unit"))


@query("hlp08_page_bounds", "SELECT page_id, len(regexp_extract_all(html, '<li>')) AS listed, len(regexp_extract_all(html, '<p[ >]')) AS n_rows, page_id >= 0 AND len(regexp_extract_all(html, '<li>')) <= 48 AND len(regexp_extract_all(html, '<p[ >]')) <= 64 AS within FROM pages")
def hlp08(spark, sf_dir):
    """A page number, 48 products at most and 64 rows at most."""
    counted = read(spark, sf_dir, "pages").select("page_id", F.regexp_count("html", F.lit("<li>")).cast("long").alias("listed"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("n_rows"))
    return counted.withColumn("within", (F.col("page_id") >= 0) & (F.col("listed") <= 48) & (F.col("n_rows") <= 64))
