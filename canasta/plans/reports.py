"""Audits, coverage reports, budgets and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.catalog import attributes
from ..sources.domain import event_observations, latest_offers, parts, price_observations, read, with_
from ..sources.groceries import SQL as GROCERIES
from ..sources.groceries import groceries
from . import query
from .offers import CURRENT, FRESHNESS, KEY, current_offers, freshness
from .unit_prices import PRICED, priced_offers

AUDIT = with_("latest", "parts") + f", known AS (SELECT l.*, p.type, p.size, {FRESHNESS} AS state FROM latest l JOIN parts p USING (part))"


def known(spark, sf_dir):
    return latest_offers(spark, sf_dir).join(parts(spark, sf_dir), "part").withColumn("state", freshness())


@query("agg01_catalog_coverage", AUDIT + """ SELECT coalesce(CAST(retailer AS VARCHAR), 'all') AS retailer, coalesce(type, 'all') AS family, count(*) AS known, count(*) FILTER (WHERE state = 'fresh') AS fresh,
count(*) FILTER (WHERE state = 'fresh' AND flag <> 'R') AS usable, count(DISTINCT retailer) AS retailers FROM known GROUP BY GROUPING SETS ((), (retailer), (type), (type, retailer))""")
def agg01(spark, sf_dir):
    """Counters in total, by retailer, by family and by both, in one pass (cube)."""
    k = known(spark, sf_dir).withColumn("shop", F.col("retailer"))
    cube = k.cube(F.col("retailer").cast("string").alias("r"), F.col("type").alias("t")).agg(
        F.count("*").alias("known"), F.count_if(F.col("state") == "fresh").alias("fresh"), F.count_if((F.col("state") == "fresh") & (F.col("flag") != "R")).alias("usable"), F.count_distinct("shop").alias("retailers"))
    return cube.select(F.coalesce("r", F.lit("all")).alias("retailer"), F.coalesce("t", F.lit("all")).alias("family"), "known", "fresh", "usable", "retailers")


@query("agg02_family_grade", AUDIT + """, g AS (SELECT type AS family, count(*) AS known, count(*) FILTER (WHERE state = 'fresh') AS fresh, count(DISTINCT retailer) FILTER (WHERE state = 'fresh') AS retailers FROM known GROUP BY 1)
SELECT family, CASE WHEN fresh = 0 AND known > 0 THEN 'UNSAFE' WHEN fresh < 2 THEN 'POOR' WHEN retailers < 3 OR fresh < 6 THEN 'LIMITED' ELSE 'GOOD' END AS grade FROM g""")
def agg02(spark, sf_dir):
    is_fresh = F.col("state") == "fresh"
    g = known(spark, sf_dir).groupBy(F.col("type").alias("family")).agg(F.count("*").alias("known"), F.count_if(is_fresh).alias("fresh"), F.count_distinct(F.when(is_fresh, F.col("retailer"))).alias("retailers"))
    grade = F.when((F.col("fresh") == 0) & (F.col("known") > 0), "UNSAFE").when(F.col("fresh") < 2, "POOR").when((F.col("retailers") < 3) | (F.col("fresh") < 6), "LIMITED").otherwise("GOOD")
    return g.select("family", grade.alias("grade"))


@query("agg03_refresh_coverage", AUDIT + " SELECT retailer, state, flag AS origin, count(*) AS n FROM known GROUP BY 1, 2, 3")
def agg03(spark, sf_dir):
    return known(spark, sf_dir).groupBy("retailer", "state", F.col("flag").alias("origin")).agg(F.count("*").alias("n"))


@query("agg04_filtered_counts", with_("ev") + """ SELECT listing % 4 AS retailer, count(*) AS total, count(*) FILTER (WHERE type = 'purchase') AS purchases, count(*) FILTER (WHERE NOT available) AS errors,
epoch_us(min(seen_at)) AS oldest_us, epoch_us(max(seen_at)) AS newest_us FROM ev GROUP BY 1""")
def agg04(spark, sf_dir):
    e = event_observations(spark, sf_dir)
    us = lambda f: F.unix_micros(f("at").cast("timestamp"))
    return e.groupBy((F.col("listing") % 4).alias("retailer")).agg(F.count("*").alias("total"), F.count_if(F.col("type") == "purchase").alias("purchases"), F.count_if(~F.col("available")).alias("errors"), us(F.min).alias("oldest_us"), us(F.max).alias("newest_us"))


@query("agg05_observation_coverage", with_("days") + """, today AS (SELECT max(day) AS t FROM days) SELECT listing % 4 AS retailer, count(*) AS days, CAST(sum(n) AS BIGINT) AS observations, count(*) FILTER (WHERE day = (SELECT t FROM today)) AS today FROM days GROUP BY 1""")
def agg05(spark, sf_dir):
    from .states import coverage_days

    days = coverage_days(spark, sf_dir)
    today = days.agg(F.max("day").alias("t"))
    return days.crossJoin(F.broadcast(today)).groupBy((F.col("listing") % 4).alias("retailer")).agg(F.count("*").alias("days"), F.sum("n").alias("observations"), F.count_if(F.col("day") == F.col("t")).alias("today"))  # one row


@query("agg06_pending_work", CURRENT + ", " + GROCERIES + """, normalized AS (SELECT part, brand, name, size FROM groceries WHERE total IS NOT NULL), groups AS (SELECT brand, name, size FROM current GROUP BY 1, 2, 3 HAVING count(DISTINCT retailer) >= 2)
SELECT (SELECT count(*) FROM (SELECT DISTINCT part FROM current) c WHERE NOT EXISTS (SELECT 1 FROM normalized n WHERE n.part = c.part)) AS normalization,
(SELECT count(*) FROM (SELECT DISTINCT part FROM current) c JOIN normalized n USING (part) WHERE NOT EXISTS (SELECT 1 FROM groups g WHERE g.brand = n.brand AND g.name = n.name AND g.size = n.size)) AS matching""")
def agg06(spark, sf_dir):
    """Products on offer whose title gives no total, and those that it does but that no other retailer's product matches: anti joins."""
    offers = current_offers(spark, sf_dir)
    titles = groceries(spark, sf_dir).select("part", *KEY, attributes(F.col("title"))["total"].alias("total")).where("total is not null")
    groups = offers.groupBy(*KEY).agg(F.count_distinct("retailer").alias("n")).where("n >= 2")
    listed = offers.select("part").distinct()
    bare = listed.join(titles, "part", "left_anti").agg(F.count("*").alias("normalization"))
    alone = titles.join(listed, "part", "left_semi").join(groups, KEY, "left_anti").agg(F.count("*").alias("matching"))
    return bare.join(F.broadcast(alone))  # one row each


@query("agg07_catalog_budget", with_("obs") + """, l AS (SELECT count(*) AS observations, count(DISTINCT part * 4 + retailer) AS listings FROM obs),
r AS (SELECT count(DISTINCT part * 4 + retailer) AS changed FROM obs o WHERE seen_at >= TIMESTAMP '2001-10-28' AND EXISTS (SELECT 1 FROM obs e WHERE e.part = o.part AND e.retailer = o.retailer AND e.seen_at < TIMESTAMP '2001-10-28'))
SELECT observations, listings, changed FROM l CROSS JOIN r""")
def agg07(spark, sf_dir):
    """Table sizes and the listings of the last week that were known before."""
    o = price_observations(spark, sf_dir)
    cutoff = F.lit("2001-10-28 00:00:00").cast("timestamp_ntz")
    per = o.groupBy("part", "retailer").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    return per.agg(F.sum("n").alias("observations"), F.count("*").alias("listings"), F.count_if((F.col("first") < cutoff) & (F.col("last") >= cutoff)).alias("changed"))


@query("agg08_growth_projection", with_("latest") + " SELECT k AS factor, k * count(*) AS listings, k * k * (count(*) * (count(*) - 1) // 2) AS candidates FROM latest CROSS JOIN (VALUES (1), (2), (5)) t(k) GROUP BY k")
def agg08(spark, sf_dir):
    """Linear growth of listings, quadratic of candidates."""
    n = latest_offers(spark, sf_dir).agg(F.count("*").alias("n")).withColumn("factor", F.explode(F.array(F.lit(1), F.lit(2), F.lit(5))))
    return n.select("factor", (F.col("factor") * F.col("n")).alias("listings"), F.expr("factor * factor * (n * (n - 1) div 2)").alias("candidates"))


@query("agg09_request_budget", with_("latest") + " SELECT retailer, (count(*) + 19) // 20 AS pages FROM latest GROUP BY 1")
def agg09(spark, sf_dir):
    return latest_offers(spark, sf_dir).groupBy("retailer").agg(F.expr("(count(1) + 19) div 20").alias("pages"))


@query("agg10_quantity_quality", PRICED + """ SELECT coalesce(CAST(retailer AS VARCHAR), 'all') AS retailer, count(*) FILTER (WHERE quality = 'strong') AS strong, count(*) FILTER (WHERE quality = 'approximate') AS approximate, count(*) FILTER (WHERE reason IS NOT NULL) AS withheld FROM priced GROUP BY ROLLUP (retailer)""")
def agg10(spark, sf_dir):
    q = lambda v: F.count_if(F.col("quality") == v)
    r = priced_offers(spark, sf_dir).rollup(F.col("retailer").cast("string").alias("r")).agg(q("strong").alias("strong"), q("approximate").alias("approximate"), F.count_if(F.col("reason").isNotNull()).alias("withheld"))
    return r.select(F.coalesce("r", F.lit("all")).alias("retailer"), "strong", "approximate", "withheld")


@query("agg11_unit_price_audit", PRICED + " SELECT coalesce(reason, 'priced') AS reason, count(*) AS n, min(CASE WHEN reason IS NULL THEN (2 * num + den) // (2 * den) END) AS cheapest FROM priced GROUP BY 1")
def agg11(spark, sf_dir):
    return priced_offers(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("priced")).alias("reason")).agg(F.count("*").alias("n"), F.min(F.expr("(2 * num + den) div (2 * den)")).alias("cheapest"))


@query("agg12_staple_audit", CURRENT + " SELECT t.word, count(c.part) AS offers, count(DISTINCT c.retailer) AS retailers FROM (VALUES ('widget'), ('gear'), ('bolt'), ('cold'), ('red')) t(word) LEFT JOIN current c ON list_contains(string_split(c.name, ' '), t.word) GROUP BY 1")
def agg12(spark, sf_dir):
    """A fixed set of queries in one pass."""
    words = spark.createDataFrame([("widget",), ("gear",), ("bolt",), ("cold",), ("red",)], "word string")
    found = current_offers(spark, sf_dir).select("part", "retailer", F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    return words.join(found, "word", "left").groupBy("word").agg(F.count("part").alias("offers"), F.count_distinct("retailer").alias("retailers"))


@query("agg13_list_audit", with_("latest", "parts") + f""" SELECT CASE WHEN cents <= 0 THEN 'price' WHEN flag = 'R' THEN 'unavailable' WHEN {FRESHNESS} <> 'fresh' THEN 'not-fresh' WHEN size > 45 THEN 'quantity' ELSE 'used' END AS reason, count(*) AS n FROM latest JOIN parts USING (part) GROUP BY 1""")
def agg13(spark, sf_dir):
    """The first reason that keeps an offer out."""
    reason = F.when(F.col("cents") <= 0, "price").when(F.col("flag") == "R", "unavailable").when(F.col("state") != "fresh", "not-fresh").when(F.col("size") > 45, "quantity").otherwise("used")
    return known(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("agg14_detail_audit", with_("obs") + " SELECT depth, count(*) AS listings, CAST(sum(prices) AS BIGINT) AS prices FROM (SELECT part, retailer, count(*) AS depth, count(DISTINCT cents) AS prices FROM obs GROUP BY 1, 2) GROUP BY 1")
def agg14(spark, sf_dir):
    per = price_observations(spark, sf_dir).groupBy("part", "retailer").agg(F.count("*").alias("depth"), F.count_distinct("cents").alias("prices"))
    return per.groupBy("depth").agg(F.count("*").alias("listings"), F.sum("prices").alias("prices"))


HEALTH = AUDIT + """, h AS (SELECT retailer, count(*) AS known, count(*) FILTER (WHERE state = 'fresh') AS fresh, date_diff('day', max(seen_at), TIMESTAMP '2001-11-04 00:00:00') AS age FROM known GROUP BY 1),
issues AS (SELECT retailer, known, fresh, CASE WHEN age > 30 THEN CASE WHEN fresh > 0 THEN 'warning' ELSE 'error' END END AS overdue, CASE WHEN fresh = 0 THEN 'error' END AS none, CASE WHEN known > 50000 THEN 'error' WHEN known = 50000 THEN 'warning' END AS capacity FROM h)"""


def health(spark, sf_dir):
    age = F.datediff(F.lit("2001-11-04").cast("date"), F.max("at"))
    h = known(spark, sf_dir).groupBy("retailer").agg(F.count("*").alias("known"), F.count_if(F.col("state") == "fresh").alias("fresh"), age.alias("age"))
    overdue = F.when(F.col("age") > 30, F.when(F.col("fresh") > 0, "warning").otherwise("error"))
    none = F.when(F.col("fresh") == 0, "error")
    capacity = F.when(F.col("known") > 50_000, "error").when(F.col("known") == 50_000, "warning")
    named = {"overdue": overdue, "none-fresh": none, "capacity": capacity}
    told = F.concat_ws(",", *[F.concat(F.lit(f"{name}:"), severity) for name, severity in named.items()])
    return h.withColumn("issues", F.array_compact(F.array(*named.values()))).withColumn("told", told)


@query("hlt01_snapshot_checks", HEALTH + " SELECT retailer, fresh <= known AND known > 0 AND retailer BETWEEN 0 AND 3 AS consistent FROM issues")
def hlt01(spark, sf_dir):
    return health(spark, sf_dir).select("retailer", ((F.col("fresh") <= F.col("known")) & (F.col("known") > 0) & F.col("retailer").between(0, 3)).alias("consistent"))


@query("hlt02_health_evaluation", HEALTH + " SELECT retailer, CASE WHEN 'error' IN (overdue, none, capacity) THEN 'attention' WHEN 'warning' IN (overdue, none, capacity) THEN 'warning' ELSE 'healthy' END AS status, concat_ws(',', CASE WHEN overdue <> '' THEN 'overdue:' || overdue END, CASE WHEN none <> '' THEN 'none-fresh:' || none END, CASE WHEN capacity <> '' THEN 'capacity:' || capacity END) AS issues FROM (SELECT retailer, coalesce(overdue, '') AS overdue, coalesce(none, '') AS none, coalesce(capacity, '') AS capacity FROM issues)")
def hlt02(spark, sf_dir):
    """Each retailer's status, by the gravest of its issues, and the issues with their severities."""
    status = F.when(F.array_contains("issues", "error"), "attention").when(F.array_contains("issues", "warning"), "warning").otherwise("healthy")
    return health(spark, sf_dir).select("retailer", status.alias("status"), F.col("told").alias("issues"))


@query("hlt03_health_counts", HEALTH + " SELECT retailer, known, fresh FROM issues")
def hlt03(spark, sf_dir):
    return health(spark, sf_dir).select("retailer", "known", "fresh")


@query("hlt04_latest_attempt_and_success", with_("ev") + " SELECT listing % 4 AS retailer, max_by(type, seen_at) AS attempt, epoch_us(max(seen_at)) AS attempt_us, epoch_us(max(seen_at) FILTER (WHERE available)) AS success_us FROM ev GROUP BY 1")
def hlt04(spark, sf_dir):
    e = event_observations(spark, sf_dir)
    us = lambda c: F.unix_micros(F.max(c).cast("timestamp"))
    return e.groupBy((F.col("listing") % 4).alias("retailer")).agg(F.max_by("type", "at").alias("attempt"), us(F.col("at")).alias("attempt_us"), us(F.when(F.col("available"), F.col("at"))).alias("success_us"))


@query("hlt05_capacity_log", """SELECT page_id, markers, markers = 1 AS valid, CASE WHEN markers = 1 THEN length(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) END AS size FROM (SELECT page_id, html, len(regexp_extract_all(html, '<h1>')) AS markers FROM pages)""")
def hlt05(spark, sf_dir):
    """A landed page counts as a log only with exactly one marker, whose value is then read."""
    markers = F.regexp_count("html", F.lit("<h1>")).cast("long")
    found = read(spark, sf_dir, "pages").select("page_id", "html", markers.alias("markers"))
    size = F.when(F.col("markers") == 1, F.length(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).cast("long"))
    return found.select("page_id", "markers", (F.col("markers") == 1).alias("valid"), size.alias("size"))
