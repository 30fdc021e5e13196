"""Price history: ranges, summaries, islands of coverage, daily minima and weekday advice."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import history as H
from ..sources.domain import event_observations, price_observations, price_states, read, with_
from . import query
from .states import coverage_days, micros, usable

#: A range of the driver data: its last eleven days.
START, END = "2024-01-20 00:00:00", "2024-01-31 00:00:00"
ts = lambda text: F.lit(text).cast("timestamp_ntz")
IN_RANGE = f"valid_from <= TIMESTAMP '{END}' AND coalesce(valid_until, last_seen) > TIMESTAMP '{START}'"
RANGED = with_("states") + f""", seen AS (SELECT listing, max(seen_at) AS last_seen FROM ev WHERE available GROUP BY 1),
prior AS (SELECT *, lag(valid_until) OVER (PARTITION BY listing ORDER BY valid_from) AS previous_until FROM states),
ranged AS (SELECT p.*, s.last_seen FROM prior p JOIN seen s USING (listing) WHERE {IN_RANGE})"""


def ranged_states(spark, sf_dir):
    """States that meet the half-open range, an open one up to its last verification."""
    e = usable(spark, sf_dir)
    w = Window.partitionBy("listing").orderBy("valid_from")
    states = price_states(e).withColumn("previous_until", F.lag("valid_until").over(w))
    seen = e.groupBy("listing").agg(F.max("at").alias("last_seen"))
    return states.join(seen, "listing").where((F.col("valid_from") <= ts(END)) & (F.coalesce("valid_until", "last_seen") > ts(START)))


@query("his01_history_windows", """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) SELECT day, range AS days, epoch_us(CAST(day AS TIMESTAMP)) + 86400000000 - range * 86400000000 AS start_us, epoch_us(CAST(day AS TIMESTAMP)) + 86400000000 AS end_us FROM d CROSS JOIN (VALUES (7), (30), (90)) t(range)""")
def his01(spark, sf_dir):
    """Rolling instants of 7, 30 and 90 times 24 hours up to the end of each day with events."""
    days = read(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day")).distinct()
    end = F.unix_micros(F.col("day").cast("timestamp")) + 86_400_000_000
    windows = days.select("day", F.explode(F.array(F.lit(7), F.lit(30), F.lit(90))).alias("days"))
    return windows.select("day", "days", (end - F.col("days").cast("long") * 86_400_000_000).alias("start_us"), end.alias("end_us"))


@query("his02_range_intersection", RANGED + " SELECT listing, band, epoch_us(valid_from) AS from_us FROM ranged")
def his02(spark, sf_dir):
    return ranged_states(spark, sf_dir).select("listing", "band", micros("valid_from").alias("from_us"))


@query("jon06_predecessor", with_("states") + " SELECT listing, epoch_us(valid_from) AS from_us, previous_band, epoch_us(lag(valid_from) OVER (PARTITION BY listing ORDER BY valid_from)) AS previous_us FROM states")
def jon06(spark, sf_dir):
    """The state before each state (an as-of join to the previous row)."""
    w = Window.partitionBy("listing").orderBy("valid_from")
    return price_states(usable(spark, sf_dir)).select("listing", micros("valid_from").alias("from_us"), "previous_band", F.lag(micros("valid_from")).over(w).alias("previous_us"))


SUMMARY = RANGED + f""", marked AS (SELECT *, valid_from >= TIMESTAMP '{START}' AND previous_until = valid_from AND previous_band IS NOT NULL AND previous_band <> band AS changed FROM ranged)
"""


@query("his04_history_summary", SUMMARY + f""", now_ AS (SELECT listing, count(*) AS n_states, min(band) AS low, max(band) AS high, count(*) FILTER (WHERE changed) AS n_changes, min_by(band, valid_from) AS first_band,
max(band) FILTER (WHERE valid_until IS NULL AND last_seen <= TIMESTAMP '{END}') AS current, max_by(band, valid_from) FILTER (WHERE changed) AS to_, max_by(previous_band, valid_from) FILTER (WHERE changed) AS from_ FROM marked GROUP BY 1)
SELECT listing, n_states, low, high, n_changes, current, current - first_band AS difference, to_ - from_ AS last_change, CASE WHEN from_ > 0 THEN (100 * (to_ - from_) + CASE WHEN to_ >= from_ THEN from_ // 2 ELSE -(from_ // 2) END) // from_ END AS percent,
CASE WHEN n_changes = 0 THEN 'insufficient' ELSE 'events' END AS status FROM now_""")
def his04(spark, sf_dir):
    """Lowest, highest, current, changes, difference and percent of each listing over the range; a change needs a contiguous predecessor."""
    changed = (F.col("valid_from") >= ts(START)) & (F.col("previous_until") == F.col("valid_from")) & (F.col("previous_band") != F.col("band"))
    m = ranged_states(spark, sf_dir).withColumn("changed", F.coalesce(changed, F.lit(False)))
    current = F.max(F.when(F.col("valid_until").isNull() & (F.col("last_seen") <= ts(END)), F.col("band")))
    last = F.max(F.when(F.col("changed"), F.struct("valid_from", "band", "previous_band")))
    g = m.groupBy("listing").agg(
        F.count("*").alias("n_states"), F.min("band").alias("low"), F.max("band").alias("high"), F.count_if("changed").alias("n_changes"),
        current.alias("current"), F.min_by("band", "valid_from").alias("first"), last.alias("last"))
    told = g.select("*", (F.col("last.band") - F.col("last.previous_band")).alias("last_change"), F.col("last.previous_band").alias("p"))
    percent = F.expr("if(p > 0, (100 * last_change + if(last_change >= 0, 1, -1) * (p div 2)) div p, null)")
    return told.select(
        "listing", "n_states", "low", "high", "n_changes", "current", (F.col("current") - F.col("first")).alias("difference"), "last_change", percent.alias("percent"),
        F.when(F.col("n_changes") == 0, "insufficient").otherwise("events").alias("status"))


def path_states(spark, sf_dir):
    """States of the range as step_segments and points take them."""
    r = ranged_states(spark, sf_dir)
    return r.select("listing", F.col("band").alias("price"), F.col("valid_from").alias("from"), F.coalesce("valid_until", "last_seen").alias("until"), F.col("valid_until").isNull().alias("open"))


@query("his04_history_points", RANGED + f""" SELECT listing, epoch_us(valid_from) AS at_us, band AS price, 'state-start' AS kind FROM ranged WHERE valid_from >= TIMESTAMP '{START}' AND valid_from <= TIMESTAMP '{END}'
UNION ALL SELECT listing, epoch_us(last_seen), band, 'latest-observation' FROM ranged WHERE valid_until IS NULL AND last_seen BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' AND last_seen > valid_from""")
def his04_points(spark, sf_dir):
    """The known instants of each listing's price: states that begin in the range, and the last observation."""
    return H.points(path_states(spark, sf_dir), ts(START), ts(END)).select("listing", micros("at").alias("at_us"), "price", "kind")


@query("his05_rounded_percent", with_("changes") + """, d AS (SELECT listing, epoch_us(valid_from) AS at_us, band - previous_band AS d, previous_band AS p FROM changes WHERE previous_band IS NOT NULL)
SELECT listing, at_us, CASE WHEN p <> 0 THEN (100 * d + CASE WHEN d >= 0 THEN p // 2 ELSE -(p // 2) END) // p END AS percent FROM d""")
def his05(spark, sf_dir):
    """Percent of change, half away from zero, by integer division."""
    d, p = F.col("band") - F.col("previous_band"), F.col("previous_band")
    percent = F.expr("if(p <> 0, (100 * d + if(d >= 0, 1, -1) * (p div 2)) div p, null)")
    return price_states(usable(spark, sf_dir)).where("previous_band is not null").select("listing", micros("valid_from").alias("at_us"), d.alias("d"), p.alias("p")).select("listing", "at_us", percent.alias("percent"))


ISLANDS = with_("days") + ", numbered AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY listing ORDER BY day) AS INTEGER) AS island FROM days), islands AS (SELECT listing, island, min(day) AS first_day, max(day) AS last_day, count(*) AS n_days FROM numbered GROUP BY 1, 2)"


def covered_periods(spark, sf_dir):
    """Runs of consecutive covered days (gaps and islands)."""
    n = F.row_number().over(Window.partitionBy("listing").orderBy("day"))
    days = coverage_days(spark, sf_dir).withColumn("island", F.date_sub("day", n))
    return days.groupBy("listing", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days"))


@query("his06_covered_periods", ISLANDS + " SELECT listing, greatest(first_day, DATE '2024-01-05') AS first_day, least(last_day, DATE '2024-01-25') AS last_day FROM islands WHERE last_day >= DATE '2024-01-05' AND first_day <= DATE '2024-01-25'")
def his06(spark, sf_dir):
    """Covered periods clipped to a range."""
    a, b = F.lit("2024-01-05").cast("date"), F.lit("2024-01-25").cast("date")
    return covered_periods(spark, sf_dir).where((F.col("last_day") >= a) & (F.col("first_day") <= b)).select("listing", F.greatest("first_day", a).alias("first_day"), F.least("last_day", b).alias("last_day"))


@query("his07_step_segments", RANGED + f""", cov AS (SELECT listing, day, first_at, last_at, day - CAST(row_number() OVER (PARTITION BY listing ORDER BY day) AS INTEGER) AS island FROM (SELECT listing, day, min(seen_at) AS first_at, max(seen_at) AS last_at FROM ev WHERE available GROUP BY 1, 2)),
runs AS (SELECT listing, greatest(min(first_at), TIMESTAMP '{START}') AS a, least(max(last_at), TIMESTAMP '{END}') AS b FROM cov GROUP BY listing, island HAVING max(last_at) >= TIMESTAMP '{START}' AND min(first_at) <= TIMESTAMP '{END}'),
pieces AS (SELECT r.listing, u.a AS period, greatest(u.a, r.valid_from) AS from_, least(u.b, coalesce(r.valid_until, r.last_seen)) AS until_, r.band, r.valid_until IS NULL AS open FROM ranged r JOIN runs u ON u.listing = r.listing AND r.valid_from <= u.b AND coalesce(r.valid_until, r.last_seen) >= u.a),
kept AS (SELECT * FROM pieces WHERE from_ < until_ OR (from_ = until_ AND open)),
marked AS (SELECT *, CASE WHEN lag(until_) OVER (PARTITION BY listing, period ORDER BY from_, until_) IS NOT DISTINCT FROM from_ THEN 0 ELSE 1 END AS broken FROM kept),
numbered AS (SELECT *, sum(broken) OVER (PARTITION BY listing, period ORDER BY from_, until_) AS path FROM marked),
placed AS (SELECT *, min(from_) OVER p AS segment_from, max(until_) OVER p AS segment_until FROM numbered WINDOW p AS (PARTITION BY listing, period, path))
SELECT listing, epoch_us(segment_from) AS segment_us, epoch_us(from_) AS from_us, epoch_us(until_) AS until_us, band AS price FROM placed WHERE segment_from < segment_until""")
def his07_segments(spark, sf_dir):
    """The steps of each listing's price within its covered periods of the range, by one sweep over both."""
    days = coverage_days(spark, sf_dir)
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("listing").orderBy("day")))
    runs = days.withColumn("island", island).groupBy("listing", "island").agg(F.min("first_at").alias("first"), F.max("last_at").alias("last"))
    periods = runs.where((F.col("last") >= ts(START)) & (F.col("first") <= ts(END)))
    found = H.step_segments(path_states(spark, sf_dir), periods, ts(START), ts(END))
    return found.select("listing", micros("segment_from").alias("segment_us"), micros("from").alias("from_us"), micros("until").alias("until_us"), "price")


DAILY = with_("states", "days") + """, met AS (SELECT d.listing, d.day, d.first_at, d.last_at, s.band, s.valid_from, s.valid_until FROM days d JOIN states s
ON s.listing = d.listing AND s.valid_from <= d.last_at AND (s.valid_until IS NULL OR s.valid_until > d.first_at)),
daily AS (SELECT listing, day, CASE WHEN count(DISTINCT band) = 1 AND min(valid_from) <= min(first_at) THEN min(band) END AS band FROM met GROUP BY 1, 2)"""


def daily_prices(spark, sf_dir):
    """The price of each covered day, null where it was mixed: an interval-overlap join on the listing."""
    states = price_states(usable(spark, sf_dir)).select(F.col("listing").alias("l"), "band", "valid_from", "valid_until")
    days = coverage_days(spark, sf_dir)
    overlap = (F.col("listing") == F.col("l")) & (F.col("valid_from") <= F.col("last_at")) & (F.col("valid_until").isNull() | (F.col("valid_until") > F.col("first_at")))
    one = (F.count_distinct("band") == 1) & (F.min("valid_from") <= F.min("first_at"))
    return days.join(states, overlap).groupBy("listing", "day").agg(F.when(one, F.min("band")).alias("band"))


@query("his07_verified_streak", DAILY + f""", today AS (SELECT max(day) AS today FROM ev), last_ AS (SELECT listing, max(seen_at) AS last_seen, max(day) AS last_day FROM ev WHERE available GROUP BY 1),
current_ AS (SELECT s.listing, s.band AS current FROM states s JOIN last_ l USING (listing), today WHERE s.valid_until IS NULL AND l.last_day = today AND l.last_seen <= TIMESTAMP '{END}'),
turned AS (SELECT DISTINCT s.listing, e.day FROM states s JOIN ev e ON e.listing = s.listing AND e.seen_at = s.valid_from WHERE s.previous_band IS NOT NULL),
kept AS (SELECT d.listing, today - d.day AS back, row_number() OVER (PARTITION BY d.listing ORDER BY d.day DESC) - 1 AS place FROM daily d JOIN days c USING (listing, day) JOIN current_ k ON k.listing = d.listing AND k.current = d.band, today
  WHERE c.first_at >= TIMESTAMP '{START}' AND c.last_at <= TIMESTAMP '{END}' AND NOT EXISTS (SELECT 1 FROM turned t WHERE t.listing = d.listing AND t.day = d.day))
SELECT k.listing, CASE WHEN count(*) FILTER (WHERE back = place) >= 2 THEN count(*) FILTER (WHERE back = place) END AS streak FROM kept k GROUP BY 1 HAVING count(*) FILTER (WHERE back = place) > 0""")
def his07(spark, sf_dir):
    """Days in a row up to today, from two on, that were verified at the current price without a change."""
    e = usable(spark, sf_dir)
    today = event_observations(spark, sf_dir).agg(F.max("day").alias("today"))
    seen = e.groupBy("listing").agg(F.max("at").alias("last_seen"), F.max("day").alias("last_day"))
    states = price_states(e)
    current = states.where("valid_until is null").join(seen.where(F.col("last_seen") <= ts(END)), "listing").join(F.broadcast(today), F.col("last_day") == F.col("today")).select("listing", F.col("band").alias("current"), "today")
    turned = states.where("previous_band is not null").select("listing", F.to_date(F.from_utc_timestamp("valid_from", "America/Lima")).alias("day")).distinct()
    verified = coverage_days(spark, sf_dir).where((F.col("first_at") >= ts(START)) & (F.col("last_at") <= ts(END))).select("listing", "day")
    days = daily_prices(spark, sf_dir).select("listing", "day", "band").join(verified, ["listing", "day"]).join(turned, ["listing", "day"], "left_anti").join(current, "listing")
    return H.unchanged_days(days.select("listing", F.datediff("today", "day").alias("back"), F.coalesce(F.col("band") == F.col("current"), F.lit(False)).alias("kept")))


@query("his08_weekday_daily_price", DAILY + " SELECT listing, day, band FROM daily")
def his08(spark, sf_dir):
    return daily_prices(spark, sf_dir)


@query("jon09_interval_overlap", DAILY + " SELECT listing, day, count(*) AS n_states FROM met GROUP BY 1, 2")
def jon09(spark, sf_dir):
    states = price_states(usable(spark, sf_dir)).select(F.col("listing").alias("l"), "valid_from", "valid_until")
    overlap = (F.col("listing") == F.col("l")) & (F.col("valid_from") <= F.col("last_at")) & (F.col("valid_until").isNull() | (F.col("valid_until") > F.col("first_at")))
    return coverage_days(spark, sf_dir).join(states, overlap).groupBy("listing", "day").agg(F.count("*").alias("n_states"))


@query("jon08_point_in_interval", with_("states", "days") + " SELECT d.listing, d.day, s.band FROM days d JOIN states s ON s.listing = d.listing AND s.valid_from <= d.last_at AND (s.valid_until IS NULL OR s.valid_until > d.last_at)")
def jon08(spark, sf_dir):
    """The state at the last observation of each day (an as-of join)."""
    states = price_states(usable(spark, sf_dir)).select(F.col("listing").alias("l"), "band", "valid_from", "valid_until")
    held = (F.col("listing") == F.col("l")) & (F.col("valid_from") <= F.col("last_at")) & (F.col("valid_until").isNull() | (F.col("valid_until") > F.col("last_at")))
    return coverage_days(spark, sf_dir).join(states, held).select("listing", "day", "band")


SAMPLES = with_("states", "days") + """, samples AS (SELECT listing, day, first_at AS seen_at FROM days UNION ALL SELECT listing, day, last_at FROM days),
priced AS (SELECT p.listing, p.day, p.seen_at, s.band FROM samples p JOIN states s ON s.listing = p.listing AND s.valid_from <= p.seen_at AND (s.valid_until IS NULL OR s.valid_until > p.seen_at))"""


def sampled(spark, sf_dir):
    """Prices at the first and last instant of each covered day."""
    points = coverage_days(spark, sf_dir).select("listing", "day", F.explode(F.array("first_at", "last_at")).alias("at"))
    states = price_states(usable(spark, sf_dir)).select(F.col("listing").alias("l"), "band", "valid_from", "valid_until")
    return points.join(states, (F.col("listing") == F.col("l")) & (F.col("valid_from") <= F.col("at")) & (F.col("valid_until").isNull() | (F.col("valid_until") > F.col("at")))).drop("l")


@query("jon10_sample_instants", SAMPLES + " SELECT listing, day, epoch_us(seen_at) AS at_us, band FROM priced")
def jon10(spark, sf_dir):
    return sampled(spark, sf_dir).select("listing", "day", micros("at").alias("at_us"), "band")


@query("his12_daily_minima", SAMPLES + " SELECT listing, day, band, at_us FROM (SELECT listing, day, band, epoch_us(seen_at) AS at_us, row_number() OVER (PARTITION BY listing, day ORDER BY band, seen_at DESC) AS rn FROM priced) WHERE rn = 1")
def his12(spark, sf_dir):
    """The lowest price of each day, at its latest instant."""
    first = F.row_number().over(Window.partitionBy("listing", "day").orderBy("band", F.desc("at")))
    return sampled(spark, sf_dir).withColumn("rn", first).where("rn = 1").select("listing", "day", "band", micros("at").alias("at_us"))


@query("his13_minima_of_ranges", SAMPLES + """, r AS (SELECT range FROM (VALUES (7), (30), (90)) t(range)) SELECT listing, range AS days, count(DISTINCT day) AS covered, min(band) AS low,
min(date_diff('day', day, DATE '2024-01-30')) FILTER (WHERE band = lowest) AS days_ago FROM (SELECT p.listing, p.day, p.band, r.range, min(band) OVER (PARTITION BY p.listing, r.range) AS lowest
FROM priced p JOIN r ON date_diff('day', p.day, DATE '2024-01-30') < r.range) GROUP BY 1, 2""")
def his13(spark, sf_dir):
    """Covered days, minimum and its age over 7, 30 and 90 days."""
    ago = F.datediff(F.lit("2024-01-30").cast("date"), F.col("day")).cast("long")
    ranged = sampled(spark, sf_dir).withColumn("ago", ago).withColumn("days", F.explode(F.array(F.lit(7), F.lit(30), F.lit(90)))).where("ago < days")
    low = F.min("band").over(Window.partitionBy("listing", "days"))
    return ranged.withColumn("lowest", low).groupBy("listing", "days").agg(F.count_distinct("day").alias("covered"), F.min("band").alias("low"), F.min(F.when(F.col("band") == F.col("lowest"), F.col("ago"))).alias("days_ago"))


@query("jon11_calendar_gaps", with_("days") + """, span AS (SELECT listing, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM days GROUP BY 1)
SELECT listing, day FROM span WHERE NOT EXISTS (SELECT 1 FROM days d WHERE d.listing = span.listing AND d.day = span.day)""")
def jon11(spark, sf_dir):
    """Days without coverage between a listing's first and last."""
    days = coverage_days(spark, sf_dir)
    span = days.groupBy("listing").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("listing", F.explode(F.sequence("a", "b")).alias("day"))
    return span.join(days, ["listing", "day"], "left_anti")


@query("his09_evidence_window", """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) SELECT day, day - CAST(isodow(day) AS INTEGER) - 27 AS first_day, day - CAST(isodow(day) AS INTEGER) AS last_day FROM d""")
def his09(spark, sf_dir):
    """The last four complete weeks, Monday to Sunday, before each day with events."""
    days = read(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day")).distinct()
    last = F.date_sub("day", F.weekday("day") + 1)
    return days.select("day", F.date_sub(last, 27).alias("first_day"), last.alias("last_day"))


WEEK = """, prices AS (SELECT listing, day, 400 + 100 * min(band) AS cents FROM (SELECT * FROM ev WHERE band IS NOT NULL) WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-28' GROUP BY 1, 2),
full_ AS (SELECT listing FROM prices GROUP BY 1 HAVING count(*) = 28),
ranked AS (SELECT *, (day - DATE '2024-01-01') // 7 AS week, isodow(day) AS weekday FROM prices),
best AS (SELECT *, row_number() OVER (PARTITION BY listing, week ORDER BY cents, day) AS rn, lead(cents) OVER (PARTITION BY listing, week ORDER BY cents, day) AS second FROM ranked),
weeks AS (SELECT listing, week, weekday, second - cents >= greatest(100, (5 * second + 99) // 100) AS clear FROM best WHERE rn = 1)"""


@query("his10_weekday_recommendation", with_("ev") + WEEK + """ SELECT l.listing, CASE WHEN f.listing IS NULL THEN 'insufficient' WHEN w.ok AND w.n = 1 THEN 'recommended' ELSE 'no_pattern' END AS status,
CASE WHEN f.listing IS NOT NULL AND w.ok AND w.n = 1 THEN w.weekday END AS weekday
FROM (SELECT DISTINCT listing FROM ev) l LEFT JOIN full_ f USING (listing) LEFT JOIN (SELECT listing, bool_and(clear) AS ok, count(DISTINCT weekday) AS n, min(weekday) AS weekday FROM weeks GROUP BY 1) w USING (listing)""")
def his10(spark, sf_dir):
    """A weekday that was the only clear minimum in each of four covered weeks."""
    e = event_observations(spark, sf_dir)
    first = F.lit("2024-01-01").cast("date")
    prices = e.where(F.col("day").between("2024-01-01", "2024-01-28") & F.col("band").isNotNull()).groupBy("listing", "day").agg((F.min("band") * 100 + 400).alias("cents"))
    full = prices.groupBy("listing").agg(F.count("*").alias("n_days"))
    w = Window.partitionBy("listing", "week").orderBy("cents", "day")
    dated = prices.withColumn("week", F.floor(F.datediff("day", first) / 7)).withColumn("weekday", (F.weekday("day") + 1).cast("long"))
    best = dated.withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead("cents").over(w)).where("rn = 1")
    clear = F.expr("second - cents >= greatest(100, (5 * second + 99) div 100)")
    weeks = best.groupBy("listing").agg(F.bool_and(clear).alias("ok"), F.count_distinct("weekday").alias("n"), F.min("weekday").alias("weekday"))
    all_ = e.select("listing").distinct().join(full, "listing", "left").join(weeks, "listing", "left")
    good = (F.col("n_days") == 28) & F.col("ok") & (F.col("n") == 1)
    enough = F.coalesce(F.col("n_days") == 28, F.lit(False))
    return all_.select("listing", F.when(~enough, "insufficient").when(good, "recommended").otherwise("no_pattern").alias("status"), F.when(good, F.col("weekday")).alias("weekday"))


@query("his14_price_change_audit", with_("states", "days") + """, c AS (SELECT s.listing, epoch_us(s.valid_from) - epoch_us(p.last_at) AS gap FROM states s ASOF JOIN (SELECT listing, seen_at AS last_at FROM ev WHERE available) p ON p.listing = s.listing AND p.last_at < s.valid_from WHERE s.previous_band IS NOT NULL)
SELECT listing % 4 AS retailer, count(*) AS changes, count(*) FILTER (WHERE gap > 36 * 3600000000) AS spaced FROM c GROUP BY 1""")
def his14(spark, sf_dir):
    """Changes of price, and those whose last sight of the old price is more than 36 hours before."""
    w = Window.partitionBy("listing").orderBy("at")
    seen = usable(spark, sf_dir).withColumns({"before": F.lag("band").over(w), "before_at": F.lag("at").over(w)})
    changed = seen.where("before is not null and band <> before")
    gap = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("before_at").cast("timestamp"))
    return changed.groupBy((F.col("listing") % 4).alias("retailer")).agg(F.count("*").alias("changes"), F.count_if(gap > 36 * 3_600_000_000).alias("spaced"))


@query("his15_top_depth", with_("states") + " SELECT listing, count(*) AS n_states FROM states GROUP BY 1 HAVING count(*) > 1 ORDER BY n_states DESC, listing LIMIT 20")
def his15(spark, sf_dir):
    return price_states(usable(spark, sf_dir)).groupBy("listing").agg(F.count("*").alias("n_states")).where("n_states > 1").orderBy(F.desc("n_states"), "listing").limit(20)


@query("his16_mixed_days", DAILY + " SELECT listing % 4 AS retailer, count(*) FILTER (WHERE band IS NOT NULL) AS comparable, count(*) FILTER (WHERE band IS NULL) AS mixed FROM daily GROUP BY 1")
def his16(spark, sf_dir):
    return daily_prices(spark, sf_dir).groupBy((F.col("listing") % 4).alias("retailer")).agg(F.count_if(F.col("band").isNotNull()).alias("comparable"), F.count_if(F.col("band").isNull()).alias("mixed"))


@query("his17_history_digest", with_("states") + " SELECT listing, md5(string_agg(epoch_us(valid_from) || ':' || band, ',' ORDER BY valid_from)) AS digest FROM states GROUP BY 1")
def his17(spark, sf_dir):
    """A checksum of each listing's states in order."""
    told = F.transform(F.array_sort(F.collect_list(F.struct(micros("valid_from").alias("at"), "band"))), lambda s: F.concat_ws(":", s["at"], s["band"]))
    return price_states(usable(spark, sf_dir)).groupBy("listing").agg(F.md5(F.array_join(told, ",")).alias("digest"))


@query("jon15_no_other_price", DAILY + " SELECT listing, count(*) AS n_clean FROM daily WHERE band IS NOT NULL GROUP BY 1")
def jon15(spark, sf_dir):
    """Days in whose window no other price was seen."""
    return daily_prices(spark, sf_dir).where("band is not null").groupBy("listing").agg(F.count("*").alias("n_clean"))
