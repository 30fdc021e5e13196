"""Control tables: sources, leases, demand, refresh priority, run logs and read models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lists as L
from ..operators.folds import ordered_fold
from ..session import shared_path
from ..sources.domain import event_observations, latest_offers, read, with_
from ..streaming import acquisition as A
from . import query
from .offers import AGE, age_days
from .unit_prices import PRICED

HOUR = 3_600_000_000
us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))

#: A source is a customer's nation and segment; its cursor and clock follow from its customers.
SOURCES = """sources AS (SELECT c_nationkey % 4 AS retailer, c_mktsegment || '/' || c_nationkey AS key, count(*) AS pages, CAST(sum(c_custkey) % 48 AS BIGINT) AS idle_hours, min(c_custkey) % 5 AS failures FROM customer GROUP BY 1, 2)"""


def sources(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.groupBy((F.col("c_nationkey") % 4).alias("retailer"), F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("key")).agg(
        F.count("*").alias("pages"), (F.sum("c_custkey") % 48).alias("idle_hours"), (F.min("c_custkey") % 5).alias("failures"))


@query("ing15_refresh_outcomes", with_("ev") + """, o AS (SELECT listing, seen_at, CASE type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'observed' WHEN 'view' THEN 'unchanged' ELSE 'unavailable' END AS outcome FROM ev)
SELECT listing, max_by(outcome, seen_at) AS outcome, count(*) FILTER (WHERE outcome = 'failed') AS failures, epoch_us(max(seen_at) FILTER (WHERE outcome = 'observed')) AS observed_us FROM o GROUP BY 1""")
def ing15(spark, sf_dir):
    """The outcome events of a listing folded in order."""
    outcome = F.when(F.col("type") == "error", "failed").when(F.col("type") == "purchase", "observed").when(F.col("type") == "view", "unchanged").otherwise("unavailable")
    o = event_observations(spark, sf_dir).withColumn("outcome", outcome)
    return o.groupBy("listing").agg(F.max_by("outcome", "at").alias("outcome"), F.count_if(F.col("outcome") == "failed").alias("failures"), F.unix_micros(F.max(F.when(F.col("outcome") == "observed", F.col("at"))).cast("timestamp")).alias("observed_us"))


@query("ing16_source_registration", f"""WITH {SOURCES}, old AS (SELECT retailer, key, pages FROM sources WHERE idle_hours % 3 <> 0), new AS (SELECT retailer, key, pages + CASE WHEN failures = 1 THEN 1 ELSE 0 END AS pages FROM sources WHERE idle_hours % 4 <> 1)
SELECT coalesce(o.retailer, n.retailer) AS retailer, coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'created' WHEN n.key IS NULL THEN 'deactivated' WHEN o.pages <> n.pages THEN 'reset' ELSE 'kept' END AS state FROM old o FULL JOIN new n ON o.retailer = n.retailer AND o.key = n.key""")
def ing16(spark, sf_dir):
    """New sources start, changed ones begin again, absent ones go inactive."""
    s = sources(spark, sf_dir)
    old = s.where("idle_hours % 3 <> 0").select("retailer", "key", F.col("pages").alias("was"))
    new = s.where("idle_hours % 4 <> 1").select("retailer", "key", (F.col("pages") + F.when(F.col("failures") == 1, 1).otherwise(0)).alias("now"))
    state = F.when(F.col("was").isNull(), "created").when(F.col("now").isNull(), "deactivated").when(F.col("was") != F.col("now"), "reset").otherwise("kept")
    return old.join(new, ["retailer", "key"], "full").select("retailer", "key", state.alias("state"))


#: Attempts at pages folded by source: each row is the state after an event.
ACQUIRED = with_("ev", recursive=True).replace("ev AS", "raw AS (SELECT event_id, user_id AS source, epoch_us(ts) AS t, CAST(floor(value / 25) AS BIGINT) AS found, event_type AS type FROM events), ev AS", 1) + f""",
att AS (SELECT source, event_id, t, found, row_number() OVER (PARTITION BY source ORDER BY t, event_id) AS k, CASE WHEN type = 'error' THEN CASE found WHEN 0 THEN 'crash' WHEN 1 THEN 'redirect' ELSE 'failure' END WHEN type = 'purchase' THEN 'cycle' WHEN type = 'signup' THEN 'request' ELSE 'page' END AS kind FROM raw),
acq(source, k, event_id, t, outcome, cursor_, cycle, last_cycle, pages, products, lease_until, due, requested, completed, attempted, error) AS (
SELECT DISTINCT source, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::VARCHAR FROM att
UNION ALL SELECT source, k, event_id, t, o,
CASE WHEN o = 'page' THEN cursor_ + {A.PAGE} WHEN o IN ('cycle', 'limited') THEN 0 ELSE cursor_ END, CASE WHEN o = 'page' THEN cycle + found WHEN o IN ('cycle', 'limited') THEN 0 ELSE cycle END,
CASE WHEN o = 'cycle' THEN cycle + found ELSE last_cycle END, pages + CASE WHEN o IN ('page', 'cycle', 'limited') THEN 1 ELSE 0 END, products + CASE WHEN o IN ('page', 'cycle', 'limited') THEN found ELSE 0 END,
CASE WHEN o = 'crashed' THEN t + {A.LEASE} WHEN o IN ('page', 'cycle', 'limited', 'failed') THEN 0 ELSE lease_until END,
CASE o WHEN 'requested' THEN least(due, CASE WHEN completed = 0 THEN t ELSE completed + {A.AFTER_ASKED * A.HOUR} END) WHEN 'failed' THEN t + {A.AFTER_FAILURE * A.HOUR} WHEN 'page' THEN t
  WHEN 'crashed' THEN due WHEN 'leased' THEN due WHEN 'not_due' THEN due WHEN 'ignored' THEN due ELSE t + CASE WHEN requested > t - {24 * A.HOUR} THEN {A.AFTER_ASKED * A.HOUR} ELSE {A.AFTER_CYCLE * A.HOUR} END END,
CASE WHEN o = 'requested' THEN t ELSE requested END, CASE WHEN o = 'cycle' THEN t ELSE completed END, CASE WHEN o IN ('page', 'cycle', 'limited', 'failed', 'crashed') THEN t ELSE attempted END,
CASE WHEN o = 'failed' THEN CASE kind WHEN 'redirect' THEN 'redirect_to_home' ELSE 'source_or_persistence_failed' END WHEN o = 'cycle' THEN NULL WHEN o = 'limited' THEN 'pagination_limit' WHEN o = 'page' AND error IS DISTINCT FROM 'pagination_limit' THEN NULL ELSE error END
FROM (SELECT a.*, s.* EXCLUDE (source, k, event_id, t, outcome), CASE WHEN kind = 'request' THEN CASE WHEN error IS NOT DISTINCT FROM 'redirect_to_home' THEN 'ignored' ELSE 'requested' END WHEN lease_until > a.t THEN 'leased' WHEN due > a.t THEN 'not_due'
  WHEN kind = 'crash' THEN 'crashed' WHEN kind IN ('redirect', 'failure') THEN 'failed' WHEN kind = 'cycle' THEN 'cycle' WHEN cursor_ + {A.PAGE} > {A.LAST_FROM} THEN 'limited' ELSE 'page' END AS o FROM acq s JOIN att a ON a.source = s.source AND a.k = s.k + 1)),
last_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY k DESC) AS rn FROM acq) WHERE rn = 1 AND k > 0)"""


def acquired(spark, sf_dir):
    """The states after each attempt, by a fold of the whole event table."""
    def step(state, row):
        state, outcome = A.step(state, row["kind"], row["at_us"], row["found"])
        return state, {"source": row["source"], "event_id": row["event_id"], "at_us": row["at_us"], "outcome": outcome, **state}

    attempts = A.page_events(read(spark, sf_dir, "events")).drop("at")
    return ordered_fold(attempts, ["source"], ["at_us", "event_id"], A.start, step, A.OUT)


@query("ing17_lease_claim", ACQUIRED + f""", now_ AS (SELECT max(t) AS now_ FROM att), open_ AS (SELECT source % 4 AS retailer, l.* FROM last_ l, now_ WHERE due <= now_ AND lease_until <= now_)
SELECT retailer, arg_min(source, (CASE WHEN requested > 0 AND requested > completed THEN 0 ELSE 1 END, attempted, source)) AS source, count(*) AS open, (SELECT now_ + {A.LEASE} FROM now_) AS lease_until FROM open_ GROUP BY 1""")
def ing17(spark, sf_dir):
    """The source that each retailer claims after the last event, by what the attempts before have left, for five minutes."""
    now = F.unix_micros(F.col("now").cast("timestamp"))
    newest = read(spark, sf_dir, "events").agg(F.max("ts").alias("now")).select(now.alias("now"))
    states = acquired(spark, sf_dir).groupBy("source").agg(F.max_by(F.struct(*A.FIELDS), F.struct("at_us", "event_id")).alias("s")).select("source", "s.*")
    claimed = A.claims(states.join(F.broadcast(newest)), F.col("now"))  # one row
    return claimed.join(F.broadcast(newest)).select("retailer", "source", "open", (F.col("now") + A.LEASE).alias("lease_until"))


@query("ing18_page_completion", ACQUIRED + f""", ran_out AS (SELECT source, ((t + {A.LEASE}) // 1000) * 1000 AS at_us FROM acq WHERE outcome = 'crashed')
SELECT source, event_id, t AS at_us, outcome, cursor_ AS cursor, cycle, last_cycle, pages, products, due, error FROM acq WHERE k > 0
UNION ALL SELECT source, NULL, at_us, 'lease_expired', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ran_out WHERE at_us <= (SELECT max(t) - 600000000 FROM att)""")
def ing18(spark, sf_dir):
    """Cursor, counters, back-off and leases of each source after each attempt, by keyed state over the event stream; leases run out by timers."""
    from ..streaming import ingest

    A.state_store(spark)
    folder = shared_path(spark, "stream")
    ingest.run_once(A.acquisition(A.page_stream(spark, sf_dir)), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select("source", "event_id", "at_us", "outcome", "cursor", "cycle", "last_cycle", "pages", "products", "due", "error")


#: Demand: the lower-cased first three words of user turns.
DEMAND = """asked AS (SELECT conv_id, turn, lower(regexp_extract(text, '^(\\S+ \\S+)', 1)) AS q FROM conversations WHERE role = 'user'),
demand AS (SELECT q, count(*) AS n, min(conv_id) AS first_id, max(conv_id) AS last_id FROM asked WHERE length(q) BETWEEN 3 AND 80 GROUP BY 1)"""


#: Conversations stand for time: the last is now, a tenth of them is a day, a third of them a month.
CLOCK = "clock AS (SELECT max(conv_id) AS now, (max(conv_id) - min(conv_id)) // 10 AS day, (max(conv_id) - min(conv_id)) // 3 AS month FROM conversations)"


def clock(spark, sf_dir):
    """One row: now, and the lengths of a day and a month."""
    c = read(spark, sf_dir, "conversations").agg(F.max("conv_id").alias("now"), (F.max("conv_id") - F.min("conv_id")).alias("span"))
    return F.broadcast(c.select("now", F.expr("span div 10").alias("day"), F.expr("span div 3").alias("month")))


def demand(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").where("role = 'user'")
    asked = c.select("conv_id", F.lower(F.regexp_extract("text", "^(\\S+ \\S+)", 1)).alias("q"))
    return asked.where(F.length("q").between(3, 80)).groupBy("q").agg(F.count("*").alias("n"), F.min("conv_id").alias("first_id"), F.max("conv_id").alias("last_id"))


@query("ing19_demand_upsert", f"WITH {DEMAND} SELECT q, n, first_id, last_id FROM demand")
def ing19(spark, sf_dir):
    return demand(spark, sf_dir)


@query("ing20_demand_claim", f"WITH {DEMAND}, {CLOCK}, left_ AS (SELECT greatest(0, 240 - count(*)) AS n FROM demand, clock WHERE last_id > now - day), ranked AS (SELECT q, d.n, row_number() OVER (ORDER BY d.n DESC, first_id, q) AS rn FROM demand d, clock WHERE last_id <= now - day) SELECT q, n FROM ranked WHERE rn <= (SELECT least(20, n) FROM left_)")
def ing20(spark, sf_dir):
    """The most asked queries that were not asked within a day, twenty at most and within what the day's asking has left of 240."""
    known = demand(spark, sf_dir).join(clock(spark, sf_dir))
    left = known.where("last_id > now - day").agg(F.greatest(F.lit(0), 240 - F.count("*")).alias("left"))
    first = known.where("last_id <= now - day").orderBy(F.desc("n"), "first_id", "q").limit(20)
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "first_id", "q"))  # of twenty rows
    return first.withColumn("rn", rank).join(F.broadcast(left)).where("rn <= left").select("q", "n")


@query("ing21_demand_cleanup", f"WITH {DEMAND}, {CLOCK} SELECT q FROM demand, clock WHERE last_id < now - month AND last_id <= now - day ORDER BY last_id, q LIMIT 100")
def ing21(spark, sf_dir):
    """The hundred oldest queries that nobody has asked for a month and that are off their cooldown."""
    known = demand(spark, sf_dir).join(clock(spark, sf_dir))
    return known.where("last_id < now - month and last_id <= now - day").orderBy("last_id", "q").limit(100).select("q")


@query("ing22_demand_outcome", with_("latest") + f", {DEMAND}, " + """heads AS (SELECT DISTINCT substr(lower(w), 1, 2) AS head, retailer FROM (SELECT unnest(string_split(p_name, ' ')) AS w, l.retailer FROM latest l JOIN part ON p_partkey = l.part)),
n AS (SELECT head, count(*) AS retailers FROM heads GROUP BY 1)
SELECT q, CASE WHEN NOT regexp_matches(q, '[a-z]') THEN 'failed' WHEN n.retailers IS NULL THEN 'no_results' WHEN n.retailers < 4 THEN 'partial' ELSE 'completed' END AS outcome FROM demand LEFT JOIN n ON n.head = substr(q, 1, 2)""")
def ing22(spark, sf_dir):
    """A query fails without a letter, has no results where no product word begins as it does, is partial where not all four retailers sell one."""
    words = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.explode(F.split("p_name", " ")).alias("w"))
    heads = latest_offers(spark, sf_dir).join(words, "part").select(F.substring(F.lower("w"), 1, 2).alias("head"), "retailer").distinct()
    n = heads.groupBy("head").agg(F.count("*").alias("retailers"))
    asked = demand(spark, sf_dir).withColumn("head", F.substring("q", 1, 2)).join(n, "head", "left")
    outcome = F.when(~F.col("q").rlike("[a-z]"), "failed").when(F.col("retailers").isNull(), "no_results").when(F.col("retailers") < 4, "partial").otherwise("completed")
    return asked.select("q", outcome.alias("outcome"))


@query("ing23_run_log", with_("ev") + " SELECT listing % 4 AS retailer, day, epoch_us(min(seen_at)) AS started_us, epoch_us(max(seen_at)) AS finished_us, count(*) FILTER (WHERE available) AS accepted, CASE WHEN bool_or(NOT available) THEN 'partial' ELSE 'success' END AS status FROM ev GROUP BY 1, 2")
def ing23(spark, sf_dir):
    e = event_observations(spark, sf_dir)
    return e.groupBy((F.col("listing") % 4).alias("retailer"), "day").agg(
        F.unix_micros(F.min("at").cast("timestamp")).alias("started_us"), F.unix_micros(F.max("at").cast("timestamp")).alias("finished_us"),
        F.count_if("available").alias("accepted"), F.when(F.bool_or(~F.col("available")), "partial").otherwise("success").alias("status"))


#: Changes of customers' lists in order: a line saves its product's kind, a returned one removes it, each by the device that its order's priority names.
LIST_OPS = """WITH RECURSIVE ops AS (SELECT o_custkey AS owner, l_orderkey AS ok, l_linenumber AS ln, CAST(left(o_orderpriority, 1) AS INTEGER) AS device, l_returnflag = 'R' AS removes, p_brand || '/' || p_type AS item, CAST(l_quantity AS BIGINT) AS amount,
  row_number() OVER (PARTITION BY o_custkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS k FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)"""


def list_operations(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ok"), F.col("o_custkey").alias("owner"), F.left("o_orderpriority", F.lit(1)).cast("int").alias("device"))
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.concat_ws("/", "p_brand", "p_type").alias("item"))
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("part"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("at_us"),
        (F.col("l_returnflag") == "R").alias("removes"), F.col("l_quantity").cast("long").alias("amount"))
    return lines.join(orders, "ok").join(part, "part").drop("part")


@query("ing24_cas_list_mutation", LIST_OPS + f""", fold(owner, k, ok, ln, expected, status, revision, items, known) AS (
SELECT DISTINCT owner, 0::BIGINT, NULL::BIGINT, NULL::INTEGER, NULL::BIGINT, NULL::VARCHAR, 0::BIGINT, []::VARCHAR[], [0, 0, 0, 0, 0]::BIGINT[] FROM ops
UNION ALL SELECT owner, k, ok, ln, expected, status, CASE WHEN status = 'saved' OR status = 'removed' THEN revision + 1 ELSE revision END,
  CASE status WHEN 'saved' THEN CASE WHEN list_contains(items, item) THEN items ELSE list_append(items, item) END WHEN 'removed' THEN list_filter(items, lambda x: x <> item) ELSE items END,
  list_transform(known, lambda x, i: CASE WHEN i <> device THEN x WHEN status = 'saved' OR status = 'removed' THEN revision + 1 ELSE revision END)
FROM (SELECT o.*, f.revision, f.items, f.known, f.known[o.device] AS expected, CASE WHEN f.known[o.device] <> f.revision THEN 'conflict' WHEN removes AND NOT list_contains(f.items, item) THEN 'unchanged' WHEN removes THEN 'removed'
  WHEN NOT list_contains(f.items, item) AND len(f.items) >= {L.CAPACITY} THEN 'rejected' ELSE 'saved' END AS status FROM fold f JOIN ops o ON o.owner = f.owner AND o.k = f.k + 1))
SELECT owner, ok, ln, expected, status, revision, CAST(len(items) AS BIGINT) AS items FROM fold WHERE k > 0""")
def ing24(spark, sf_dir):
    """Each change of a customer's list, given the revision that its device expects: saved, removed, unchanged, in conflict or rejected."""
    return L.mutate(list_operations(spark, sf_dir), ["at_us", "ok", "ln"]).select("owner", "ok", "ln", "expected", "status", "revision", "items")


@query("ing25_refresh_demand", f"WITH {SOURCES}, wanted AS (SELECT DISTINCT c_nationkey % 4 AS retailer, c_mktsegment || '/' || c_nationkey AS key FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') SELECT s.retailer, s.key, least(s.idle_hours, 4) AS next_hours FROM sources s JOIN wanted USING (retailer, key)")
def ing25(spark, sf_dir):
    """Sources that somebody with an urgent open order waits for come due within four hours."""
    urgent = read(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    c = read(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_semi")
    wanted = c.select((F.col("c_nationkey") % 4).alias("retailer"), F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("key"))
    return sources(spark, sf_dir).join(wanted, ["retailer", "key"], "left_semi").select("retailer", "key", F.least("idle_hours", F.lit(4)).alias("next_hours"))


@query("rfr01_refresh_eligibility", with_("latest") + f" SELECT part, retailer FROM latest WHERE {AGE} >= 6 AND cents > 0")
def rfr01(spark, sf_dir):
    """Listings whose evidence is old enough and that have a path to fetch them by, which those without a price lack."""
    return latest_offers(spark, sf_dir).where((age_days() >= 6) & (F.col("cents") > 0)).select("part", "retailer")


#: Where the wish to refresh a listing comes from: it is compared in public, on an open list, asked for, a staple, or none of these.
ORIGINS = """open_parts AS (SELECT DISTINCT l_partkey AS part FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'), public_parts AS (SELECT part FROM latest GROUP BY 1 HAVING count(*) = 4),
heads AS (SELECT DISTINCT substr(q, 1, 3) AS head FROM demand), origins AS (SELECT l.*, CASE WHEN p.part IS NOT NULL THEN 0 WHEN o.part IS NOT NULL THEN 1 WHEN h.head IS NOT NULL THEN 2 WHEN split_part(p_name, ' ', 2) IN ('widget', 'anvil') THEN 3 ELSE 4 END AS origin
FROM latest l JOIN part ON p_partkey = l.part LEFT JOIN public_parts p ON p.part = l.part LEFT JOIN open_parts o ON o.part = l.part LEFT JOIN heads h ON h.head = substr(p_name, 1, 3))"""


def origins(spark, sf_dir):
    """Latest offers with the origin of the wish to refresh them."""
    latest = latest_offers(spark, sf_dir)
    urgent = read(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    listed = read(spark, sf_dir, "lineitem").join(urgent, "l_orderkey", "left_semi").select(F.col("l_partkey").alias("part")).distinct().withColumn("listed", F.lit(True))
    public = latest.groupBy("part").agg(F.count("*").alias("n")).where("n = 4").select("part", F.lit(True).alias("public"))
    asked = demand(spark, sf_dir).select(F.substring("q", 1, 3).alias("head")).distinct().withColumn("asked", F.lit(True))
    names = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.substring("p_name", 1, 3).alias("head"), F.split_part("p_name", F.lit(" "), F.lit(2)).isin("widget", "anvil").alias("staple"))
    known = latest.join(names, "part").join(public, "part", "left").join(listed, "part", "left").join(asked, "head", "left")
    origin = F.when(F.col("public"), 0).when(F.col("listed"), 1).when(F.col("asked"), 2).when(F.col("staple"), 3).otherwise(4)
    return known.withColumn("origin", origin)


@query("rfr02_refresh_priority", with_("latest") + f", {DEMAND}, {ORIGINS} SELECT part, retailer, origin FROM origins WHERE {AGE} >= 6 ORDER BY origin, seen_at, part, retailer LIMIT 500")
def rfr02(spark, sf_dir):
    """The first 500 by origin, then age, then identity."""
    return origins(spark, sf_dir).where(age_days() >= 6).orderBy("origin", "at", "part", "retailer").limit(500).select("part", "retailer", "origin")


@query("rfr03_refresh_pool", with_("latest") + f", {DEMAND}, {ORIGINS}, pool AS (SELECT * FROM origins WHERE {AGE} >= 6 ORDER BY seen_at, part, retailer LIMIT 5000) SELECT origin, count(*) AS n FROM pool GROUP BY 1")
def rfr03(spark, sf_dir):
    """Eligible listings, the 5000 oldest, by origin."""
    pool = origins(spark, sf_dir).where(age_days() >= 6).orderBy("at", "part", "retailer").limit(5000)
    return pool.groupBy("origin").agg(F.count("*").alias("n"))


@query("rdm01_acquisition_status", f"WITH {SOURCES} SELECT retailer, count(*) AS sources, count(*) FILTER (WHERE idle_hours >= 20) AS due, min(idle_hours) AS newest, max(idle_hours) AS oldest, CAST(sum(pages) AS BIGINT) AS pages FROM sources GROUP BY 1")
def rdm01(spark, sf_dir):
    return sources(spark, sf_dir).groupBy("retailer").agg(F.count("*").alias("sources"), F.count_if(F.col("idle_hours") >= 20).alias("due"), F.min("idle_hours").alias("newest"), F.max("idle_hours").alias("oldest"), F.sum("pages").alias("pages"))


@query("rdm02_discovery_inspection", f"WITH {DEMAND} SELECT q, n FROM demand ORDER BY n DESC, q LIMIT 100")
def rdm02(spark, sf_dir):
    return demand(spark, sf_dir).orderBy(F.desc("n"), "q").limit(100).select("q", "n")


@query("rdm03_discovery_completion", f"WITH {DEMAND} SELECT d.q, count(*) AS n_turns FROM asked a JOIN demand d ON d.q = a.q AND d.last_id = a.conv_id GROUP BY 1")
def rdm03(spark, sf_dir):
    """Of all attempts at a query the last one's results count, and late results of earlier ones do not: a join on both keys."""
    c = read(spark, sf_dir, "conversations").where("role = 'user'")
    attempts = c.select(F.col("conv_id").alias("last_id"), F.lower(F.regexp_extract("text", "^(\\S+ \\S+)", 1)).alias("q"))
    return attempts.join(demand(spark, sf_dir), ["q", "last_id"]).groupBy("q").agg(F.count("*").alias("n_turns"))


@query("rdm04_ingestion_inspection", with_("ev") + " SELECT event_id, listing, type FROM ev ORDER BY seen_at DESC, event_id LIMIT 10")
def rdm04(spark, sf_dir):
    return event_observations(spark, sf_dir).orderBy(F.desc("at"), "event_id").limit(10).select("event_id", "listing", "type")


@query("rdm10_empty_state", """SELECT c_custkey AS user_, coalesce(n, 0) AS revision FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def rdm10(spark, sf_dir):
    """An absent list has revision 0."""
    n = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_")).agg(F.count("*").alias("n"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_")).join(n, "user_", "left").select("user_", F.coalesce("n", F.lit(0)).alias("revision"))


@query("orc01_refresh_status", with_("ev") + """, s AS (SELECT day, listing % 4 AS retailer, bool_and(available) AS ok, bool_or(available) AS any_ FROM ev GROUP BY 1, 2)
SELECT day, CASE WHEN bool_and(ok) THEN 'success' WHEN bool_or(any_) THEN 'partial' ELSE 'failed' END AS status, bool_or(any_) AS derived FROM s GROUP BY 1""")
def orc01(spark, sf_dir):
    """A day succeeds if all retailers did; derivation runs if any part did."""
    s = event_observations(spark, sf_dir).groupBy("day", (F.col("listing") % 4).alias("retailer")).agg(F.bool_and("available").alias("ok"), F.bool_or("available").alias("any_"))
    return s.groupBy("day").agg(F.when(F.bool_and("ok"), "success").when(F.bool_or("any_"), "partial").otherwise("failed").alias("status"), F.bool_or("any_").alias("derived"))


@query("orc02_circuit_breaker", with_("ev") + """, n AS (SELECT listing, seen_at, available, row_number() OVER (PARTITION BY listing ORDER BY seen_at) - row_number() OVER (PARTITION BY listing, available ORDER BY seen_at) AS run FROM ev)
SELECT listing, max(c) AS longest, max(c) >= 3 AS opened FROM (SELECT listing, run, count(*) AS c FROM n WHERE NOT available GROUP BY 1, 2) GROUP BY 1""")
def orc02(spark, sf_dir):
    """Runs of failures in a row; three open the breaker."""
    by_time, same = Window.partitionBy("listing").orderBy("at"), Window.partitionBy("listing", "available").orderBy("at")
    run = F.row_number().over(by_time) - F.row_number().over(same)
    runs = event_observations(spark, sf_dir).withColumn("run", run).where("not available").groupBy("listing", "run").agg(F.count("*").alias("c"))
    return runs.groupBy("listing").agg(F.max("c").alias("longest"), (F.max("c") >= 3).alias("opened"))


@query("orc03_discovery_run", f"WITH {DEMAND} SELECT count(*) AS queries, CAST(sum(n) AS BIGINT) AS asked, count(*) FILTER (WHERE n > 1) AS repeated FROM demand")
def orc03(spark, sf_dir):
    return demand(spark, sf_dir).agg(F.count("*").alias("queries"), F.sum("n").alias("asked"), F.count_if(F.col("n") > 1).alias("repeated"))


@query("orc07_configuration_identity", f"WITH {SOURCES} SELECT retailer, sha256(string_agg(key || ':' || pages, ',' ORDER BY key)) AS identity FROM sources GROUP BY 1")
def orc07(spark, sf_dir):
    told = F.transform(F.array_sort(F.collect_list(F.struct("key", "pages"))), lambda s: F.concat_ws(":", s["key"], s["pages"]))
    return sources(spark, sf_dir).groupBy("retailer").agg(F.sha2(F.array_join(told, ","), 256).alias("identity"))


@query("orc08_cron_cadence", "WITH h AS (SELECT user_id AS source, list_sort(list(DISTINCT hour(ts))) AS hours, count(*) FILTER (WHERE event_type = 'error') > count(*) FILTER (WHERE event_type = 'purchase') AS often FROM events GROUP BY 1) SELECT source, CASE WHEN often THEN '*/5 * * * *' ELSE '0 ' || array_to_string(hours, ',') || ' * * *' END AS cron, CASE WHEN NOT often THEN CAST(len(hours) AS BIGINT) END AS runs FROM h")
def orc08(spark, sf_dir):
    """Runs a day of each source's schedule: the hours of its attempts, or, where most of them fail, every few minutes, which is no list of hours."""
    e = read(spark, sf_dir, "events")
    often = F.count_if(F.col("event_type") == "error") > F.count_if(F.col("event_type") == "purchase")
    hours = F.array_join(F.transform(F.array_sort(F.collect_set(F.hour("ts"))), lambda h: h.cast("string")), ",")
    crons = e.groupBy(F.col("user_id").alias("source")).agg(F.when(often, "*/5 * * * *").otherwise(F.concat(F.lit("0 "), hours, F.lit(" * * *"))).alias("cron"))
    runs = F.size(F.split(F.split("cron", " ")[1], ",")).cast("long")
    return crons.select("source", "cron", F.when(F.col("cron").rlike("^[0-9]+ [0-9]+(,[0-9]+)* \\* \\* \\*$"), runs).alias("runs"))


@query("orc09_daily_request_cap", f"WITH {SOURCES} SELECT CAST(3 * (sum(pages) + count(*)) + 60 * count(DISTINCT retailer) AS BIGINT) AS requests FROM sources")
def orc09(spark, sf_dir):
    return sources(spark, sf_dir).agg((3 * (F.sum("pages") + F.count("*")) + 60 * F.count_distinct("retailer")).alias("requests"))


@query("cls11_failure_severity", with_("ev") + " SELECT event_id, CASE WHEN type <> 'error' THEN 'none' WHEN band >= 4 THEN 'warning' ELSE 'error' END AS severity FROM ev")
def cls11(spark, sf_dir):
    severity = F.when(F.col("type") != "error", "none").when(F.col("band") >= 4, "warning").otherwise("error")
    return event_observations(spark, sf_dir).select("event_id", severity.alias("severity"))


#: What the address of a page asks for, and the words that a storefront knows.
ASKED_MODE = "CASE WHEN page_no IN ('2', '3') THEN 'benefits' ELSE page_no END"


@query("hlp01_mode_parse", f"""WITH u AS (SELECT page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page_no, regexp_extract(url, '[?&]ref=([^&#]*)', 1) AS ref FROM pages), r AS (SELECT page_id, {ASKED_MODE} AS raw_mode, CASE ref WHEN 'x' THEN 'unit' ELSE ref END AS raw_sort FROM u)
SELECT page_id, CASE WHEN raw_mode IN ('standard', 'benefits') THEN raw_mode ELSE 'standard' END AS mode, CASE WHEN raw_sort IN ('relevance', 'total', 'unit') THEN raw_sort ELSE 'relevance' END AS sort FROM r""")
def hlp01(spark, sf_dir):
    """Price mode and order that the address of each page asks for; unknown words mean the defaults."""
    param = lambda name: F.regexp_extract("url", f"[?&]{name}=([^&#]*)", 1)
    mode, sort = F.when(param("page").isin("2", "3"), "benefits").otherwise(param("page")), F.when(param("ref") == "x", "unit").otherwise(param("ref"))
    known = lambda raw, words: F.when(raw.isin(*words), raw).otherwise(words[0])
    return read(spark, sf_dir, "pages").select("page_id", known(mode, ["standard", "benefits"]).alias("mode"), known(sort, ["relevance", "total", "unit"]).alias("sort"))


@query("hlp03_demand_predicate", f"WITH {DEMAND} SELECT q FROM demand WHERE NOT EXISTS (SELECT 1 FROM part WHERE starts_with(p_name, split_part(q, ' ', 1)))")
def hlp03(spark, sf_dir):
    """Queries whose first word begins no product name; a name can only begin with a word as its own first letters do, so these are the join's key."""
    names = read(spark, sf_dir, "part").select("p_name", F.substring("p_name", 1, 2).alias("head")).distinct()
    asked = demand(spark, sf_dir).withColumn("word", F.split_part("q", F.lit(" "), F.lit(1))).withColumn("head", F.substring("word", 1, 2))
    short = F.length("word") < 2
    long_ = asked.where(~short).join(names.withColumnRenamed("head", "h"), (F.col("head") == F.col("h")) & F.startswith("p_name", "word"), "left_anti")
    first = names.select(F.substring("p_name", 1, 1).alias("word")).distinct()
    return long_.select("q").union(asked.where(short & (F.col("word") != "")).join(first, "word", "left_anti").select("q"))


@query("hlp04_lima_days", with_("ev") + " SELECT day, day + 1 AS next_day, count(*) AS n FROM ev GROUP BY 1")
def hlp04(spark, sf_dir):
    return event_observations(spark, sf_dir).groupBy("day").agg(F.count("*").alias("n")).select("day", F.date_add("day", 1).alias("next_day"), "n")


@query("hlp06_result_blocks", PRICED + " SELECT coalesce(basis, 'unknown') AS unit_block, CASE WHEN type = 'LARGE' THEN 'direct' ELSE 'package' END AS total_block, count(*) AS n, min(cents) AS low FROM priced GROUP BY 1, 2")
def hlp06(spark, sf_dir):
    """The block of each offer when sorted by unit price (its basis, or unknown) and by total (quoted by weight, or a package)."""
    from .unit_prices import priced_offers

    offers = priced_offers(spark, sf_dir)
    return offers.groupBy(F.coalesce("basis", F.lit("unknown")).alias("unit_block"), F.when(F.col("weighed"), "direct").otherwise("package").alias("total_block")).agg(F.count("*").alias("n"), F.min("cents").alias("low"))
