"""Ingestion: price states, coverage days, evidence, admission and fingerprints, as batch folds over observations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.domain import event_observations, parts, price_observations, price_states, read, with_
from . import query


def usable(spark, sf_dir):
    return event_observations(spark, sf_dir).where("available")


def coverage_days(spark, sf_dir):
    """First and last usable observation of each listing on each Lima day, and their number."""
    return usable(spark, sf_dir).groupBy("listing", "day").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n"))


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


@query("ing01_price_state_changed", with_("changes") + " SELECT listing, epoch_us(valid_from) AS at_us, band, previous_band FROM changes")
def ing01(spark, sf_dir):
    """Observations whose price differs from the one before, or that have none before."""
    return price_states(usable(spark, sf_dir)).select("listing", micros("valid_from").alias("at_us"), "band", "previous_band")


@query("ing02_scd2_fold", with_("states") + " SELECT listing, band, epoch_us(valid_from) AS from_us, epoch_us(valid_until) AS until_us FROM states")
def ing02(spark, sf_dir):
    """Half-open states, the last of each listing open."""
    return price_states(usable(spark, sf_dir)).select("listing", "band", micros("valid_from").alias("from_us"), micros("valid_until").alias("until_us"))


@query("ing03_listing_upsert", with_("ev") + """ SELECT listing, max(epoch_us(seen_at)) AS seen_us, max_by(type, seen_at) AS type,
max_by(band, seen_at) FILTER (WHERE available) AS band FROM ev GROUP BY listing""")
def ing03(spark, sf_dir):
    """The newest row of each listing; the price is that of the last usable one."""
    return event_observations(spark, sf_dir).groupBy("listing").agg(
        F.max(micros("at")).alias("seen_us"), F.max_by("type", "at").alias("type"), F.max_by("band", F.when(F.col("available"), F.col("at"))).alias("band"))


@query("ing04_availability_evidence", with_("ev") + """, e AS (SELECT listing, seen_at, CASE WHEN type = 'error' THEN false WHEN type = 'purchase' THEN true END AS evidence FROM ev)
SELECT listing, max_by(evidence, seen_at) FILTER (WHERE evidence IS NOT NULL) AS available, max(epoch_us(seen_at)) FILTER (WHERE evidence IS NOT NULL) AS verified_us FROM e GROUP BY listing""")
def ing04(spark, sf_dir):
    """The newest explicit evidence; unknown ones never erase it."""
    evidence = F.when(F.col("type") == "error", False).when(F.col("type") == "purchase", True)
    e = event_observations(spark, sf_dir).withColumn("evidence", evidence).withColumn("known_at", F.when(evidence.isNotNull(), F.col("at")))
    return e.groupBy("listing").agg(F.max_by("evidence", "known_at").alias("available"), F.max(micros("known_at")).alias("verified_us"))


@query("ing05_missing_counter", with_("ev") + """, last AS (SELECT listing, max(seen_at) FILTER (WHERE available) AS ok_at FROM ev GROUP BY 1)
SELECT e.listing, count(*) FILTER (WHERE NOT available AND (ok_at IS NULL OR seen_at > ok_at)) AS missing FROM ev e JOIN last USING (listing) GROUP BY 1""")
def ing05(spark, sf_dir):
    """Misses since the last usable observation."""
    e = event_observations(spark, sf_dir)
    seen = F.max(F.when(F.col("available"), F.col("at"))).over(Window.partitionBy("listing"))
    return e.withColumn("ok_at", seen).groupBy("listing").agg(F.count_if(~F.col("available") & (F.col("ok_at").isNull() | (F.col("at") > F.col("ok_at")))).alias("missing"))


#: Listings that are kept at most.
CAPACITY = 6_000


@query("ing06_capacity_admission", with_("obs") + f""", seen AS (SELECT part, retailer, min(seen_at) AS first_at, min(ok) AS first_ok FROM obs GROUP BY 1, 2),
known AS (SELECT * FROM seen WHERE first_at < TIMESTAMP '1996-01-01'), new AS (SELECT *, row_number() OVER (ORDER BY first_at, first_ok, part, retailer) AS position FROM seen WHERE first_at >= TIMESTAMP '1996-01-01')
SELECT part, retailer, true AS was_known FROM known UNION ALL SELECT part, retailer, false FROM new WHERE position <= {CAPACITY} - (SELECT count(*) FROM known)""")
def ing06(spark, sf_dir):
    """Known listings, and as many new ones, in source order, as these leave room for.

    No more new ones than the whole capacity can be admitted, so only so many, the first, are numbered.
    """
    seen = price_observations(spark, sf_dir).groupBy("part", "retailer").agg(F.min("at").alias("first_at"), F.min("ok").alias("first_ok"))
    cutoff = F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")
    known, order = seen.where(F.col("first_at") < cutoff), ["first_at", "first_ok", "part", "retailer"]
    first = seen.where(F.col("first_at") >= cutoff).orderBy(*order).limit(CAPACITY)
    numbered = first.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    room = known.agg((F.lit(CAPACITY) - F.count("*")).alias("room"))
    admitted = numbered.join(F.broadcast(room), F.col("position") <= F.col("room"))
    return known.select("part", "retailer", F.lit(True).alias("was_known")).union(admitted.select("part", "retailer", F.lit(False)))


@query("ing07_close_open_states", with_("states") + " SELECT listing, count(*) FILTER (WHERE valid_until IS NOT NULL) AS closed, count(*) FILTER (WHERE valid_until IS NULL) AS opened FROM states GROUP BY 1")
def ing07(spark, sf_dir):
    return price_states(usable(spark, sf_dir)).groupBy("listing").agg(F.count_if(F.col("valid_until").isNotNull()).alias("closed"), F.count_if(F.col("valid_until").isNull()).alias("opened"))


@query("ing08_open_new_states", with_("ev") + """, old AS (SELECT DISTINCT listing FROM ev WHERE available AND seen_at < TIMESTAMP '2024-01-03 00:00:00')
SELECT listing, max_by(band, seen_at) AS band FROM ev WHERE available AND NOT EXISTS (SELECT 1 FROM old WHERE old.listing = ev.listing) GROUP BY 1""")
def ing08(spark, sf_dir):
    """States of listings that had none before a cut-off."""
    e = usable(spark, sf_dir)
    old = e.where(F.col("at") < F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"))
    return e.join(old, "listing", "left_anti").groupBy("listing").agg(F.max_by("band", "at").alias("band"))


@query("ing09_daily_coverage", with_("days") + " SELECT listing, day, epoch_us(first_at) AS first_us, epoch_us(last_at) AS last_us, n FROM days")
def ing09(spark, sf_dir):
    return coverage_days(spark, sf_dir).select("listing", "day", micros("first_at").alias("first_us"), micros("last_at").alias("last_us"), "n")


@query("ing10_benefit_sync", with_("ev") + """, last AS (SELECT listing, max(seen_at) AS seen_at FROM ev WHERE available GROUP BY 1)
SELECT e.listing, e.type AS program, e.band FROM ev e JOIN last l ON l.listing = e.listing AND l.seen_at = e.seen_at WHERE e.type IN ('click', 'purchase')""")
def ing10(spark, sf_dir):
    """Benefits are those of the latest accepted observation alone."""
    e = usable(spark, sf_dir)
    last = e.groupBy("listing").agg(F.max("at").alias("at"))
    return e.join(last, ["listing", "at"]).where(F.col("type").isin("click", "purchase")).select("listing", F.col("type").alias("program"), "band")


@query("ing11_identity_invalidation", with_("parts") + """, old AS (SELECT part, sha256(name || '|' || brand || '|' || size) AS f FROM parts), new AS (SELECT part, sha256(CASE WHEN part % 7 = 0 THEN name || ' new' ELSE name END || '|' || brand || '|' || size) AS f FROM parts)
SELECT o.part, o.f <> n.f AS invalidated, CASE WHEN o.f <> n.f THEN '' ELSE n.f END AS fingerprint FROM old o JOIN new n USING (part)""")
def ing11(spark, sf_dir):
    """A changed title loses its derived fingerprint."""
    p = parts(spark, sf_dir)
    print_ = lambda name: F.sha2(F.concat_ws("|", name, "brand", F.col("size").cast("string")), 256)
    both = p.select("part", print_(F.col("name")).alias("o"), print_(F.when(F.col("part") % 7 == 0, F.concat("name", F.lit(" new"))).otherwise(F.col("name"))).alias("n"))
    return both.select("part", (F.col("o") != F.col("n")).alias("invalidated"), F.when(F.col("o") != F.col("n"), "").otherwise(F.col("n")).alias("fingerprint"))


@query("ing12_input_fingerprint", """SELECT p_partkey AS part, sha256('{"title":"' || p_name || '","priceUnit":"UN","packageText":null,"sourceBrand":"' || p_brand || '","sourceUnitMultiplier":null}') AS fingerprint FROM part""")
def ing12(spark, sf_dir):
    """SHA-256 of the inputs of normalisation as JSON, nulls and order of fields kept."""
    row = F.struct(F.col("p_name").alias("title"), F.lit("UN").alias("priceUnit"), F.lit(None).cast("string").alias("packageText"), F.col("p_brand").alias("sourceBrand"), F.lit(None).cast("double").alias("sourceUnitMultiplier"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256).alias("fingerprint"))


@query("ing13_incremental_normalization", with_("parts") + " SELECT part FROM parts p WHERE NOT EXISTS (SELECT 1 FROM parts d WHERE d.part = p.part AND d.part % 5 <> 0 AND d.size > 3)")
def ing13(spark, sf_dir):
    """Listings whose derived row is missing or out of date."""
    p = parts(spark, sf_dir)
    return p.join(p.where("part % 5 <> 0 and size > 3").select("part"), "part", "left_anti").select("part")


@query("ing14_upsert_if_changed", with_("parts") + """, old AS (SELECT part, name, size FROM parts WHERE part % 3 <> 0), new AS (SELECT part, name, CASE WHEN part % 10 = 1 THEN size + 1 ELSE size END AS size FROM parts WHERE part % 4 <> 1)
SELECT coalesce(o.part, n.part) AS part, CASE WHEN o.part IS NULL THEN 'created' WHEN n.part IS NULL THEN 'kept' WHEN o.name IS DISTINCT FROM n.name OR o.size IS DISTINCT FROM n.size THEN 'updated' ELSE 'unchanged' END AS outcome FROM old o FULL JOIN new n ON o.part = n.part""")
def ing14(spark, sf_dir):
    """Derived rows are written only where a field differs, by null-safe comparison of structs."""
    p = parts(spark, sf_dir)
    old = p.where("part % 3 <> 0").select(F.col("part").alias("o"), F.struct("name", "size").alias("was"))
    new = p.where("part % 4 <> 1").select(F.col("part").alias("n"), F.struct("name", F.when(F.col("part") % 10 == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size")).alias("now"))
    outcome = F.when(F.col("o").isNull(), "created").when(F.col("n").isNull(), "kept").when(~F.col("was").eqNullSafe(F.col("now")), "updated").otherwise("unchanged")
    return old.join(new, F.col("o") == F.col("n"), "full").select(F.coalesce("o", "n").alias("part"), outcome.alias("outcome"))


@query("jon16_recordset_join", """SELECT c_custkey AS customer, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus IN ('F', 'O') GROUP BY 1""")
def jon16(spark, sf_dir):
    """A set of input rows joined to their table."""
    wanted = spark.createDataFrame([("F",), ("O",)], "o_orderstatus string")
    orders = read(spark, sf_dir, "orders").join(F.broadcast(wanted), "o_orderstatus")  # two rows
    n = orders.groupBy(F.col("o_custkey").alias("customer")).agg(F.count("*").alias("n"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer")).join(n, "customer", "left").select("customer", F.coalesce("n", F.lit(0)).alias("n"))
