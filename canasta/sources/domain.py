"""The retail relations, derived from the star schema and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(price: str, quantity: str):
    """Integer cents of a price per piece; decimal before rounding, so that no double is rounded."""
    return F.round((F.col(price) / F.col(quantity)).cast("decimal(18,6)") * 100).cast("long")


def price_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, retailer (0 to 3), cents, at, and the order line (ok, ln) that breaks ties."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part"),
        (F.col("l_suppkey") % 4).alias("retailer"),
        cents("l_extendedprice", "l_quantity").alias("cents"),
        F.col("l_shipdate").alias("at"),
        F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").alias("ln"),
        F.col("l_returnflag").alias("flag"),
    )


def latest_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest observation of each listing (part at a retailer)."""
    newest = F.struct("at", "ok", "ln", "cents", "flag")
    return (
        price_observations(spark, sf_dir)
        .groupBy("part", "retailer")
        .agg(F.max(newest).alias("o"), F.count("*").alias("n_seen"), F.min("at").alias("first_at"))
        .select("part", "retailer", "o.at", "o.cents", "o.flag", "n_seen", "first_at")
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
        F.col("p_type").alias("type"), F.col("p_size").cast("long").alias("size"),
        F.round(F.col("p_retailprice").cast("decimal(18,6)") * 100).cast("long").alias("list_cents"),
    )


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """listing (user), at, band (a price of 25 units), available, type and the Lima day of each event."""
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("listing"),
        F.col("ts").alias("at"),
        F.floor(F.col("value") / 25).alias("band"),
        (F.col("event_type") != "error").alias("available"),
        F.col("event_type").alias("type"),
        F.to_date(F.from_utc_timestamp(F.col("ts"), "America/Lima")).alias("day"),
    )


def price_states(observations: DataFrame) -> DataFrame:
    """Slowly changing states of listings: listing, band, valid_from, valid_until (null: open), previous_band."""
    by_time = Window.partitionBy("listing").orderBy("at")
    before = F.lag("band").over(by_time)
    changed = observations.withColumn("previous_band", before).where(~F.col("band").eqNullSafe(F.col("previous_band")))
    return changed.select("listing", "band", F.col("at").alias("valid_from"), F.lead("at").over(by_time).alias("valid_until"), "previous_band")


#: The same relations as DuckDB common table expressions.
SQL = {
    "obs": """obs AS (SELECT l_partkey AS part, l_suppkey % 4 AS retailer,
        CAST(round(CAST(l_extendedprice / l_quantity AS DECIMAL(18,6)) * 100) AS BIGINT) AS cents,
        l_shipdate AS seen_at, l_orderkey AS ok, l_linenumber AS ln, l_returnflag AS flag FROM lineitem)""",
    "latest": """latest AS (SELECT part, retailer, seen_at, cents, flag, n_seen, first_at FROM (SELECT *,
        row_number() OVER (PARTITION BY part, retailer ORDER BY seen_at DESC, ok DESC, ln DESC) AS rn,
        count(*) OVER (PARTITION BY part, retailer) AS n_seen, min(seen_at) OVER (PARTITION BY part, retailer) AS first_at FROM obs) WHERE rn = 1)""",
    "parts": """parts AS (SELECT p_partkey AS part, p_name AS name, p_brand AS brand, p_type AS type, CAST(p_size AS BIGINT) AS size,
        CAST(round(CAST(p_retailprice AS DECIMAL(18,6)) * 100) AS BIGINT) AS list_cents FROM part)""",
    "ev": """ev AS (SELECT event_id, user_id AS listing, ts AS seen_at, CAST(floor(value / 25) AS BIGINT) AS band, event_type <> 'error' AS available,
        event_type AS type, CAST(timezone('America/Lima', timezone('UTC', ts)) AS DATE) AS day FROM events)""",
    "changes": """changes AS (SELECT listing, band, seen_at AS valid_from, previous_band FROM (SELECT *,
        lag(band) OVER (PARTITION BY listing ORDER BY seen_at) AS previous_band FROM ev WHERE available) WHERE band IS DISTINCT FROM previous_band)""",
    "states": """states AS (SELECT *, lead(valid_from) OVER (PARTITION BY listing ORDER BY valid_from) AS valid_until FROM changes)""",
    "days": """days AS (SELECT listing, day, min(seen_at) AS first_at, max(seen_at) AS last_at, count(*) AS n FROM ev WHERE available GROUP BY listing, day)""",
}


def with_(*names: str, recursive: bool = False) -> str:
    """A WITH clause of the named relations and those they rest on."""
    needs = {"latest": ["obs"], "changes": ["ev"], "states": ["changes"], "days": ["ev"]}
    out: list[str] = []

    def add(name: str) -> None:
        for n in needs.get(name, []):
            add(n)
        if name not in out:
            out.append(name)

    for n in names:
        add(n)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(SQL[n] for n in out)
