"""Acquisition of catalogue pages: leases, cursors and back-off of sources as keyed state, and the stop rule of a run.

A source is a listing of the event stream, and an event an attempt at its next page: a view or click brings a page, a
purchase the last page of a cycle, a signup asks for a refresh, an error is a failed attempt (of price band 0: a crash
that leaves its lease; of band 1: a redirect to the home page; of others: a failed source). Pages discover as many
products as the band says.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000_000
LEASE = 300_000_000
#: Hours until a source is due: after a failure, after a cycle, and after a cycle that was asked for within a day.
AFTER_FAILURE, AFTER_CYCLE, AFTER_ASKED = 6, 20, 4
#: Products of a page, and the first product of the last page that is served.
PAGE, LAST_FROM = 20, 2_500
REDIRECTS = 3
#: The state of a source; times in microseconds, 0 for never.
FIELDS = ("cursor", "cycle", "last_cycle", "pages", "products", "lease_until", "due", "requested", "completed", "attempted", "error")
STATE = ", ".join(f"{f} {'string' if f == 'error' else 'long'}" for f in FIELDS)
OUT = "source long, event_id long, at_us long, outcome string, " + STATE


def page_events(events: DataFrame) -> DataFrame:
    """source, event_id, at, at_us, kind and found of an event table or stream."""
    band = F.floor(F.col("value") / 25)
    failed = F.when(band == 0, "crash").when(band == 1, "redirect").otherwise("failure")
    kind = F.when(F.col("event_type") == "error", failed).when(F.col("event_type") == "purchase", "cycle").when(F.col("event_type") == "signup", "request").otherwise("page")
    at = F.col("ts").cast("timestamp")
    return events.select(F.col("user_id").alias("source"), "event_id", at.alias("at"), F.unix_micros(at).alias("at_us"), kind.alias("kind"), band.alias("found"))


def page_stream(spark: SparkSession, folder: str, name: str = "events*") -> DataFrame:
    """Landed event files as a stream of :func:`page_events`."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return page_events(spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder))


def start() -> dict:
    return dict.fromkeys(FIELDS, 0) | {"error": None}


def step(s: dict, kind: str, at: int, found: int) -> tuple[dict, str]:
    """The next state of a source and what became of an event."""
    if kind == "request":
        if s["error"] == "redirect_to_home":
            return s, "ignored"
        wanted = (s["completed"] or at - AFTER_ASKED * HOUR) + AFTER_ASKED * HOUR
        return s | {"requested": at, "due": min(s["due"], wanted)}, "requested"
    if s["lease_until"] > at:
        return s, "leased"
    if s["due"] > at:
        return s, "not_due"
    s = s | {"attempted": at, "lease_until": 0}
    if kind == "crash":
        return s | {"lease_until": at + LEASE}, "crashed"
    if kind in ("redirect", "failure"):
        return s | {"due": at + AFTER_FAILURE * HOUR, "error": "redirect_to_home" if kind == "redirect" else "source_or_persistence_failed"}, "failed"
    s |= {"pages": s["pages"] + 1, "products": s["products"] + found}
    over = at + (AFTER_ASKED if s["requested"] > max(0, at - 24 * HOUR) else AFTER_CYCLE) * HOUR
    if kind == "cycle":
        return s | {"cursor": 0, "last_cycle": s["cycle"] + found, "cycle": 0, "completed": at, "due": over, "error": None}, "cycle"
    if s["cursor"] + PAGE > LAST_FROM:
        return s | {"cursor": 0, "cycle": 0, "due": over, "error": "pagination_limit"}, "limited"
    return s | {"cursor": s["cursor"] + PAGE, "cycle": s["cycle"] + found, "due": at, "error": s["error"] if s["error"] == "pagination_limit" else None}, "page"


class SourceProcessor(StatefulProcessor):
    """One value state a source; a timer for each lease that a crash leaves."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("source", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        state = dict(zip(FIELDS, self.state.get())) if self.state.exists() else start()
        frame = pd.concat(list(rows)).sort_values(["at_us", "event_id"], kind="stable")
        out = []
        for event_id, at, kind, found in zip(frame["event_id"].tolist(), frame["at_us"].tolist(), frame["kind"], frame["found"].tolist()):
            state, outcome = step(state, kind, at, found)
            if outcome == "crashed":
                self.handle.registerTimer(state["lease_until"] // 1000)
            out.append((key[0], event_id, at, outcome, *(state[f] for f in FIELDS)))
        self.state.update(tuple(state[f] for f in FIELDS))
        yield pd.DataFrame(out, columns=["source", "event_id", "at_us", "outcome", *FIELDS])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        """The lease of a crashed attempt is over; an attempt after that may have taken the source already."""
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        yield pd.DataFrame([(key[0], None, at, "lease_expired", *(None for _ in FIELDS))], columns=["source", "event_id", "at_us", "outcome", *FIELDS])

    def close(self) -> None:
        pass


def acquisition(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """What became of each attempt at a page, with the source's state after it, and a row for each lease that ran out.

    Attempts of a source must not come later than ``delay`` behind the newest of all. The session's state store must be RocksDB (:func:`state_store`).
    """
    return stream.withWatermark("at", delay).groupBy("source").transformWithStateInPandas(SourceProcessor(), OUT, "Append", "EventTime")


def state_store(spark: SparkSession) -> None:
    """Sets the state store that keyed timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def claims(states: DataFrame, at: Column) -> DataFrame:
    """The source that each retailer claims next, of the sources due at an instant and not leased.

    Sources asked for since their last cycle come first, then those never attempted and attempted longest ago.
    states: source and FIELDS.
    """
    open_ = states.where((F.col("due") <= at) & (F.col("lease_until") <= at)).withColumn("retailer", F.col("source") % 4)
    asked = (F.col("requested") > 0) & (F.col("requested") > F.col("completed"))
    first = F.min_by("source", F.struct((~asked).alias("asked"), "attempted", "source"))
    return open_.groupBy("retailer").agg(first.alias("source"), F.count("*").alias("open"))


def stop_rule(events: DataFrame) -> DataFrame:
    """event_id, run (retailer and day), streak (redirects in a row) and attempted of the page attempts of :func:`page_events`.

    A run stops for good after ``REDIRECTS`` redirects to the home page in a row; what would come later is not attempted.
    """
    run = ["retailer", "day"]
    day = F.to_date(F.from_utc_timestamp("at", "America/Lima"))
    tries = events.where("kind <> 'request'").withColumns({"retailer": F.col("source") % 4, "day": day, "redirect": F.col("kind") == "redirect"})
    by_time = Window.partitionBy(*run).orderBy("at_us", "event_id")
    # redirects since the last attempt that was none
    island = F.count_if(~F.col("redirect")).over(by_time)
    streak = F.count_if("redirect").over(Window.partitionBy(*run, "island").orderBy("at_us", "event_id"))
    counted = tries.withColumn("island", island).withColumn("streak", F.when(F.col("redirect"), streak).otherwise(0))
    over = F.max((F.col("streak") >= REDIRECTS).cast("int")).over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    return counted.select("event_id", *run, "streak", (F.coalesce(over, F.lit(0)) == 0).alias("attempted"))
