"""Streaming ingestion: daily coverage with a watermark, price states by a stateful fold, and an idempotent sink."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, name: str = "events*") -> DataFrame:
    """Landed event files as a stream of usable observations."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    seen = raw.where("event_type <> 'error'")
    return seen.select("event_id", F.col("user_id").alias("listing"), F.col("ts").cast("timestamp").alias("at"), F.floor(F.col("value") / 25).alias("band"))


def daily_coverage(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """First and last instant and number of observations by listing and Lima day; late data beyond the delay is dropped."""
    lima = F.window("at", "1 day", startTime="5 hours")
    deduped = stream.withWatermark("at", delay).dropDuplicatesWithinWatermark(["listing", "at"])
    return deduped.groupBy("listing", lima.alias("day")).agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n")).select("listing", F.to_date(F.col("day.start") - F.expr("interval 5 hours")).alias("day"), "first_at", "last_at", "n")


def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of one listing's price in order of time; equal or older observations than the last are replays."""
    last_at, last_band = state.get if state.exists else (-1, None)
    frame = pd.concat(list(frames)).sort_values("at", kind="stable")
    rows = []
    for at, band in zip(frame["at"].astype("int64"), frame["band"]):
        if at > last_at:
            if last_band is None or band != last_band:
                rows.append((key[0], band, pd.Timestamp(at, unit="ns" if at > 10**17 else "us"), last_band))
            last_at, last_band = at, band
    state.update((int(last_at), None if last_band is None else int(last_band)))
    yield pd.DataFrame(rows, columns=["listing", "band", "valid_from", "previous_band"])


def price_changes(stream: DataFrame) -> DataFrame:
    """New price states as they begin, by a fold whose state is the last time and price of a listing."""
    return stream.groupBy("listing").applyInPandasWithState(fold, "listing long, band long, valid_from timestamp, previous_band long", "last_at long, last_band long", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """All that has landed, once; a batch rewritten after a failure takes the place of its first attempt."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
