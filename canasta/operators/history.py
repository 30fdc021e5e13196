"""Price history as step paths: a sweep over states and covered periods, points, and streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def step_segments(states: DataFrame, periods: DataFrame, start: Column, end: Column) -> DataFrame:
    """listing, segment_from, from, until and price: the steps of each listing's price within its covered periods.

    A path is broken where a period ends or no state joins on, and stays within the range and the instants really
    observed. A path that lasts no time is no segment; the state that the last observation opens is its last step.

    One sweep over the sorted beginnings of both lists: each row knows the last period and the last state that began
    before it, so pieces come without joining states with periods, in the length of both lists.
    states: listing, price, from, until (the last observation for an open one) and open. periods: listing, first, last. Neither overlaps itself.
    """
    p = periods.select("listing", F.greatest("first", start).alias("at"), F.struct(F.greatest("first", start).alias("first"), F.least("last", end).alias("last")).alias("period"), F.lit(None).alias("state"))
    s = states.select("listing", F.greatest("from", start).alias("at"), F.lit(None).alias("period"), F.struct(F.greatest("from", start).alias("from"), F.least("until", end).alias("until"), "price", "open").alias("state"))
    # a state that ends before the range begins would begin at its start too
    p, s = p.where("period.last >= period.first"), s.where("state.until > state.from or (state.open and state.until = state.from)")
    begun = p.unionByName(s).groupBy("listing", "at").agg(F.max("period").alias("period"), F.max("state").alias("state"))
    by_time = Window.partitionBy("listing").orderBy("at")
    swept = begun.select("listing", "at", F.last("period", True).over(by_time).alias("p"), F.last("state", True).over(by_time).alias("s"))
    until = F.least("p.last", "s.until")
    pieces = swept.where(F.col("p").isNotNull() & F.col("s").isNotNull()).select("listing", F.col("p.first").alias("period"), F.col("at").alias("from"), until.alias("until"), F.col("s.price").alias("price"), F.col("s.open").alias("open"))
    pieces = pieces.where((F.col("from") < F.col("until")) | ((F.col("from") == F.col("until")) & F.col("open")))
    in_period = Window.partitionBy("listing", "period").orderBy("from", "until")
    broken = F.coalesce(F.lag("until").over(in_period) != F.col("from"), F.lit(True))
    path = Window.partitionBy("listing", "period", "path")
    numbered = pieces.withColumn("broken", broken.cast("int")).withColumn("path", F.sum("broken").over(in_period))
    placed = numbered.withColumns({"segment_from": F.min("from").over(path), "segment_until": F.max("until").over(path)})
    return placed.where("segment_from < segment_until").select("listing", "segment_from", "from", "until", "price")


def points(states: DataFrame, start: Column, end: Column) -> DataFrame:
    """listing, at, price and kind: the states that begin in the range, and the last observation of the open one."""
    began = states.where((F.col("from") >= start) & (F.col("from") <= end)).select("listing", F.col("from").alias("at"), "price", F.lit("state-start").alias("kind"))
    last = states.where(F.col("open") & (F.col("until") <= end) & (F.col("until") >= start) & (F.col("until") > F.col("from")))
    return began.union(last.select("listing", F.col("until").alias("at"), "price", F.lit("latest-observation").alias("kind")))


def unchanged_days(days: DataFrame) -> DataFrame:
    """listing and streak: verified days in a row back from day 0 that kept the price; null under two.

    days: listing, back (days before today) and kept.
    """
    kept = days.where("kept").withColumn("place", F.row_number().over(Window.partitionBy("listing").orderBy("back")) - 1)
    n = kept.where("place = back").groupBy("listing").agg(F.count("*").alias("n"))
    return n.select("listing", F.when(F.col("n") >= 2, F.col("n")).alias("streak"))
