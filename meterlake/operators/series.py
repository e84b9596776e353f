"""Time grids with gaps filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prices import with_cost

# Slots of the health grid and their length.
SLOTS, SLOT_MINUTES = 672, 15


def health_grid(events: DataFrame, now: Column, slots: int = SLOTS, minutes: int = SLOT_MINUTES) -> DataFrame:
    """slot, start, total, success and failure of each of the slots up to now, empty ones too.

    The grid starts `slots` lengths before now and isn't aligned to the clock. A slot is cut towards
    zero, so rows up to one length before the grid count for its first slot; rows at or after now don't count.
    """
    start = now - F.make_interval(mins=F.lit(slots * minutes))
    slot = F.call_function("div", F.unix_micros("ts") - F.unix_micros(start), F.lit(minutes * 60_000_000)).alias("slot")
    counts = events.filter(F.col("ts") > start - F.make_interval(mins=F.lit(minutes))).select(slot, "failed").filter(F.col("slot").between(0, slots - 1))
    counts = counts.groupBy("slot").agg(F.count("*").alias("total"), F.count_if(~F.col("failed")).alias("success"), F.count_if(F.col("failed")).alias("failure"))
    grid = events.sparkSession.range(slots).withColumnRenamed("id", "slot")
    zero = F.lit(0).cast("long")
    filled = grid.join(counts, "slot", "left").select("slot", *(F.coalesce(c, zero).alias(c) for c in ("total", "success", "failure")))
    return filled.withColumn("start", F.timestamp_micros(F.unix_micros(start) + F.col("slot") * (minutes * 60_000_000)))


def health_rate(grid: DataFrame) -> DataFrame:
    """Success rate of the whole grid in percent; 100 if it is empty."""
    return grid.agg(F.sum("total").alias("total"), F.sum("success").alias("success")).select("total", "success", F.round(F.when(F.col("total") == 0, 100.0).otherwise(F.col("success") / F.col("total") * 100), 6).alias("success_rate"))


def bucket_series(events: DataFrame, prices: DataFrame, now: Column, metric: str = "requests", minutes: int = 60, count: int = 24) -> DataFrame:
    """bucket, value: requests, tokens or cost in `count` buckets that end now."""
    length = minutes * 60_000_000
    start = F.unix_micros(now) - count * length
    rows = with_cost(events, prices) if metric == "cost" else events
    value = {"requests": F.count("*").cast("double"), "tokens": F.sum("total_tokens").cast("double"), "cost": F.round(F.sum("cost"), 6) if metric == "cost" else F.lit(0.0)}[metric]
    bucket = F.floor((F.unix_micros("ts") - start) / length).cast("long").alias("bucket")
    sums = rows.filter((F.unix_micros("ts") >= start) & (F.unix_micros("ts") < F.unix_micros(now))).withColumn("bucket", bucket).groupBy("bucket").agg(value.alias("value"))
    grid = events.sparkSession.range(count).withColumnRenamed("id", "bucket")
    return grid.join(sums, "bucket", "left").select("bucket", F.coalesce("value", F.lit(0.0)).alias("value"))
