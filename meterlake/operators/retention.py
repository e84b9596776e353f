"""Duplicates, retention by time and by number, and merging of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..schema import DEDUP_KEY, TOKENS


def first_arrivals(events: DataFrame) -> DataFrame:
    """One row for each dedup key, the first that arrived."""
    w = Window.partitionBy(*DEDUP_KEY).orderBy("ingest_seq", "ts")
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def distinct_keys(events: DataFrame) -> DataFrame:
    return events.select(*DEDUP_KEY).distinct()


def without_known(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of new whose key isn't stored; keys compare null-safe, column by column."""
    keys = distinct_keys(stored).select(*(F.col(k).alias(f"_{k}") for k in DEDUP_KEY))
    return new.join(keys, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in DEDUP_KEY], "left_anti")


def dedup_live(events: DataFrame, window_minutes: int) -> DataFrame:
    """The rule of live ingest in event time; a window of 0 keeps all rows.

    The time is part of the key, so rows of one key lie in one window whatever its length. Arrival
    times, which a running stream has, are the business of streaming.ingest.
    """
    return first_arrivals(events) if window_minutes else events


def within(events: DataFrame, now: Column, days: int) -> DataFrame:
    """Rows in the retention time, or without a time; 0 days keep all."""
    return events if days == 0 else events.filter(F.col("ts").isNull() | (F.col("ts") >= now - F.make_interval(days=F.lit(days))))


def cap_rows(events: DataFrame, most: int | None) -> DataFrame:
    """The newest `most` rows of each api and model; 0 keeps none, None all.

    Spark drops what can't be among them before the shuffle.
    """
    if most is None:
        return events
    if most == 0:
        return events.filter("false")
    w = Window.partitionBy("api", "model").orderBy(F.desc("ts"), F.desc("ingest_seq"))
    return events.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def prune(events: DataFrame, now: Column, days: int, most: int | None) -> DataFrame:
    return cap_rows(within(events, now, days), most)


def evicted(events: DataFrame, now: Column, days: int, most: int | None) -> DataFrame:
    """How many rows prune removes, by time and by number."""
    kept = within(events, now, days)
    return events.agg(F.count("*").alias("n")).crossJoin(kept.agg(F.count("*").alias("recent"))).crossJoin(cap_rows(kept, most).agg(F.count("*").alias("kept"))).select(  # three single rows
        (F.col("n") - F.col("recent")).alias("expired"), (F.col("recent") - F.col("kept")).alias("capped"), (F.col("n") - F.col("kept")).alias("evicted"))


def normalize_import(rows: DataFrame, now: Column) -> DataFrame:
    """Imported rows (with outer_api, outer_model) as rows of the fact table: keys, times and totals made good."""
    own = T.trim(F.col("model"))
    named = rows.withColumns({
        "model": T.model_name(F.when((own != "") & (own != "unknown"), own).otherwise(F.col("outer_model"))),
        "ts": F.coalesce("ts", now),
        "utc_offset": F.coalesce("utc_offset", F.lit("Z")),
        "latency_ms": N.non_negative(F.col("latency_ms")),
        "ttft_ms": N.non_negative(F.col("ttft_ms")),
        "total_tokens": N.total_tokens(F.col("total_tokens"), F.col("input_tokens"), F.col("output_tokens"), F.col("reasoning_tokens")),
    })
    c = F.col
    return named.withColumn("api", T.rekey(c("outer_api"), c("provider"), c("source"), c("base_url"), c("auth_index"), c("auth_id")))


def negative_tokens(rows: DataFrame) -> DataFrame:
    """Rows with a token count below 0; one of them rejects a whole document."""
    return rows.filter(F.least(*(F.col(t) for t in TOKENS)) < 0)


def classify_import(rows: DataFrame, stored: DataFrame, now: Column, days: int) -> DataFrame:
    """rows with an outcome: rejected (blank api), ignored_by_retention, skipped (known or repeated), added."""
    keys = distinct_keys(stored).select(*(F.col(k).alias(f"_{k}") for k in DEDUP_KEY)).withColumn("_known", F.lit(True))
    marked = rows.join(keys, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in DEDUP_KEY], "left").drop(*(f"_{k}" for k in DEDUP_KEY))
    expired = F.lit(False) if days == 0 else F.coalesce(F.col("ts") < now - F.make_interval(days=F.lit(days)), F.lit(False))
    blank = T.trim(F.col("outer_api")) == "" if "outer_api" in rows.columns else F.lit(False)
    early = marked.withColumn("outcome", F.when(blank, "rejected").when(expired, "ignored_by_retention").when(F.col("_known"), "skipped"))
    w = Window.partitionBy(*DEDUP_KEY, F.col("outcome")).orderBy("ingest_seq")
    return early.withColumn("outcome", F.coalesce("outcome", F.when(F.row_number().over(w) == 1, "added").otherwise("skipped"))).drop("_known")


def import_counts(classified: DataFrame) -> DataFrame:
    """One row: input, accepted, rejected, added, skipped and ignored records."""
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    return classified.agg(
        F.count("*").alias("input_records"), n("added", "skipped", "ignored_by_retention").alias("accepted_records"), n("rejected").alias("rejected_records"),
        n("added").alias("added"), n("skipped").alias("skipped"), n("ignored_by_retention").alias("ignored_by_retention"))


def merge(stored: DataFrame, rows: DataFrame, now: Column, days: int, most: int | None) -> tuple[DataFrame, DataFrame]:
    """The pruned union of stored and what rows add, and the import counts."""
    classified = classify_import(rows, stored, now, days)
    new = classified.filter("outcome = 'added'").select(*stored.columns)
    return prune(stored.unionByName(new), now, days, most), import_counts(classified)
