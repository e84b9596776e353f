"""Streaming ingest: text lines of a folder become rows of the fact table, each request once."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..operators import aggregates
from ..schema import DEDUP_KEY
from ..sources.records import decode, normalize, position, push_number
from ..sources.storage import lines


def record_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def event_stream(raw: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Normalized rows, duplicates that arrive within the window dropped.

    The watermark is that of arrival, so no row is late, whatever its own time: records from the future or
    long past count like others. A key is forgotten once the watermark, the window behind the last
    arrival, has passed the window's end. store() gives the rows their ingest_seq.
    """
    rows = normalize(decode(raw), F.current_timestamp(), settings, seq=F.lit(0).cast("long"))
    if settings.dedup_window_minutes:
        arrived = rows.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", f"{settings.dedup_window_minutes} minutes")
        rows = arrived.dropDuplicatesWithinWatermark(list(DEDUP_KEY)).drop("arrived")
    return rows


def store(events: DataFrame, table_path: str, checkpoint: str, settings: Settings = Settings(), once: bool = False) -> StreamingQuery:
    """Add micro-batches to a Parquet table and, if the settings say so, to JSON lines.

    Rows past the retention time are counted, not stored; ingested() tells how many. ingest_seq grows from batch to
    batch. A batch that runs again after a failure replaces its own folders, so rows, lines and counts are stored once.
    """

    def write(batch: DataFrame, number: int) -> None:
        now = F.lit(datetime.datetime.now(datetime.timezone.utc))
        expired = F.col("ts") < now - F.make_interval(days=F.lit(settings.retention_days)) if settings.retention_days else F.lit(False)
        rows = batch.withColumns({"ingest_seq": push_number(number) + position(), "_expired": F.coalesce(expired, F.lit(False))}).persist()
        try:
            rows.filter("NOT _expired").drop("_expired").write.mode("overwrite").parquet(f"{table_path}/batch={number}")
            rows.agg(F.count("*").alias("rows"), F.count_if(F.col("_expired")).alias("expired")).write.mode("overwrite").parquet(f"{table_path}-counts/batch={number}")
            if settings.storage_enabled:
                lines(rows.filter("NOT _expired")).write.mode("overwrite").text(f"{settings.storage_path}/batch={number}")
        finally:
            rows.unpersist()

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": f"{settings.storage_flush_interval_seconds} seconds"}
    return writer.trigger(**trigger).start()


def stored(spark: SparkSession, table_path: str) -> DataFrame:
    """The rows that store() has written."""
    return spark.read.parquet(table_path).drop("batch")


def ingested(spark: SparkSession, table_path: str) -> DataFrame:
    """One row: requests that came in without repeats, and how many of them were past the retention time."""
    return spark.read.parquet(f"{table_path}-counts").agg(F.sum("rows").alias("rows"), F.sum("expired").alias("expired"))


def running_counts(events: DataFrame) -> DataFrame:
    """Requests, successes, failures and tokens by api and model, kept up to date."""
    return events.groupBy("api", "model").agg(*aggregates.measures4())


def keep_latest(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run over all input there is and leave the newest counts in a Parquet folder (complete mode: a row for each group)."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
