"""The `events` table as a usage log, in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..schema import EVENT_COLUMNS

PROVIDERS = ("harbour", "lantern", "quarry", "orchard")
PRICED = {"model-1": (30.0, 60.0, 15.0), "model-2": (10.0, 20.0, 1.0)}
SALT = "pepper"


def _blank_if(x: Column, test: Column) -> Column:
    return F.when(test, "").otherwise(x)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the fact table, one for each event."""
    u, e = F.col("user_id"), F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    provider = F.element_at(F.array(*(F.lit(p) for p in PROVIDERS)), (u % 4 + 1).cast("int"))
    source = _blank_if(F.concat(provider, F.lit("-site")), u % 11 == 0)
    raw_key = F.concat(F.lit("sk-tenant-"), F.lpad(u.cast("string"), 4, "0"))
    failed = F.col("event_type") == "error"
    rows = base(spark, sf_dir).select(
        "ts", e.alias("ingest_seq"), provider.alias("provider"), source.alias("source"), F.concat(F.lit("model-"), (u % 7).cast("string")).alias("model"),
        _blank_if(F.concat(F.lit("lane-"), F.lpad((u % 20).cast("string"), 2, "0")), u % 20 == 0).alias("auth_index"),
        T.mask_key(raw_key).alias("api_key"), T.hash_key(raw_key, SALT).alias("api_key_hash"),
        failed.alias("failed"), F.when(failed, 400 + k % 4).otherwise(200).cast("int").alias("status_code"),
        F.floor(F.col("value") * 10).cast("long").alias("latency_ms"), (k * 3).alias("ttft_ms"),
        (k * 10).alias("input_tokens"), (k * 2).alias("output_tokens"), (e % 50).alias("reasoning_tokens"), (k * 3).alias("cached_tokens"), ((e % 7) * 20).alias("cache_tokens"),
        F.when(e % 3 == 0, 0).otherwise(k * 12 + e % 50).cast("long").alias("raw_total"),
        F.when(failed, F.concat(F.lit("status "), (400 + k % 4).cast("string"))).otherwise("").alias("failure"))
    total = N.total_tokens(F.col("raw_total"), F.col("input_tokens"), F.col("output_tokens"), F.col("reasoning_tokens"))
    return rows.withColumns({
        "total_tokens": total, "api": T.join_names(F.col("provider"), F.col("source")), "utc_offset": F.lit("Z"),
        "auth_id": F.lit(""), "auth_type": F.lit(""), "base_url": F.lit(""), "thinking": T.thinking(F.lit("")), "headers": F.lit(None).cast("map<string,array<string>>"),
    }).select(*EVENT_COLUMNS)


def clock(spark: SparkSession, sf_dir: str) -> Column:
    """A second after the last event, as a literal, so that time filters are constants to the scan."""
    last = base(spark, sf_dir).agg(F.unix_micros(F.max("ts")).alias("x")).first()["x"]
    return F.timestamp_micros(F.lit((last or 0) + 1_000_000))


#: The same in DuckDB, as common table expressions `ev` and `clock`.
EV = """
ev0 AS (
  SELECT event_id AS ingest_seq, ts, user_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value,
         ['harbour', 'lantern', 'quarry', 'orchard'][(user_id % 4 + 1)::INT] AS provider FROM events),
ev1 AS (
  SELECT *, 'model-' || (user_id % 7) AS model, CASE WHEN user_id % 11 = 0 THEN '' ELSE provider || '-site' END AS source,
         CASE WHEN user_id % 20 = 0 THEN '' ELSE 'lane-' || lpad((user_id % 20)::VARCHAR, 2, '0') END AS auth_index,
         'sk-tenant-' || lpad(user_id::VARCHAR, 4, '0') AS raw_key, event_type = 'error' AS failed,
         (CASE WHEN event_type = 'error' THEN 400 + k % 4 ELSE 200 END)::INT AS status_code,
         floor(value * 10)::BIGINT AS latency_ms, k * 3 AS ttft_ms, k * 10 AS input_tokens, k * 2 AS output_tokens,
         ingest_seq % 50 AS reasoning_tokens, k * 3 AS cached_tokens, (ingest_seq % 7) * 20 AS cache_tokens,
         CASE WHEN ingest_seq % 3 = 0 THEN 0 ELSE k * 12 + ingest_seq % 50 END AS raw_total FROM ev0),
ev AS (
  SELECT *, 'sk' || '******' || right(raw_key, 2) AS api_key, CASE WHEN source = '' THEN provider ELSE provider || ' · ' || source END AS api,
         greatest(CASE WHEN raw_total <> 0 THEN raw_total ELSE input_tokens + output_tokens + reasoning_tokens END, 0) AS total_tokens,
         CASE WHEN failed THEN 'status ' || status_code ELSE '' END AS failure FROM ev1),
clock AS (SELECT max(ts) + INTERVAL 1 SECOND AS now FROM events)"""
M4 = "count(*)::BIGINT AS total_requests, count(*) FILTER (NOT failed)::BIGINT AS success_count, count(*) FILTER (failed)::BIGINT AS failure_count, coalesce(sum(total_tokens), 0)::BIGINT AS total_tokens"
M8 = M4 + ", coalesce(sum(greatest(input_tokens, 0)), 0)::BIGINT AS input_tokens, coalesce(sum(greatest(output_tokens, 0)), 0)::BIGINT AS output_tokens, coalesce(sum(greatest(cached_tokens, cache_tokens, 0)), 0)::BIGINT AS cached_tokens, coalesce(sum(greatest(reasoning_tokens, 0)), 0)::BIGINT AS reasoning_tokens"
LAT = "round(coalesce(avg(latency_ms) FILTER (latency_ms > 0), 0), 6) AS avg_latency_ms"
PRICE_ROWS = "prices(model, prompt, completion, cache) AS (VALUES " + ", ".join(f"('{m}', {p[0]}::DOUBLE, {p[1]}::DOUBLE, {p[2]}::DOUBLE)" for m, p in PRICED.items()) + ")"
COST = "coalesce((greatest(input_tokens - greatest(cached_tokens, 0), 0) * prompt + (greatest(output_tokens, 0) + greatest(reasoning_tokens, 0)) * completion + greatest(cached_tokens, 0) * cache) / 1e6, 0)"
