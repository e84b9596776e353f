"""Roll-ups of requests, tokens, latency and cost. Each is one hash aggregation, combined before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from .prices import with_cost

LATENCY_DIGITS = 6


def _long(x: Column) -> Column:
    return F.coalesce(x, F.lit(0)).cast("long")


def measures4() -> list[Column]:
    """Requests, successes, failures, tokens."""
    tokens = N.total_tokens(F.col("total_tokens"), F.col("input_tokens"), F.col("output_tokens"), F.col("reasoning_tokens"))
    return [
        F.count("*").alias("total_requests"),
        F.count_if(~F.col("failed")).alias("success_count"),
        F.count_if(F.col("failed")).alias("failure_count"),
        _long(F.sum(tokens)).alias("total_tokens"),
    ]


def measures8() -> list[Column]:
    return measures4() + [
        _long(F.sum(N.non_negative(F.col("input_tokens")))).alias("input_tokens"),
        _long(F.sum(N.non_negative(F.col("output_tokens")))).alias("output_tokens"),
        _long(F.sum(N.cached_tokens(F.col("cached_tokens"), F.col("cache_tokens")))).alias("cached_tokens"),
        _long(F.sum(N.non_negative(F.col("reasoning_tokens")))).alias("reasoning_tokens"),
    ]


def mean_positive(x: Column) -> Column:
    """The mean of what is above 0; 0 if nothing is."""
    return F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0))


def latency() -> Column:
    return F.round(mean_positive(F.col("latency_ms")), LATENCY_DIGITS).alias("avg_latency_ms")


def overall(events: DataFrame) -> DataFrame:
    return events.agg(*measures8(), latency())


def by_api(events: DataFrame) -> DataFrame:
    return events.groupBy("api").agg(*measures8(), latency())


def by_api_model(events: DataFrame) -> DataFrame:
    return events.groupBy("api", "model").agg(*measures8(), latency())


def hierarchy(events: DataFrame) -> DataFrame:
    """All, each api, and each api and model in one pass; level 0, 1, 2. Null api or model: summed over."""
    grouped = events.rollup("api", "model").agg(F.grouping_id().alias("g"), *measures8(), latency())
    return grouped.withColumn("level", F.when(F.col("g") == 3, 0).when(F.col("g") == 1, 1).otherwise(2)).drop("g")


def by_model(events: DataFrame) -> DataFrame:
    return events.groupBy("model").agg(*measures8(), latency())


def by_source(events: DataFrame) -> DataFrame:
    """Blank sources under one name; the provider is that of the earliest row."""
    first = F.min_by("provider", F.struct("ts", "ingest_seq")).alias("provider")
    return events.groupBy(T.or_default(F.col("source"), T.UNKNOWN_SOURCE).alias("source")).agg(first, *measures4())


def by_credential(events: DataFrame) -> DataFrame:
    return events.groupBy(T.or_default(F.col("auth_index"), T.BLANK_CREDENTIAL).alias("auth_index")).agg(*measures4())


def with_client(events: DataFrame) -> DataFrame:
    return events.withColumn("client", T.client_group(F.col("api_key"), F.col("api_key_hash")))


def by_client(events: DataFrame) -> DataFrame:
    """Clients with one masked key are one; the hash is that of the earliest row."""
    order = F.struct("ts", "ingest_seq")
    return with_client(events).groupBy("client").agg(F.min_by(T.client_label(F.col("api_key")), order).alias("label"), F.min_by("api_key_hash", order).alias("api_key_hash"), *measures8())


def by_client_model(events: DataFrame) -> DataFrame:
    return with_client(events).groupBy("client", "model").agg(*measures8())


def nested_models(models: DataFrame, fields: list[str]) -> DataFrame:
    """client and the list of its models, most requests first."""
    ordered = F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: F.when(a["total_requests"] > b["total_requests"], -1).when(a["total_requests"] < b["total_requests"], 1).when(a["model"] < b["model"], -1).when(a["model"] > b["model"], 1).otherwise(0))
    return models.groupBy("client").agg(ordered.alias("models"))


def clients_nested(events: DataFrame) -> DataFrame:
    """by_client with a list of its models, most requests first."""
    models = by_client_model(events)
    return by_client(events).join(nested_models(models, [c for c in models.columns if c != "client"]), "client")


def by_day(events: DataFrame) -> DataFrame:
    return _by_time(events, N.day_key(F.col("ts"), F.col("utc_offset")).alias("day"))


def by_hour(events: DataFrame) -> DataFrame:
    """Hour of day over all days, each row in its own zone."""
    return _by_time(events, N.hour_key(F.col("ts"), F.col("utc_offset")).alias("hour"))


def _by_time(events: DataFrame, key: Column) -> DataFrame:
    requests, _, _, tokens = measures4()
    return events.groupBy(key).agg(requests.alias("requests"), tokens.alias("tokens"))


def grouped(events: DataFrame, prices: DataFrame, key: Column, label: Column) -> DataFrame:
    """Any grouping: requests, successes, failures, tokens, cost of the rows, mean positive latencies; most requests first."""
    rows = with_cost(events.withColumns({"_key": key, "_label": label}), prices)
    out = rows.groupBy(F.col("_key").alias("key")).agg(
        F.min_by("_label", F.struct("ts", "ingest_seq")).alias("label"), *measures4(),
        _long(F.sum(N.cached_tokens(F.col("cached_tokens"), F.col("cache_tokens")))).alias("cached_tokens"),
        _long(F.sum("reasoning_tokens")).alias("reasoning_tokens"),
        F.round(F.sum("cost"), 6).alias("cost"),
        F.round(mean_positive(F.col("latency_ms")), LATENCY_DIGITS).alias("avg_latency_ms"),
        F.round(mean_positive(F.col("ttft_ms")), LATENCY_DIGITS).alias("avg_ttft_ms"))
    return out.orderBy(F.desc("total_requests"), "key")


def errors(events: DataFrame, most: int = 10, default: str = "-") -> DataFrame:
    """The most frequent failures by status and text; a feature-limited list."""
    status = F.when(F.col("status_code") != 0, F.col("status_code").cast("string")).otherwise("-").alias("status")
    return events.filter("failed").groupBy(status, T.or_default(F.col("failure"), default).alias("error")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status", "error").limit(most)


def with_rate(stats: DataFrame) -> DataFrame:
    rate = N.success_rate(F.col("success_count"), F.col("total_requests"))
    return stats.withColumns({"success_rate": F.round(rate, 6), "rate_class": N.rate_class(rate)})


def distinct_counts(events: DataFrame) -> DataFrame:
    """Models and sources of each api."""
    return events.groupBy("api").agg(F.count_distinct("model").alias("models"), F.count_distinct("source").alias("sources"))


def trailing_rpm(events: DataFrame, now: Column) -> DataFrame:
    """Requests a minute over the 60 minutes up to now."""
    inside = (F.col("ts") > now - F.expr("INTERVAL 1 HOUR")) & (F.col("ts") <= now)
    return events.agg(F.round(F.count_if(inside) / 60, 6).alias("rpm"))


def summary_metrics(events: DataFrame) -> DataFrame:
    """Number of rows, of distinct dedup keys, and the last time."""
    from ..schema import DEDUP_KEY

    return events.agg(F.count("*").alias("detail_count"), F.count_distinct(F.struct(*DEDUP_KEY)).alias("seen_count"), F.max("ts").alias("last_recorded_at"))


def top_bars(stats: DataFrame, name: str, value: str, most: int = 8) -> DataFrame:
    """The largest values with bar widths in percent of the largest, 4 at least."""
    top = stats.select(F.col(name).alias("name"), F.col(value).alias("value")).orderBy(F.desc("value"), "name").limit(most)
    best = top.agg(F.max("value").alias("best"))
    return top.crossJoin(F.broadcast(best)).select("name", "value", F.greatest(F.lit(4), F.round(F.col("value") / F.greatest("best", F.lit(1)) * 100).cast("int")).alias("width"))  # best is one row


def stats_order(stats: DataFrame, *keys: str, by: str = "total_requests") -> DataFrame:
    """Largest first; ties by name."""
    return stats.orderBy(F.desc(by), *keys)
