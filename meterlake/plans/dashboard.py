"""The dashboard's result sets over one log, each a lazy DataFrame."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import numbers as N
from ..functions import text as T
from ..operators import aggregates as A
from ..operators import prices as P
from ..operators import series
from ..operators.retention import normalize_import
from ..schema import EVENT_COLUMNS
from ..sources import storage
from .keep import kept

KEYS = ("api", "model", "source", "auth_index", "client", "day", "hour")
GROUPINGS = {"total": (), "api": ("api",), "api_model": ("api", "model"), "model": ("model",), "source": ("source",), "auth_index": ("auth_index",), "client": ("client",), "client_model": ("client", "model"), "day": ("day",), "hour": ("hour",)}
MEASURES = ("total_requests", "success_count", "failure_count", "total_tokens", "input_tokens", "output_tokens", "cached_tokens", "reasoning_tokens", "avg_latency_ms")


def model_costs(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Roll-up by model with success rate and cost, most requests first."""
    return priced_models(A.by_model(events), prices)


def priced_models(stats: DataFrame, prices: DataFrame) -> DataFrame:
    stats = A.with_rate(stats)
    return P.with_cost(stats, prices).withColumn("cost", F.round("cost", 6)).drop("cache_tokens").orderBy(F.desc("total_requests"), "model")


def rolled(events: DataFrame) -> DataFrame:
    """All sums of the first page in one pass: a row for each value of each grouping, `grouping` saying which."""
    keyed = events.select(
        "api", "model", T.or_default(F.col("source"), T.UNKNOWN_SOURCE).alias("source"), T.or_default(F.col("auth_index"), T.BLANK_CREDENTIAL).alias("auth_index"),
        T.client_group(F.col("api_key"), F.col("api_key_hash")).alias("client"), N.day_key(F.col("ts"), F.col("utc_offset")).alias("day"), N.hour_key(F.col("ts"), F.col("utc_offset")).alias("hour"),
        "provider", "api_key", "api_key_hash", "ts", "ingest_seq", "failed", "latency_ms", "input_tokens", "output_tokens", "reasoning_tokens", "cached_tokens", "cache_tokens", "total_tokens")
    sets = {name: [F.col(c) for c in keys] for name, keys in GROUPINGS.items()}
    columns = [F.col(c) for c in KEYS]
    order = F.struct("ts", "ingest_seq")
    first = [F.min_by(x, order).alias(n) for n, x in (("provider", F.col("provider")), ("label", T.client_label(F.col("api_key"))), ("api_key_hash", F.col("api_key_hash")))]
    sums = keyed.groupingSets(list(sets.values()), *columns).agg(F.grouping_id(*columns).alias("_id"), *A.measures8(), A.latency(), *first)
    bits = {name: sum(1 << (len(KEYS) - 1 - i) for i, k in enumerate(KEYS) if k not in keys) for name, keys in GROUPINGS.items()}
    which = F.create_map(*(F.lit(x) for name, b in bits.items() for x in (b, name)))
    return sums.withColumn("grouping", which[F.col("_id").cast("int")]).drop("_id")


def summary(events: DataFrame, prices: DataFrame, now: Column) -> dict[str, DataFrame]:
    """Everything that the first page shows. All sums come from one pass over the rows, whose few results are written."""
    sums = kept(rolled(events))
    of = lambda name, *columns: sums.filter(F.col("grouping") == name).select(*columns)
    m4, m8 = MEASURES[:4], MEASURES[:8]
    models = of("client_model", "client", "model", *m8)
    fields = [c for c in models.columns if c != "client"]
    clients = of("client", "client", "label", "api_key_hash", *m8).join(A.nested_models(models, fields), "client")
    times = lambda key: of(key, key, F.col("total_requests").alias("requests"), F.col("total_tokens").alias("tokens")).orderBy(key)
    return {
        "total": of("total", *MEASURES),
        "apis": A.stats_order(of("api", "api", *MEASURES), "api"),
        "api_models": of("api_model", "api", "model", *MEASURES).orderBy("api", F.desc("total_requests"), "model"),
        "models": priced_models(of("model", "model", *MEASURES), prices),
        "sources": A.stats_order(of("source", "source", "provider", *m4), "source"),
        "credentials": A.stats_order(of("auth_index", "auth_index", *m4), "auth_index"),
        "clients": A.stats_order(clients, "client"),
        "days": times("day"),
        "hours": times("hour"),
        "health": series.health_grid(events, now).orderBy("slot"),
        "metrics": A.summary_metrics(events),
    }


def summary_of_document(spark: SparkSession, path: str, prices: DataFrame, now: Column) -> dict[str, DataFrame]:
    """The summary from a full usage document, for engines that offer nothing else."""
    rows = normalize_import(storage.read_snapshot(spark, path), now).select(*EVENT_COLUMNS)
    return summary(rows, prices, now)


def summary_json(events: DataFrame, prices: DataFrame, now: Column, settings: Settings = Settings()) -> str:
    """One document of all result sets. Its size follows the number of groups, not of rows."""
    out = {name: [json.loads(x) for x in df.toJSON().toLocalIterator()] for name, df in summary(events, prices, now).items()}
    return json.dumps(out | {"config": settings.public()}, ensure_ascii=False)
