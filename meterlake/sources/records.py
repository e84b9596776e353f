"""Raw usage records: tolerant decoding of JSON text and normalization to rows of the fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import numbers as N
from ..functions import text as T
from ..schema import EVENT_COLUMNS

# Field names of the wire format with their legacy spellings, by first match.
TEXT_FIELDS = {
    "provider": ("provider", "Provider"),
    "executor_type": ("executor_type", "ExecutorType"),
    "model": ("model", "Model"),
    "alias": ("alias", "Alias"),
    "api_key": ("api_key", "APIKey"),
    "auth_id": ("auth_id", "AuthID"),
    "auth_index": ("auth_index", "AuthIndex"),
    "auth_type": ("auth_type", "AuthType"),
    "base_url": ("base_url", "baseURL", "baseUrl", "BaseURL", "BaseUrl"),
    "source": ("source", "Source"),
    "reasoning_effort": ("reasoning_effort", "ReasoningEffort"),
    "service_tier": ("service_tier", "ServiceTier"),
    "requested_at": ("requested_at", "RequestedAt"),
}
NUMBER_FIELDS = {"latency": ("latency", "Latency"), "ttft": ("ttft", "TTFT")}
DETAIL_FIELDS = {
    "input_tokens": ("input_tokens", "InputTokens"),
    "output_tokens": ("output_tokens", "OutputTokens"),
    "reasoning_tokens": ("reasoning_tokens", "ReasoningTokens"),
    "cached_tokens": ("cached_tokens", "CachedTokens"),
    "cache_read_tokens": ("cache_read_tokens", "CacheReadTokens"),
    "cache_creation_tokens": ("cache_creation_tokens", "CacheCreationTokens"),
    "total_tokens": ("total_tokens", "TotalTokens"),
}
DETAIL_PARENTS, FAILURE_PARENTS = ("detail", "Detail"), ("failure", "Failure")
HEADER_FIELDS = ("response_headers", "ResponseHeaders")
ZERO_TIME = "0001-01-01T00:00:00Z"


#: Bits of a row's and of a partition's number in an arrival number; the push stands above both.
ROW_BITS, PART_BITS = 26, 14


def position() -> Column:
    """The place of a row in what is read: its partition, then its row there."""
    row, part = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1), F.spark_partition_id().cast("long")
    fits = (row < 1 << ROW_BITS) & (part < 1 << PART_BITS)
    return F.when(fits, part * (1 << ROW_BITS) + row).otherwise(F.raise_error(F.lit("a push has too many rows for arrival numbers")).cast("long"))


def push_number(number: int) -> Column:
    """What the position of the rows of a push is added to: later pushes have larger numbers."""
    return F.lit(number << (ROW_BITS + PART_BITS)).cast("long")


def _paths(parents: tuple[str, ...], names: tuple[str, ...]) -> list[str]:
    return [f"$.{p}.{n}" for p in parents for n in names] if parents else [f"$.{n}" for n in names]


def _text(v: Column, paths: list[str]) -> Column:
    return F.coalesce(T.first_filled(*(F.try_variant_get(v, p, "string") for p in paths)), F.lit(""))


def _number(v: Column, paths: list[str]) -> Column:
    """The first that isn't 0."""
    return F.coalesce(*(F.nullif(F.try_variant_get(v, p, "long"), F.lit(0).cast("long")) for p in paths), F.lit(0).cast("long"))


def decode(raw: DataFrame, value: str = "value") -> DataFrame:
    """Decoded fields beside the other columns of raw; rows that aren't JSON objects are left out.

    Each field is the first of its spellings that is neither missing nor zero; unknown fields are
    ignored; failed is true if either spelling says so.
    """
    v = F.col("_json")
    parsed = raw.withColumn("_json", F.try_parse_json(F.col(value))).filter(F.schema_of_variant(v).startswith("OBJECT"))
    columns = {k: _text(v, _paths((), names)) for k, names in TEXT_FIELDS.items()}
    columns |= {k: _number(v, _paths((), names)) for k, names in NUMBER_FIELDS.items()}
    columns |= {k: _number(v, _paths(DETAIL_PARENTS, names)) for k, names in DETAIL_FIELDS.items()}
    columns["failed"] = F.coalesce(F.try_variant_get(v, "$.failed", "boolean"), F.lit(False)) | F.coalesce(F.try_variant_get(v, "$.Failed", "boolean"), F.lit(False))
    columns["status_code"] = _number(v, _paths(FAILURE_PARENTS, ("status_code", "StatusCode"))).cast("int")
    columns["failure_body"] = _text(v, _paths(FAILURE_PARENTS, ("body", "Body")))
    columns["headers"] = F.coalesce(*(F.try_variant_get(v, f"$.{n}", "map<string,array<string>>") for n in HEADER_FIELDS))
    return parsed.withColumns(columns).drop("_json")


def normalize(decoded: DataFrame, now: Column, settings: Settings = Settings(), seq: Column | None = None) -> DataFrame:
    """Rows of the fact table. Raw keys are masked and hashed, sources cleaned, failures redacted and cut.

    A missing time is `now`. The alias is never used. seq orders arrivals; without it rows are
    numbered by position().
    """
    c = F.col
    at = F.coalesce(F.when(c("requested_at") == ZERO_TIME, F.lit(None)).otherwise(N.rfc3339(F.nullif(c("requested_at"), F.lit("")))), now)
    key = T.mask_key(c("api_key"))
    return decoded.select(
        T.group_key(c("provider"), c("executor_type"), c("source"), c("base_url"), c("auth_index"), c("auth_id")).alias("api"),
        T.or_default(c("model"), "unknown").alias("model"),
        at.alias("ts"),
        N.utc_offset(c("requested_at")).alias("utc_offset"),
        N.millis(c("latency")).alias("latency_ms"),
        N.millis(c("ttft")).alias("ttft_ms"),
        key.alias("api_key"),
        T.hash_key(c("api_key"), settings.api_key_hash_salt).alias("api_key_hash"),
        T.source_label(c("source"), c("provider"), c("executor_type")).alias("source"),
        *(T.trim(c(x)).alias(x) for x in ("provider", "auth_id", "auth_index", "auth_type", "base_url")),
        T.thinking(c("reasoning_effort")).alias("thinking"),
        c("input_tokens"), c("output_tokens"), c("reasoning_tokens"), c("cached_tokens"),
        N.ingested_cache(c("cached_tokens"), c("cache_read_tokens"), c("cache_creation_tokens")).alias("cache_tokens"),
        N.total_tokens(c("total_tokens"), c("input_tokens"), c("output_tokens"), c("reasoning_tokens")).alias("total_tokens"),
        c("failed"), c("status_code"),
        T.cut_long(T.redact(c("failure_body"))).alias("failure"),
        T.keep_headers(c("headers"), settings.log_response_headers).alias("headers"),
        (position() if seq is None else seq).alias("ingest_seq"),
    ).select(*EVENT_COLUMNS)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Pushed records as text, one JSON object a line."""
    return spark.read.text(path)
