"""Filtered, ordered and paged rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from .prices import with_cost

# Time ranges, page limits, rows of the recent list.
RANGES = {"7h": "INTERVAL 7 HOURS", "24h": "INTERVAL 24 HOURS", "7d": "INTERVAL 7 DAYS"}
PAGE, LARGEST_PAGE, RECENT = 50, 500, 120


@dataclass(frozen=True)
class Query:
    range: str = ""
    model: str = ""
    source: str = ""
    auth_index: str = ""
    api: str = ""
    blank_auth: bool = False
    failed_only: bool = False
    limit: int = PAGE
    offset: int = 0

    @classmethod
    def parse(cls, options: dict[str, str]) -> Query:
        """From text options: numbers that aren't positive (limit) or not negative (offset) are ignored."""

        def number(name: str, least: int, default: int) -> int:
            text = str(options.get(name, "")).strip()
            return int(text) if text.lstrip("+-").isdigit() and int(text) >= least else default

        return cls(*(options.get(k, "") for k in ("range", "model", "source", "auth_index", "api")), limit=number("limit", 1, PAGE), offset=number("offset", 0, 0))

    @property
    def page(self) -> int:
        return self.limit if 0 < self.limit <= LARGEST_PAGE else PAGE


def select_events(events: DataFrame, query: Query, now: Column) -> DataFrame:
    """Rows that the query asks for. Filters on stored columns reach the scan; rows without a time pass any range."""
    out = events
    if query.api:
        out = out.filter(F.col("api") == query.api)
    if query.range in RANGES:
        out = out.filter(F.col("ts").isNull() | (F.col("ts") >= now - F.expr(RANGES[query.range])))
    if query.model:
        out = out.filter(F.col("model") == query.model)
    if query.source:
        blank = query.source == T.UNKNOWN_SOURCE
        out = out.filter((F.col("source") == query.source) | (F.lit(blank) & (F.coalesce(F.col("source"), F.lit("")) == "")))
    if query.auth_index:
        out = out.filter(F.col("auth_index") == query.auth_index)
    if query.blank_auth:
        out = out.filter(F.coalesce(F.col("auth_index"), F.lit("")) == "")
    return out.filter("failed") if query.failed_only else out


def ordered(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("ts"), "api", F.desc("ingest_seq"))


def page(events: DataFrame, query: Query, now: Column) -> tuple[DataFrame, DataFrame]:
    """One page, newest first and without the api, and a table with the total number of rows."""
    found = select_events(events, query, now)
    return ordered(found).offset(query.offset).limit(query.page).drop("api"), found.agg(F.count("*").alias("total"))


def recent(events: DataFrame, api: str, most: int = RECENT) -> DataFrame:
    return ordered(events.filter(F.col("api") == api)).limit(most)


def model_names(events: DataFrame) -> DataFrame:
    return events.select("model").distinct().orderBy("model")


def auth_names(page_rows: DataFrame) -> DataFrame:
    return page_rows.select(T.or_default(F.col("auth_index"), "-").alias("auth_index")).distinct().orderBy("auth_index")


def existing(events: DataFrame, apis: DataFrame) -> DataFrame:
    """Of apis (a column api), those that still have rows."""
    return apis.join(events.select("api").distinct(), "api", "left_semi")


def detailed(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Rows with time in milliseconds, total, the larger cached count and their cost."""
    c = F.col
    total = N.total_tokens(c("total_tokens"), c("input_tokens"), c("output_tokens"), c("reasoning_tokens"))
    rows = with_cost(events, prices)
    return rows.withColumns({"timestamp_ms": F.coalesce(F.unix_millis("ts"), F.lit(0)), "total": total, "cached": N.cached_tokens(c("cached_tokens"), c("cache_tokens"))})
