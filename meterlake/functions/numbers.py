"""Token counts, cost, rates and times as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units of a duration, and the colours of success rates 0, 0.5 and 1.
SECONDS, MILLISECONDS = "秒", "毫秒"
HEALTH_STOPS = ((239, 68, 68), (250, 204, 21), (34, 197, 94))


def non_negative(x: Column) -> Column:
    return F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)).cast("long")


def total_tokens(total: Column, tokens_in: Column, out: Column, reasoning: Column) -> Column:
    """The reported total unless it is 0, else input, output and reasoning; never negative. Cached tokens are part of the input."""
    return non_negative(F.when(total != 0, total).otherwise(tokens_in + out + reasoning))


def ingested_cache(cached: Column, read: Column, created: Column) -> Column:
    return F.greatest(cached, read + created)


def cached_tokens(cached: Column, cache: Column) -> Column:
    return F.greatest(cached, cache, F.lit(0)).cast("long")


def millis(nanoseconds: Column) -> Column:
    """Whole milliseconds, cut towards zero."""
    return F.call_function("div", nanoseconds, F.lit(1_000_000))


def cost(tokens_in: Column, out: Column, cached: Column, reasoning: Column, prompt: Column, completion: Column, cache: Column) -> Column:
    """USD by prices per million tokens: uncached input, output with reasoning, cached input. Null prices cost nothing."""
    held = F.greatest(cached, F.lit(0))
    plain = F.greatest(tokens_in - held, F.lit(0))
    made = F.greatest(out, F.lit(0)) + F.greatest(reasoning, F.lit(0))
    return F.coalesce((plain * prompt + made * completion + held * cache) / F.lit(1e6), F.lit(0.0))


def valid_price(x: Column) -> Column:
    return F.coalesce((x >= 0) & ~F.isnan(x) & (x < float("inf")), F.lit(False))


def success_rate(success: Column, total: Column) -> Column:
    """Percent; 100 without requests."""
    return F.when(total == 0, 100.0).otherwise(success / total * 100)


def rate_class(rate: Column) -> Column:
    return F.when(rate >= 95, "ok").when(rate >= 80, "neutral").otherwise("bad")


def finite(x: Column) -> Column:
    """A number from anything, 0 if it isn't finite."""
    v = x.try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v).otherwise(0.0)


def _shown(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)


def compact(x: Column) -> Column:
    """1.2k, 3.4M, 1k; whole numbers below a thousand."""
    v = finite(x)
    short = lambda y: F.regexp_replace(_shown(y, 1), r"\.0$", "")
    return F.when(F.abs(v) >= 1e6, F.concat(short(v / 1e6), F.lit("M"))).when(F.abs(v) >= 1e3, F.concat(short(v / 1e3), F.lit("k"))).otherwise(_shown(v, 0))


def percent_text(x: Column) -> Column:
    """One digit and a percent sign; `-` for what is no finite number."""
    return _or_dash(x, lambda v: F.concat(_shown(v, 1), F.lit("%")))


def millis_text(x: Column) -> Column:
    """Seconds with two digits from a thousand on, else whole milliseconds; `-` for what isn't above 0."""
    units = lambda v: F.when(v >= 1000, F.concat(_shown(v / 1000, 2), F.lit(SECONDS))).otherwise(F.concat(_shown(F.floor(v + 0.5).cast("double"), 0), F.lit(MILLISECONDS)))
    return _or_dash(x, lambda v: F.when(v > 0, units(v)).otherwise("-"))


def _or_dash(x: Column, shown: Callable[[Column], Column]) -> Column:
    v = x.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "-").otherwise(shown(v))


def health_color(rate: Column) -> Column:
    """The colour of a success rate from 0 to 1, between three stops; empty below 0."""
    part = F.when(rate < 0.5, rate * 2).otherwise((rate - 0.5) * 2)
    between = lambda low, middle, high: F.floor(F.when(rate < 0.5, low + (middle - low) * part).otherwise(middle + (high - middle) * part) + 0.5)
    return F.when(rate < 0, "").otherwise(F.concat(F.lit("rgb("), F.concat_ws(",", *(between(*c).cast("string") for c in zip(*HEALTH_STOPS))), F.lit(")")))


def health_cell(slot: Column, slots: int, rows: int = 7) -> Column:
    """Place of a slot in a grid that is filled from its lower right corner up: (column, row), from 1."""
    age = F.lit(slots - 1) - slot
    return F.struct((F.lit(-(-slots // rows)) - F.floor(age / rows)).alias("column"), (F.lit(rows) - age % rows).alias("row"))


def rfc3339(x: Column) -> Column:
    """A timestamp, null where x isn't one."""
    return F.try_to_timestamp(x)


def utc_offset(x: Column) -> Column:
    """The zone of an RFC 3339 text, `Z` without one."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), r"(Z|[+-]\d{2}:\d{2})$", 1), F.lit("")), F.lit("Z"))


def local_time(ts: Column, offset: Column) -> Column:
    """The instant shifted to its own zone, for formatting in a UTC session."""
    sign = F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)
    minutes = F.when(offset.rlike(r"^[+-]\d{2}:\d{2}$"), sign * (F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 5, 2).cast("int"))).otherwise(0)
    return F.timestamp_micros(F.unix_micros(ts) + minutes * F.lit(60_000_000).cast("long"))


def day_key(ts: Column, offset: Column) -> Column:
    return F.date_format(local_time(ts, offset), "yyyy-MM-dd")


def hour_key(ts: Column, offset: Column) -> Column:
    return F.date_format(local_time(ts, offset), "HH")
