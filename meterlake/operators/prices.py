"""The price table: USD per million tokens by model."""

from __future__ import annotations

import json
import math
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..schema import PRICE_TABLE, PRICES

#: A price table is a list that people keep; beyond so many rows it isn't broadcast by hint.
BROADCAST_ROWS = 100_000


def valid(prices: DataFrame) -> DataFrame:
    """Rows with a name and three prices that are finite and not negative."""
    ok = N.valid_price(F.col("prompt")) & N.valid_price(F.col("completion")) & N.valid_price(F.col("cache"))
    return prices.withColumn("model", T.trim(F.col("model"))).filter((F.col("model") != "") & ok)


def make(spark: SparkSession, rows: dict[str, tuple]) -> DataFrame:
    """A table from {model: (prompt, completion[, cache])}; a missing cache price is the prompt's."""
    return spark.createDataFrame([(m, float(p[0]), float(p[1]), float(p[2] if len(p) > 2 and p[2] is not None else p[0])) for m, p in rows.items()], PRICE_TABLE)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The saved document as rows; blank names and invalid prices are left out, a missing file is empty."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], PRICE_TABLE)
    doc = spark.read.schema(PRICES).option("multiLine", True).json(path)
    return valid(doc.select(F.explode("prices").alias("model", "p")).select("model", "p.*"))


def save(prices: DataFrame, path: str, updated_at: str) -> None:
    """Write the small table as one document: a private file beside the old one, which it then replaces."""
    rows = {r["model"]: {k: r[k] for k in ("prompt", "completion", "cache")} for r in prices.orderBy("model").toLocalIterator()}
    temporary = f"{path}.tmp"
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with os.fdopen(os.open(temporary, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
        json.dump({"updated_at": updated_at, "prices": rows}, f, ensure_ascii=False, indent=2)
    os.replace(temporary, path)


def upsert(prices: DataFrame, model: str, prompt: float, completion: float, cache: float | None = None) -> DataFrame:
    """prices with one model set; raises ValueError for a blank name or an invalid price."""
    name = model.strip()
    values = [float(prompt), float(completion), float(prompt if cache is None else cache)]
    if not name:
        raise ValueError("model is required")
    if not all(math.isfinite(v) and v >= 0 for v in values):
        raise ValueError("prices must be finite and not negative")
    return delete(prices, name).unionByName(make(prices.sparkSession, {name: tuple(values)}))


def delete(prices: DataFrame, model: str) -> DataFrame:
    return prices.filter(F.col("model") != model.strip())


def overlay(prices: DataFrame, new: DataFrame) -> DataFrame:
    """prices with the rows of new set, one for each model there."""
    return prices.join(new, "model", "left_anti").unionByName(new)


def _lookup(stats: DataFrame, prices: DataFrame) -> DataFrame:
    table = prices.select("model", "prompt", "completion", "cache")
    return stats.join(table, "model", "left")  # Spark broadcasts a table under its threshold


def _cost() -> Column:
    return N.cost(F.col("input_tokens"), F.col("output_tokens"), N.cached_tokens(F.col("cached_tokens"), F.coalesce(F.col("cache_tokens"), F.lit(0))), F.col("reasoning_tokens"), F.col("prompt"), F.col("completion"), F.col("cache"))


def with_cost(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Rows with their own cost, 0 for models without a price."""
    rows = rows if "cache_tokens" in rows.columns else rows.withColumn("cache_tokens", F.lit(0))
    return _lookup(rows, prices).withColumn("cost", _cost()).drop("prompt", "completion", "cache")


def cost_by(stats: DataFrame, prices: DataFrame, *keys: str) -> DataFrame:
    """Cost of sums over (model and keys), added up by keys: the grain that the dashboard shows."""
    costs = with_cost(stats, prices)
    return (costs.groupBy(*keys) if keys else costs.groupBy()).agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("cost"))


def options(models: DataFrame, prices: DataFrame) -> DataFrame:
    """Names of models that are seen or priced, sorted."""
    return models.select("model").union(prices.select("model")).distinct().orderBy("model")
