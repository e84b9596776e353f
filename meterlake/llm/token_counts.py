"""Exact length histogram: documents by encoded length, with suffix sums for every context limit."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, small_batches, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that belongs to the vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths that share a block of the two-level sums.
BLOCK = 256

_encodings: dict[int, object] = {}


def encoding(ranks_file: bytes):
    """A byte-pair encoding, built once in a process."""
    import tiktoken

    key = hash(ranks_file)
    if key not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks_file.splitlines() if line)}
        _encodings[key] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def encoded_lengths(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """n_tokens of every row, whole texts of any length. The vocabulary file is read on the driver.

    Null and empty texts have 0 tokens; repeated rows count each; other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks.value).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()], pa.int64())], ["n_tokens"])

    return df.select(text).mapInArrow(count, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs: combined before the shuffle, so a row for each length and task at most moves."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """Add, for a limit of n_tokens at each length: docs_longer and tokens_longer (over the limit),
    docs_within and tokens_within, truncated_tokens (every document cut at the limit) and the share
    of documents within, which is the quantile that the length stands for.

    Sums run over blocks of lengths first, then inside each block, so no task holds the whole
    histogram. An empty histogram gives no rows.
    """
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.expr(f"n_tokens div {BLOCK}").alias("block"))
    h = materialize(h, "lengths")
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    over = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row for BLOCK lengths
    zero = F.lit(0).cast("long")
    above = blocks.select("block", F.coalesce(F.sum("block_docs").over(over), zero).alias("docs_above"), F.coalesce(F.sum("block_tokens").over(over), zero).alias("tokens_above"))
    total = blocks.agg(F.sum("block_docs").alias("total_docs"), F.sum("block_tokens").alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = h.join(above, "block").crossJoin(F.broadcast(total)).select(  # total is one row
        "n_tokens", "n_docs", "total_docs", "total_tokens",
        (F.col("docs_above") + F.coalesce(F.sum("n_docs").over(inside), zero)).alias("docs_longer"),
        (F.col("tokens_above") + F.coalesce(F.sum("tokens").over(inside), zero)).alias("tokens_longer"),
    )
    return out.select(
        "n_tokens", "n_docs",
        (F.col("total_docs") - F.col("docs_longer")).alias("docs_within"), "docs_longer",
        (F.col("total_tokens") - F.col("tokens_longer")).alias("tokens_within"), "tokens_longer",
        (F.col("total_tokens") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("truncated_tokens"),
        ((F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_within, docs_longer, tokens_within, truncated_tokens for any limits, between lengths too."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    le = F.when(F.col("n_tokens") <= F.col("limit"), F.col("n_docs"))
    gt = F.when(F.col("n_tokens") > F.col("limit"), F.col("n_docs"))
    zero = F.lit(0).cast("long")
    out = sums.crossJoin(F.broadcast(asked)).groupBy("limit").agg(  # the limits that the caller lists
        F.coalesce(F.sum(le), zero).alias("docs_within"), F.coalesce(F.sum(gt), zero).alias("docs_longer"), F.coalesce(F.sum(le * F.col("n_tokens")), zero).alias("tokens_within"))
    return out.withColumn("truncated_tokens", F.col("tokens_within") + F.col("limit") * F.col("docs_longer"))


def quantiles(sums: DataFrame, qs: list[float]) -> DataFrame:
    """q, n_tokens: the smallest length that a share q of the documents doesn't exceed."""
    asked = sums.sparkSession.createDataFrame([(float(q),) for q in qs], "q double")
    return sums.join(F.broadcast(asked), F.col("quantile") >= F.col("q")).groupBy("q").agg(F.min("n_tokens").alias("n_tokens"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_suffix_sums(length_histogram(encoded_lengths(table(spark, sf_dir, "documents"))))
