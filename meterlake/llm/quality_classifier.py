"""Regularised quadratic discriminant over transformed document statistics.

Class means and covariances come from one aggregation over the labelled training rows, of which there
are at most TRAIN_ROWS: d + d * d / 2 sums a class. The covariances are shrunk, their Cholesky factors computed
once on the driver, and scores are plain column arithmetic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_sample, materialize, table
from .text_stats import document_stats

#: Share of the pooled covariance, and of its diagonal, in each class covariance; least variance of a feature.
TO_POOLED, TO_DIAGONAL, LEAST_VARIANCE = 0.1, 0.1, 1e-3
#: Labels that the model is fitted on, at most.
TRAIN_ROWS = 20_000
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "capitals", "exclaims", "stops", "digits", "lines")


def features(stats: DataFrame) -> dict[str, Column]:
    """Counts become logs, shares their variance-stabilising square roots; all 0 for a text without words."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    made = {
        "log_words": F.log1p("n_words"),
        "word_length": F.log1p(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))),
        "symbols": share("n_symbols", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "distinct": F.log1p("n_distinct_words") - 0.8 * F.log1p("n_words"),  # vocabulary grows as a power of the length
        "capitals": share("n_upper", "word_chars"),
        "exclaims": share("n_exclaims", "n_words"),
        "stops": share("n_stops", "n_words"),
        "digits": share("n_digits", "word_chars"),
        "lines": share("n_lines", "n_words"),
    }
    assert tuple(made) == FEATURES
    return made


def cholesky(a: list[list[float]]) -> list[list[float]]:
    n = len(a)
    low = [[0.0] * n for _ in range(n)]
    for i in range(n):
        for j in range(i + 1):
            rest = a[i][j] - sum(low[i][k] * low[j][k] for k in range(j))
            low[i][j] = math.sqrt(rest) if i == j else rest / low[j][j]
    return low


def fit(train: DataFrame, label: str = "label") -> dict:
    """The model from rows with FEATURES and a label of 0 or 1; other labels and null are ignored.

    A class without rows leaves the other's share as the score of every document; with no rows at
    all it is 0.5.
    """
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(FEATURES)]
    products = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs]
    rows = {int(r[label]): r for r in train.filter(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*").alias("n"), *sums, *products).collect()}
    n = {k: rows[k]["n"] if k in rows else 0 for k in (0, 1)}
    model: dict = {"prior": math.log((n[1] + 1) / (n[0] + 1)), "classes": {}}
    if not (n[0] and n[1]):
        return model
    mean = {k: [rows[k][f"s{i}"] / n[k] for i in range(d)] for k in n}
    cov = {k: [[rows[k][f"p{max(i, j)}_{min(i, j)}"] / n[k] - mean[k][i] * mean[k][j] for j in range(d)] for i in range(d)] for k in n}
    for k in n:
        pooled = [[(n[0] * cov[0][i][j] + n[1] * cov[1][i][j]) / (n[0] + n[1]) for j in range(d)] for i in range(d)]
        mixed = [[(1 - TO_POOLED) * cov[k][i][j] + TO_POOLED * pooled[i][j] for j in range(d)] for i in range(d)]
        shrunk = [[mixed[i][j] * (1 if i == j else 1 - TO_DIAGONAL) + (LEAST_VARIANCE if i == j else 0) for j in range(d)] for i in range(d)]
        low = cholesky(shrunk)
        model["classes"][k] = {"mean": mean[k], "low": low, "log_det": 2 * sum(math.log(low[i][i]) for i in range(d))}
    return model


def whitening(low: list[list[float]]) -> list[list[float]]:
    """The inverse of a lower triangular matrix."""
    n = len(low)
    inv = [[0.0] * n for _ in range(n)]
    for j in range(n):
        inv[j][j] = 1 / low[j][j]
        for i in range(j + 1, n):
            inv[i][j] = -sum(low[i][k] * inv[k][j] for k in range(j, i)) / low[i][i]
    return inv


def score(model: dict) -> Column:
    """Probability of label 1: the logistic of the difference of the two log densities and the prior."""
    odds: Column = F.lit(model["prior"])
    for k, c in model["classes"].items():
        inv = whitening(c["low"])
        centred = [F.col(x) - F.lit(m) for x, m in zip(FEATURES, c["mean"])]
        z = [sum((centred[j] * F.lit(inv[i][j]) for j in range(i + 1)), F.lit(0.0)) for i in range(len(FEATURES))]
        log_density = F.lit(-0.5 * c["log_det"]) - 0.5 * sum((x * x for x in z), F.lit(0.0))
        odds = odds + log_density if k else odds - log_density
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds))))


def held_out(key: str) -> Column:
    return F.crc32(F.col(key).cast("string")) % 3 == 1


def training_labels(labels: DataFrame, label: str, key: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """Distinct (key, label) that aren't held out: the rows with the smallest hashes, a bounded number of them."""
    told = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter(~held_out("key") & F.col("label").isin(0, 1)).distinct()
    return bounded_sample(told, "key", rows)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> dict:
    """The model from at most TRAIN_ROWS labels. Only those few rows are broadcast, so no text is shuffled."""
    told = F.broadcast(materialize(training_labels(labels, label, key), "labels"))
    train = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(told, "key")
    stats = document_stats(train, "text", ("label",))
    return fit(stats.select("label", *(c.alias(x) for x, c in features(stats).items())))


def scored(df: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and the score, in one pass over df without a shuffle."""
    stats = document_stats(df, text, keep)
    return stats.select(*keep, *(c.alias(x) for x, c in features(stats).items())).select(*keep, score(model).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score and predicted of every row of docs.

    Learns from at most TRAIN_ROWS labels of keys that are not held out. Null and empty texts have
    statistics of 0 and are scored like any. Repeated rows are scored alike; equal labels of a key
    count once; rows without a label teach nothing; no training rows at all give 0.5; a null key is
    not held out; columns other than those named are ignored; an empty table gives no rows.
    """
    out = scored(docs, learn(docs, labels, label, key, text), text, (key,))
    return out.select(key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of docs that are predicted to be of quality."""
    model = learn(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))
    return scored(rows, model, "_text", ("_row",)).filter("score >= 0.5").select("_row.*")
