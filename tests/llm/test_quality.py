"""Text statistics, rules and classifier."""

import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import quality_classifier as C
from meterlake.llm import quality_rules as R
from meterlake.llm.text_stats import document_stats

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_stats(text):
    text = text or ""
    words, lines = WORDS.findall(text), text.split("\n")
    filled = [x for x in lines if WORDS.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    chars = lambda test: sum(map(test, text))
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": chars(lambda c: c in "#*$%&|<>"), "n_lines": len(lines), "n_dup_lines": len(filled) - len(set(filled)),
        "n_repeat_words": len(marked), "n_distinct_words": len(set(words)), "n_exclaims": text.count("!"), "n_marks": sum(not any(c.isalnum() for c in w) for w in words),
        "n_upper": chars(lambda c: "A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×")), "n_stops": chars(lambda c: c in ".?"), "n_digits": chars(lambda c: "0" <= c <= "9"),
        "n_letters": chars(lambda c: unicodedata.category(c).startswith("L"))}


def test_statistics_equal_plain_python(spark, documents, odd_texts):
    random.seed(3)
    texts = odd_texts + [" ".join(random.choice("ab c d").strip() or "x" for _ in range(n)) for n in (4, 5, 6, 9, 40, 200)]
    texts += ["a b c d e a b c d e", "x x x x x x", "l\nl\n\n \nl\r\nl", "a b c d e f a b c d e g a b c d e", "Ärger ×÷ ÞÐ 12.5% Ⅷ ½? A1!"]
    long = [f"w{random.randrange(40_000)}" for _ in range(60_000)]
    texts += [" ".join(long + long[500:900]), "\n".join(" ".join(long[k % 700 : k % 700 + 9]) for k in range(6_000))]
    got = {r["doc_id"]: r for r in document_stats(documents(texts)).collect()}
    for i, t in enumerate(texts):
        for k, v in plain_stats(t).items():
            assert got[i][k] == v, (t and t[:80], k)


def test_rules_tell_junk_apart(spark, documents):
    random.seed(5)
    word = lambda: "".join(random.choice("aeioulnrst") for _ in range(random.randint(2, 8)))
    vocabulary = [word() for _ in range(800)]
    prose = lambda n: " ".join(random.choice(vocabulary) + ("." if i % 9 == 8 else "") for i in range(n))
    good = [prose(random.randint(60, 300)) for _ in range(170)]
    junk = [prose(80).upper().replace(" ", "!! ") for _ in range(10)] + [prose(80).replace(" ", "*** ") for _ in range(10)] + [" ".join(f"{w} " * 8 for w in prose(20).split()) for _ in range(10)]
    kept = {r["doc_id"]: r["kept"] for r in R.judge(documents(good + junk + [None, "", "too short"])).collect()}
    assert sum(kept[i] for i in range(170)) >= 165
    assert not any(kept[i] for i in range(170, 203))


def test_rules_on_an_empty_table(spark, documents):
    empty = documents([]).filter("false")
    assert R.judge(empty).count() == 0
    assert R.keep_good(spark, empty, "").columns == empty.columns


def test_stage_keeps_rows_whole(spark, documents):
    docs = documents(["a fine sentence of some words that says a little. " * 2 + str(i) for i in range(30)] + ["!! " * 40])
    out = R.keep_good(spark, docs, "")
    assert out.schema == docs.schema and {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}


def test_cholesky_and_score_equal_numpy(spark):
    rng = np.random.default_rng(1)
    d = len(C.FEATURES)
    x = {k: rng.normal(k, 1 + k, (400, d)) @ rng.normal(0, 0.5, (d, d)) for k in (0, 1)}
    rows = [(k, *map(float, v)) for k in x for v in x[k]]
    df = spark.createDataFrame(rows, "label int, " + ", ".join(f"{f} double" for f in C.FEATURES))
    model = C.fit(df)
    odds = np.full(800, model["prior"])
    flat = np.concatenate([x[0], x[1]])
    pooled = (np.cov(x[0].T, bias=True) + np.cov(x[1].T, bias=True)) / 2
    for k in (0, 1):
        cov = (1 - C.TO_POOLED) * np.cov(x[k].T, bias=True) + C.TO_POOLED * pooled
        cov = cov * (1 - C.TO_DIAGONAL) + np.diag(np.diag(cov)) * C.TO_DIAGONAL + np.eye(d) * C.LEAST_VARIANCE
        assert np.allclose(np.array(model["classes"][k]["low"]) @ np.array(model["classes"][k]["low"]).T, cov)
        z = flat - x[k].mean(axis=0)
        odds += (1 if k else -1) * -0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z))
    got = [r["s"] for r in df.select(C.score(model).alias("s")).collect()]
    assert np.allclose(got, [1 / (1 + math.exp(-max(-500, min(500, o)))) for o in odds], atol=1e-6)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = C.op8_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    right, n = out.select(F.count_if(F.col("predicted") == F.col("quality")), F.count("*")).first()
    assert n > 100 and right / n > 0.95


def test_held_out_labels_and_other_columns_teach_nothing(spark, documents):
    docs = documents([f"some words number {i} " * (i % 9 + 1) for i in range(60)] + [None, ""])
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    flipped = labels.select("doc_id", F.when(C.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"))
    a, b = (sorted(map(tuple, C.classify(d, x).collect())) for d, x in ((docs, labels), (docs.withColumn("lang", F.lit("q")), flipped)))
    assert a == b and all(0 <= r[2] <= 1 for r in a) and len(a) == 62


@pytest.mark.parametrize("which", ["true", "false"])
def test_without_labels_or_rows(spark, documents, which):
    docs = documents(["a b", None]).filter(which)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in C.classify(docs, labels).collect()] == [0.5] * docs.count()
