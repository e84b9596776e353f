"""Length histogram and sharding against plain Python."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from meterlake.llm import sharding, token_counts


def test_histogram_equals_a_plain_count(spark, documents, odd_texts):
    docs = documents(odd_texts)
    with open(token_counts.VOCABULARY, "rb") as f:
        encode = token_counts.encoding(f.read()).encode_ordinary
    lengths = sorted(len(encode(t)) if t else 0 for t in odd_texts)
    sums = token_counts.with_suffix_sums(token_counts.length_histogram(token_counts.encoded_lengths(docs)))
    rows = {r["n_tokens"]: r for r in sums.collect()}
    assert {k: r["n_docs"] for k, r in rows.items()} == Counter(lengths)
    for limit, r in rows.items():
        assert r["docs_within"] == sum(x <= limit for x in lengths) and r["docs_longer"] == sum(x > limit for x in lengths)
        assert r["tokens_within"] == sum(x for x in lengths if x <= limit)
        assert r["truncated_tokens"] == sum(min(x, limit) for x in lengths)
        assert r["quantile"] == pytest.approx(r["docs_within"] / len(lengths))
    for r in token_counts.at_limits(sums, [0, 3, 100, 10**9]).collect():
        assert r["truncated_tokens"] == sum(min(x, r["limit"]) for x in lengths) and r["docs_longer"] == sum(x > r["limit"] for x in lengths)
    got = {r["q"]: r["n_tokens"] for r in token_counts.quantiles(sums, [0.5, 1.0]).collect()}
    assert got[1.0] == lengths[-1] and got[0.5] == lengths[(len(lengths) + 1) // 2 - 1]


def test_empty_tables(spark, documents):
    empty = documents([]).filter("false")
    assert token_counts.with_suffix_sums(token_counts.length_histogram(token_counts.encoded_lengths(empty))).count() == 0
    assert sharding.extendible_shards(empty, "doc_id", F.octet_length("text")).count() == 0


def bits(key):
    return bin(int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:15], 16))[2:].zfill(60)


def test_shards_split_only_what_is_oversized(spark):
    rows = [(i, 10 * (i % 7)) for i in range(600)] + [(None, 5), (601, None)]
    limit = 700
    df = spark.createDataFrame(rows, "key long, size long")
    got = sharding.extendible_shards(df, "key", F.col("size"), limit).collect()
    assert sorted((r["key"] or -1, r["bytes"]) for r in got) == sorted((k or -1, s or 0) for k, s in rows)
    total = lambda p: sum(s or 0 for k, s in rows if bits(k).startswith(p))
    for r in got:
        assert bits(r["key"]).startswith(r["shard"]) and len(r["shard"]) == r["depth"]
        assert r["shard_bytes"] == total(r["shard"]) <= limit
        assert not r["depth"] or total(r["shard"][:-1]) > limit


def test_a_hot_key_and_a_huge_row(spark):
    df = spark.createDataFrame([(7, 100)] * 300 + [(k, 50) for k in range(100, 140)] + [(9, 5000)], "key long, size long")
    got = sharding.extendible_shards(df, "key", F.col("size"), 1000).groupBy("shard").agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.max("key").alias("k")).collect()
    assert sum(r["n"] for r in got) == 341
    assert all(r["b"] <= 1000 or (r["n"] == 1 and r["k"] == 9) for r in got)


def test_written_shards_hold_all_rows(spark, tmp_path):
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 50).alias("text"))
    sharding.write_shards(df, "doc_id", str(tmp_path / "out"), 4000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("shard").distinct().count() > 2


def test_written_shards_keep_null_and_repeated_keys(spark, tmp_path):
    rows = [(None, "a"), (None, "b"), *[(7, f"c{i}") for i in range(3)], *[(i, "d" * 90) for i in range(20, 60)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sharding.write_shards(df, "doc_id", str(tmp_path / "out"), 500, F.octet_length("text"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(tuple, back.select("doc_id", "text").collect())) == Counter(rows) and back.select("shard").distinct().count() > 2


def test_shards_of_a_table_with_clashing_names(spark, tmp_path, monkeypatch):
    from meterlake.llm import shared

    monkeypatch.setattr(shared, "BROADCAST_ROWS", 3)  # a directory beyond it, and a hot key
    rows = [(k % 40 if k % 3 else 7, "s", "t", k, 1, "b") for k in range(300)] + [(None, None, None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "key long, shard string, row string, bytes long, depth int, bits string")
    sharding.write_shards(df, "key", str(tmp_path / "out"), 300, F.lit(10))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(tuple, back.select(df.columns).collect())) == Counter(rows)
    assert max(r["count"] for r in back.groupBy("_shard").count().collect()) <= 30


def test_rows_that_no_bit_tells_apart_are_not_dropped(spark, monkeypatch):
    monkeypatch.setattr(sharding, "hash_bits", lambda value: F.lit("0" * 60))
    with pytest.raises(ValueError):
        sharding.extendible_shards(spark.range(5).withColumn("size", F.lit(10)), "id", F.col("size"), 15)
