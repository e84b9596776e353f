"""The registered queries on the smallest tables, against DuckDB where SQL can say them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from meterlake.llm import queries


KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rel = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    assert {c: KINDS[t] for c, t in df.dtypes} == dict(zip(rel.columns, map(str, rel.types)))
    at = [rel.columns.index(c) for c in columns]
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str([r[i] for i in at]) for r in rel.fetchall())


def test_all_are_registered():
    names = entry.queries()
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == [] and "pipeline" in names


def test_pipeline_equals_its_parts(spark, sf_dir):
    """Each stage against what the operator's own query says about the same input."""
    import corpus_pipeline as P
    from meterlake.llm import decontamination, near_duplicates, piece_codec, quality_classifier, quality_rules
    from meterlake.llm.shared import table

    docs = table(spark, sf_dir, "documents")
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    labels, benchmark = table(spark, sf_dir, "labels"), table(spark, sf_dir, "benchmark")
    kept = ids(quality_classifier.classify(docs, labels).filter("predicted = 1"))
    left = docs.filter(docs.doc_id.isin(*kept))
    kept = ids(quality_rules.judge(left).filter("kept"))
    left = docs.filter(docs.doc_id.isin(*kept))
    kept = ids(near_duplicates.near_duplicates(left).filter("kept"))
    left = docs.filter(docs.doc_id.isin(*kept))
    kept -= ids(decontamination.leaks(left, benchmark))
    want = {r["doc_id"]: r["text"] for r in docs.filter(docs.doc_id.isin(*kept)).collect()}
    out = P.run(spark, sf_dir)
    assert {r["doc_id"]: r["text"] for r in piece_codec.decode_documents(out).collect()} == want
    assert 0 < len(want) < docs.count()
