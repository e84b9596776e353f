"""Registered queries against their DuckDB SQL on the smallest tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from meterlake import catalog

KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    assert {c: KINDS[t] for c, t in df.dtypes} == dict(zip(rel.columns, map(str, rel.types)))
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_needs_no_session():
    """Queries are listed in a process of their own that never starts Spark."""
    code = "import __spark_entry__ as e; from pyspark import SparkContext; assert e.queries() and e.oracle_sql() and SparkContext._active_spark_context is None"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry.__file__)))
