"""Rows written once for several readers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="meterlake-")
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str = "log") -> str:
    return f"{shared_dir(spark)}/meterlake-{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df as a Parquet folder in the shared folder, read back: its lineage is cut."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _on(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _on(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where, files = _on(spark, path)
    files.delete(where, True)
