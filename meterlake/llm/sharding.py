"""Extendible hashing: a directory over hash-prefix bits, where only oversized buckets split.

Only DataFrame functions. Rows are reduced to (key, bits, bytes) before anything is shuffled; a hot
key is pre-aggregated by its prefix, and the directory of a round has at most 2**STEP entries for
each bucket that is still open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, new_path, spread_join, table

#: Bits that a round looks at, bits of one hash word, and the bytes of a production shard.
STEP = 10
WORD_BITS = 60
SHARD_BYTES = 64 * 1024 * 1024


def hash_bits(value: Column) -> Column:
    """The first 60 bits of md5 as a string of 0 and 1; null counts as the empty string."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.lpad(F.conv(F.substring(F.md5(text), 1, WORD_BITS // 4), 16, 2), WORD_BITS, "0")


def prefix(bits: Column, depth: Column) -> Column:
    return bits.substr(F.lit(1), depth)


def directory(rows: DataFrame, depth: int, limit: int) -> DataFrame:
    """Prefixes of depth + STEP bits of the open rows, each with the shard it belongs to.

    shard is null where even depth + STEP bits leave a bucket over the limit. Buckets of depth bits
    are known to be oversized unless depth is 0. A bucket of one row is a shard at any size.
    """
    fine = rows.groupBy(F.substring("bits", 1, depth + STEP).alias("fine")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    fine = materialize(fine, "shard-prefixes")
    depths = F.sequence(F.lit(0 if depth == 0 else depth + 1), F.lit(depth + STEP))
    each = fine.select("fine", "bytes", "n", F.explode(depths).alias("depth")).withColumn("shard", prefix(F.col("fine"), F.col("depth")))
    buckets = each.groupBy("depth", "shard").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    fits = buckets.filter((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
    held = each.select("fine", "depth", "shard").join(fits, ["depth", "shard"]).groupBy("fine").agg(F.min(F.struct("depth", "shard", "shard_bytes", "shard_rows")).alias("leaf"))
    return fine.select("fine", "n").join(held, "fine", "left").select("fine", "n", "leaf.depth", "leaf.shard", "leaf.shard_bytes", "leaf.shard_rows")


def extendible_shards(df: DataFrame, key: str, size: Column, limit: int = SHARD_BYTES, carry: bool = False) -> DataFrame:
    """key, bytes, shard (its prefix bits), depth, shard_bytes and shard_rows of every row of df.

    Buckets start as one and split on the next bit of md5(key) while they hold over limit bytes.
    Rows of one key cannot be told apart by that hash, so a bucket that is oversized after its 60
    bits goes on splitting by a hash of the row's number in the written table, which is fixed once
    that is written. A single row over the limit is a shard of its own. Null keys hash as the empty
    string; null sizes count as 0; an empty table gives no rows; repeated rows are assigned each; other columns are ignored, but with
    carry, row holds all columns of df as a struct. Texts are not written on the way, unless their bucket goes
    beyond the bits of its key. Should two rows agree in all 120 bits and still not fit, an error is raised.
    """
    carried = ["row"] if carry else []
    rows = df.select(F.col(key).alias("key"), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("bytes"), *([F.struct(*(df[c] for c in df.columns)).alias("row")] if carry else []))
    rows = rows.withColumn("bits", hash_bits(F.col("key")))
    narrow = rows = rows if carry else materialize(rows, "shard-rows")
    done: list[DataFrame] = []
    depth = 0
    while True:
        if depth == WORD_BITS:
            rows = materialize(rows.withColumn("seq", F.monotonically_increasing_id()), "shard-open")
            narrow = rows = rows.withColumn("bits", F.concat("bits", hash_bits(F.col("seq")))).drop("seq")
        entries = materialize(directory(narrow.select("bits", "bytes"), depth, limit), "shard-directory")
        open_ = entries.filter(F.col("shard").isNull()).agg(F.count("*")).first()[0]
        at = F.substring("bits", 1, depth + STEP).alias("fine")
        found = spread_join(rows.select("*", at), entries, ["fine"], "n", F.monotonically_increasing_id())
        done.append(found.filter(F.col("shard").isNotNull()).select("key", "bytes", "shard", "depth", "shard_bytes", "shard_rows", *carried))
        depth += STEP
        if not open_:
            break
        if depth >= 2 * WORD_BITS:
            raise ValueError(f"{open_} buckets of more than {limit} bytes agree in all {depth} bits")
        rows = found.filter(F.col("shard").isNull()).select("key", "bytes", "bits", *carried)
        if depth % (2 * STEP) == 0 and not carry:  # keep plans short when buckets are deep
            rows = materialize(rows, "shard-open")
        narrow = rows
    return reduce(DataFrame.unionByName, done)


def write_shards(df: DataFrame, key: str, path: str, limit: int = SHARD_BYTES, size: Column | None = None) -> None:
    """Write df as Parquet, one folder for each shard; size: bytes of a row, of its JSON if not given.

    Rows are carried through the assignment, so null and repeated keys are written as often as they
    occur. The folders are named `shard=b0101`, with an underscore in front if df has such a column.
    """
    folder = "shard"
    while folder in df.columns:
        folder = f"_{folder}"
    assigned = extendible_shards(df, key, F.octet_length(F.to_json(F.struct(*df.columns))) if size is None else size, limit, carry=True)
    assigned.select("row.*", F.concat(F.lit("b"), "shard").alias(folder)).repartition(folder).write.partitionBy(folder).parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return extendible_shards(docs, "doc_id", F.octet_length("text")).select(F.col("key").alias("doc_id"), "bytes", "shard", "depth", "shard_bytes", "shard_rows")


def sharding_written(spark: SparkSession, sf_dir: str, limit: int = 64 * 1024) -> DataFrame:
    """What the written shards of a small limit hold, so that small tables split too: as op9_sharding, read back from the files."""
    path = new_path(spark, "shards")
    write_shards(table(spark, sf_dir, "documents"), "doc_id", path, limit, F.octet_length("text"))
    rows = spark.read.parquet(path).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.expr("substr(shard, 2)").alias("shard"))
    sums = rows.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return rows.join(sums, "shard").select("doc_id", "bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_rows")


def _sql(limit: int) -> str:
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
         lpad(bin(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT), {WORD_BITS}, '0') AS bits
  FROM documents),
buckets AS (
  SELECT k.depth, substr(d.bits, 1, k.depth) AS shard, sum(d.bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
  FROM d, (SELECT unnest(range(0, 25))::INTEGER AS depth) k GROUP BY 1, 2),
fits AS (SELECT * FROM buckets WHERE shard_bytes <= {limit} OR shard_rows = 1),
leaf AS (
  SELECT * FROM fits f WHERE NOT EXISTS (
    SELECT 1 FROM fits g WHERE g.depth < f.depth AND g.shard = substr(f.shard, 1, g.depth)))
SELECT d.doc_id, d.bytes, l.shard, l.depth, l.shard_bytes, l.shard_rows
FROM d JOIN leaf l ON l.shard = substr(d.bits, 1, l.depth)
"""


OP9_SQL = _sql(SHARD_BYTES)
WRITTEN_SQL = _sql(64 * 1024)
