"""What the operators share: tables, the shared folder, fixed word pattern, lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a text, as all contracts here define them.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"
#: A table of at most so many narrow rows is broadcast; a value that more than one in so many rows have is hot.
BROADCAST_ROWS, HOT = 100_000, 1_000
#: Bits of a semi-filter's map for each key, and in all: 16 MB, broadcast.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one if both are one
    process (tests), else an error: executors of a cluster wouldn't see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="meterlake-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/meterlake-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage, computes df once for several readers, and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def size(entries: DataFrame, times: str) -> tuple[int, int]:
    """Entries, and the rows that they stand for."""
    return tuple(entries.agg(F.count("*"), F.coalesce(F.sum(times), F.lit(0))).first())


def spread_join(rows: DataFrame, entries: DataFrame, on: list[str], times: str, spread: Column, known: tuple[int, int] | None = None) -> DataFrame:
    """rows, each with the columns of its entry (null where it has none) but on and times; entries is read several times.
    known: size() of entries.

    entries has one row for each value of on and, in times, how many of rows have it. Few entries are
    broadcast. Of more, those that a HOT-th of all rows or more have are: there are at most HOT. Their
    rows and those of null keys then go where `spread` sends them, so that no task gets all rows of a
    value, whatever AQE does.
    """
    n, total = known or size(entries, times)
    own = [c for c in entries.columns if c not in (*on, times)]
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(entries.drop(times)), on, "left").select(*rows.columns, *own)
    packed = entries.select(*(F.col(c).alias(f"_{c}") for c in on), F.struct(*own).alias("_own"), F.col(times).alias("_times"))
    hot = F.col("_times") * HOT >= F.lit(total)
    same = [F.col(c) == F.col(f"_{c}") for c in on]
    marked = rows.join(F.broadcast(packed.filter(hot).drop("_times").withColumnRenamed("_own", "_hot")), same, "left").drop(*(f"_{c}" for c in on))
    lone = F.col("_hot").isNotNull() | F.greatest(*(F.col(c).isNull() for c in on), F.lit(False))
    marked = marked.withColumn("_salt", F.when(lone, F.pmod(F.xxhash64(spread), F.lit(1 << 20)) + 1).otherwise(0))
    cold = packed.filter(~hot).drop("_times").withColumn("_zero", F.lit(0).cast("long"))
    found = marked.join(cold, [*same, F.col("_salt") == F.col("_zero")], "left")
    return found.withColumn("_own", F.coalesce("_hot", "_own")).select(*rows.columns, *(F.col(f"_own.{c}").alias(c) for c in own))


def among(rows: DataFrame, keys: DataFrame, *on: str, inverse: bool = False, known: int | None = None) -> DataFrame:
    """rows without most of those whose values of on aren't in keys (the same columns); none that is in keys is lost.
    inverse: the others. known: how many keys there are.

    A bit map of the hashes of keys, FILTER_BITS for each and MOST_FILTER_BITS in all, is broadcast, so
    rows are thinned where they are read; beyond some ten million keys it lets more pass.
    """
    n = keys.count() if known is None else known
    bits = 1 << min(max(n * FILTER_BITS, 64).bit_length(), MOST_FILTER_BITS.bit_length() - 1)
    place = F.pmod(F.xxhash64(*on, F.lit(bits)), F.lit(bits))
    one = keys.select(place.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))).alias("bits"))
    every = keys.sparkSession.range(bits >> 6).withColumnRenamed("id", "word").join(one, "word", "left").select(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("x"))
    map_ = every.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["bits"]).alias("_map"))  # one row of at most 16 MB
    word = F.get(F.col("_map"), F.shiftright(place, 6).cast("int"))
    bit = F.call_function("shiftright", word, place.bitwiseAND(63).cast("int")).bitwiseAND(1)
    return rows.join(F.broadcast(map_), bit == 1, "left_anti" if inverse else "left_semi")


def only(rows: DataFrame, entries: DataFrame, on: list[str], times: str, spread: Column) -> DataFrame:
    """The rows that have an entry, with its columns but times: spread_join() after rows without one were thinned out."""
    known = size(entries, times)
    if known[0] > BROADCAST_ROWS:
        rows = among(rows, entries.select(*on), *on, known=known[0])
    return spread_join(rows, entries.withColumn("_met", F.lit(True)), on, times, spread, known).filter("_met").drop("_met")


def without(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """rows whose values of on (not null) aren't in keys. Only rows that a bit map takes for members are shuffled."""
    n = keys.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), [*on], "left_anti")
    return among(rows, keys, *on, inverse=True, known=n).unionByName(among(rows, keys, *on, known=n).join(keys, [*on], "left_anti"))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that new_path() named, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Rows that go to Python at once; texts may be long, and two workers share an executor's memory.

    Spark reads this setting when a frame runs, so it stays lowered in the session.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def bounded_sample(df: DataFrame, key: str, most: int, by: str | None = None) -> DataFrame:
    """At most `most` rows of df (of each value of by), those with the smallest hashes of key.

    Rows are counted first, and a hash threshold leaves about twice as many as are asked for, so the
    last choice sees a few thousand rows at any size of df. by has few values, such as languages: their
    counts are broadcast, so that no row moves before the threshold has been applied.
    """
    place = F.shiftrightunsigned(F.xxhash64(key), 11) / float(2**53)
    counts = df.groupBy(*([by] if by else [])).agg(F.count("*").alias("_n"))
    met = df.join(F.broadcast(counts), by) if by else df.crossJoin(counts)  # counts: one row for each value, or one
    thinned = met.withColumn("_at", place).filter(F.col("_at") * F.col("_n") < 2.0 * most + 1000)
    if by is None:
        return thinned.orderBy("_at", *df.columns).limit(most).select(*df.columns)
    first = Window.partitionBy(by).orderBy("_at", key)
    return thinned.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= most).select(*df.columns)
