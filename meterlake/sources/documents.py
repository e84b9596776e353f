"""Snapshot documents in lines, as storage.snapshot_lines() writes them, read by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.keep import kept
from ..schema import DETAIL
from .records import PART_BITS, ROW_BITS

#: What a line is; ODD is none of them.
HEAD, API, MODEL, ROW, END_MODEL, END_API, TAIL, ODD = "head", "api", "model", "row", "end_model", "end_api", "tail", "odd"
#: What a line without a comma in front, and one with it, may follow; "" is the begin.
BEFORE = {HEAD: ("", TAIL), API: (HEAD,), MODEL: (API,), ROW: (MODEL,), END_MODEL: (MODEL, ROW), END_API: (API, END_MODEL), TAIL: (HEAD, END_API)}
BEFORE_COMMA = {API: (END_API,), MODEL: (END_MODEL,), ROW: (ROW,)}
#: What makes a line an object, around it and before its last `"end":0}`.
AROUND = {HEAD: ("", '}},"end":0}'), API: ('{"apis":{', '}}},"end":0}'), MODEL: ('{"models":{', ']}},"end":0}'), ROW: ('{"details":[', '],"end":0}'), TAIL: ('{"usage":{"apis":{', ',"end":0}')}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their place: file, block and a number that grows in it; their kind and, of an api or model, its name."""
    v = F.col("value")
    comma = F.startswith(v, F.lit(","))
    text = F.when(comma, F.substr(v, F.lit(2))).otherwise(v)
    begins, ends = (lambda x: F.startswith(F.col("text"), F.lit(x))), (lambda x: F.endswith(F.col("text"), F.lit(x)))
    kind = (
        F.when(F.col("text") == "]}", END_MODEL).when(F.col("text") == "}}", END_API)
        .when(begins("{") & ends('"apis":{'), HEAD).when(begins('"') & ends('"models":{'), API).when(begins('"') & ends('"details":['), MODEL)
        .when(begins("{") & ends("}"), ROW).when(begins("}") & ends("}"), TAIL).otherwise(ODD))
    name = lambda after: F.json_object_keys(F.concat(F.lit("{"), "text", F.lit(after)))[0]
    rows = spark.read.option("recursiveFileLookup", True).text(path).select(v, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    rows = rows.filter(F.trim(v) != "").select("file", "block", "id", comma.alias("comma"), text.alias("text")).withColumn("kind", kind)
    return rows.withColumn("name", F.when(F.col("kind") == API, name("}}}")).when(F.col("kind") == MODEL, name("]}}")))


def _object(kind: Column, text: Column) -> Column:
    """The line as a whole object."""
    out = F.lit(None).cast("string")
    for k, (before, after) in AROUND.items():
        inner = F.left(text, F.length(text) - 1) if k == TAIL else text
        out = F.when(kind == k, F.concat(F.lit(before), inner, F.lit(after))).otherwise(out)
    return out


def _follows(kind: Column, comma: Column, before: Column) -> Column:
    out = F.lit(False)
    for with_comma, rules in ((False, BEFORE), (True, BEFORE_COMMA)):
        for k, allowed in rules.items():
            out = out | ((kind == k) & (comma == with_comma) & before.isin(*allowed))
    return out


def read(spark: SparkSession, path: str, detail: str = DETAIL) -> DataFrame | None:
    """seq, kind, api, model and doc, the parsed line, of each line in a folder's documents; None for documents of another form.

    A document may go on in the next file by name, and a file may hold several. Lines are dealt out by blocks of files;
    what the blocks before one leave open (a small table, a row for each) is joined to it. seq grows in document order
    and has the bits of records.position(). Every line has to be a whole one that may follow the one before it.
    """
    lines = _lines(spark, path)
    own = lambda x, *kinds: F.max_by(x, F.when(F.col("kind").isin(*kinds), F.col("id"))) if kinds else F.max_by(x, "id")
    blocks = kept(lines.groupBy("file", "block").agg(own("name", API).alias("api"), own("name", MODEL).alias("model"), own("kind").alias("last"), F.bool_or(F.col("kind") == ODD).alias("odd")))
    if blocks.isEmpty() or not blocks.filter("odd").isEmpty() or blocks.agg(F.max_by("last", F.struct("file", "block"))).first()[0] != TAIL:
        return None
    in_order = Window.orderBy("file", "block")  # a row for each block
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    opened = blocks.select(
        "file", "block", (F.row_number().over(in_order) - 1).cast("long").alias("number"), F.last("api", True).over(earlier).alias("open_api"),
        F.last("model", True).over(earlier).alias("open_model"), F.coalesce(F.lag("last").over(in_order), F.lit("")).alias("open_kind"))
    w = Window.partitionBy("file", "block").orderBy("id")
    up_to = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind, at = F.col("kind"), F.col("id").bitwiseAND((1 << 33) - 1)
    held = lambda k: F.last(F.when(kind == k, F.col("name")), True).over(up_to)
    rows = lines.withColumns({"api": held(API), "model": held(MODEL), "before": F.lag("kind").over(w)}).join(opened, ["file", "block"])
    fits = (at < 1 << ROW_BITS) & (F.col("number") < 1 << PART_BITS)
    seq = F.when(fits, F.col("number") * (1 << ROW_BITS) + at).otherwise(F.raise_error(F.lit("a document has too many lines for arrival numbers")).cast("long"))
    model = f"struct<total_requests:long,total_tokens:long,details:array<{detail}>>"
    api = f"struct<total_requests:long,success_count:long,failure_count:long,total_tokens:long,models:map<string,{model}>>"
    usage = f"struct<total_requests:long,success_count:long,failure_count:long,total_tokens:long,apis:map<string,{api}>,requests_by_day:map<string,long>,requests_by_hour:map<string,long>,tokens_by_day:map<string,long>,tokens_by_hour:map<string,long>>"
    schema = f"version int, exported_at string, failed_requests long, generated_at string, usage {usage}, apis map<string,{api}>, models map<string,{model}>, details array<{detail}>, _corrupt string"
    rows = rows.select(seq.alias("seq"), "kind", F.coalesce("api", "open_api").alias("api"), F.coalesce("model", "open_model").alias("model"), _follows(kind, F.col("comma"), F.coalesce("before", "open_kind")).alias("follows"), _object(kind, F.col("text")).alias("object"))
    doc, keys = F.col("doc"), F.json_object_keys("object")
    one = F.when(kind == API, F.size(doc["apis"]) == 1).when(kind == MODEL, F.size(doc["models"]) == 1).when(kind == ROW, (F.size(keys) == 2) & (F.size(doc["details"]) == 1)).otherwise(True)
    whole = F.when(kind.isin(END_MODEL, END_API), True).otherwise(F.coalesce(F.element_at(keys, -1) == "end", F.lit(False)))
    parsed = rows.withColumn("doc", F.from_json("object", schema, {"columnNameOfCorruptRecord": "_corrupt"}))
    wrong = whole & doc["_corrupt"].isNotNull()
    out = kept(parsed.select("seq", "kind", "api", "model", "doc", F.coalesce(F.col("follows") & whole & (one | wrong), F.lit(False)).alias("fits"), wrong.alias("wrong")))
    return None if not out.filter("NOT fits").isEmpty() else out.drop("fits")
