"""Durable forms of the log: JSON lines, snapshot documents, CSV."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import PLUGIN, Settings
from ..functions import numbers as N
from ..functions import text as T
from ..operators import aggregates
from ..operators.retention import classify_import, first_arrivals, import_counts, negative_tokens, normalize_import, without_known
from ..plans.keep import kept
from ..schema import EVENT_COLUMNS, LINE, SNAPSHOT, TOKENS
from . import documents
from .records import position

# Versions that an import may have, its most records and bytes, the columns of a CSV export.
VERSIONS, MOST_RECORDS, MOST_BYTES = (0, 1), 200_000, 50 * 1024 * 1024
CSV_COLUMNS = ("time", "model", "source", "credential", "result", "latency_ms", "ttft_ms", "input", "output", "reasoning", "cached", "total", "status", "error")


class ImportRejected(ValueError):
    """A snapshot that can't be imported; code says why."""

    def __init__(self, code: str, text: str = ""):
        super().__init__(f"{code}: {text}" if text else code)
        self.code = code


def time_text(ts: Column, offset: Column) -> Column:
    """RFC 3339 in the row's own zone, without a fraction that is 0."""
    local = N.local_time(ts, offset)
    fraction = F.regexp_replace(F.date_format(local, "SSSSSS"), "0+$", "")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), offset)


def detail(events: DataFrame) -> Column:
    """The nested form of a row."""
    c = F.col
    plain = [c(x) for x in ("latency_ms", "ttft_ms", "api_key", "api_key_hash", "source", "provider", "auth_id", "auth_index", "auth_type", "base_url", "thinking")]
    headers = F.map_from_entries(F.array_sort(F.map_entries("headers"), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return F.struct(c("model"), time_text(c("ts"), c("utc_offset")).alias("timestamp"), *plain, F.struct(*TOKENS).alias("tokens"), c("failed"), c("status_code"), c("failure"), headers.alias("headers"))


def flat(rows: DataFrame, nested: str = "detail") -> DataFrame:
    """Rows with a nested detail and outer_api, outer_model, ingest_seq as columns of the fact table, not yet normalized."""
    d = F.col(nested)
    text = lambda x: F.coalesce(d[x], F.lit("")).alias(x)
    number = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    return rows.select(
        "outer_api", "outer_model", "ingest_seq",
        text("model"), N.rfc3339(d["timestamp"]).alias("ts"), N.utc_offset(d["timestamp"]).alias("utc_offset"),
        *(number(d[x]).alias(x) for x in ("latency_ms", "ttft_ms")),
        *(text(x) for x in ("api_key", "api_key_hash", "source", "provider", "auth_id", "auth_index", "auth_type", "base_url")),
        d["thinking"].alias("thinking"), *(number(d["tokens"][x]).alias(x) for x in TOKENS),
        F.coalesce(d["failed"], F.lit(False)).alias("failed"), F.coalesce(d["status_code"], F.lit(0)).alias("status_code"), text("failure"), d["headers"].alias("headers"))


# -- JSON lines --------------------------------------------------------------------------------


def append_lines(events: DataFrame, path: str) -> None:
    """Append rows as lines of api, model and detail."""
    lines(events).write.mode("append").text(path)


def lines(events: DataFrame) -> DataFrame:
    return events.select(F.to_json(F.struct("api", "model", detail(events).alias("detail"))).alias("value"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a folder and those below it, with `_corrupt` set where a line isn't JSON of that form."""
    return spark.read.schema(LINE).option("recursiveFileLookup", True).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)


def replay_lines(spark: SparkSession, path: str, stored: DataFrame, now: Column) -> DataFrame:
    """Rows that the lines add to stored: valid lines with an api, normalized, each key once."""
    lines = read_lines(spark, path).filter("_corrupt IS NULL").filter(T.trim(F.col("api")) != "").filter("detail IS NOT NULL")
    rows = lines.select(F.col("api").alias("outer_api"), F.col("model").alias("outer_model"), "detail", F.monotonically_increasing_id().alias("ingest_seq"))
    return without_known(first_arrivals(normalize_import(flat(rows), now).select(*EVENT_COLUMNS)), stored)


# -- snapshots ---------------------------------------------------------------------------------


def _by_key(entries: Column) -> Column:
    return F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def ordered_details(events: DataFrame) -> DataFrame:
    """api, model, place, detail: a row for each detail in the order of a snapshot, place growing with it.

    Rows are dealt to tasks by api, model and time, and sorted there: neither a group nor the log needs to fit a task.
    """
    rows = events.select("api", "model", F.unix_micros("ts").alias("at"), "ingest_seq", detail(events).alias("detail")).orderBy("api", "model", "at", "ingest_seq")
    return rows.select("api", "model", F.monotonically_increasing_id().alias("place"), "detail")


def groups_in_order(details: DataFrame) -> DataFrame:
    """api, model, in_order, n: whether the times of a group's details never go back by place, and how many there are.

    Each task's stretch of a group is looked at by itself, then where one stretch follows another.
    """
    rows = details.select("api", "model", "place", F.shiftright("place", 33).alias("task"), N.rfc3339(F.col("detail")["timestamp"]).alias("t"))
    before = F.lag("t").over(Window.partitionBy("api", "model", "task").orderBy("place"))
    follows = lambda earlier: F.coalesce(earlier <= F.col("t"), F.lit(True))
    stretches = rows.withColumn("ok", follows(before)).groupBy("api", "model", "task").agg(F.min("t").alias("t"), F.max("t").alias("last"), F.bool_and("ok").alias("ok"), F.count("*").alias("n"))
    earlier = F.max("last").over(Window.partitionBy("api", "model").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    return stretches.withColumn("ok", F.col("ok") & follows(earlier)).groupBy("api", "model").agg(F.bool_and("ok").alias("in_order"), F.sum("n").cast("int").alias("n"))


def snapshot_apis(events: DataFrame) -> DataFrame:
    """One row for each api: counts and its models, each with counts and details by time.

    A group holds what retention leaves of one api and model, a number that the settings bound.
    """
    rows = events.select("api", "model", "ts", "ingest_seq", "failed", *TOKENS, detail(events).alias("detail"))
    order = F.array_sort(F.collect_list(F.struct(F.unix_micros("ts").alias("at"), "ingest_seq", "detail")), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).when(a["ingest_seq"] < b["ingest_seq"], -1).when(a["ingest_seq"] > b["ingest_seq"], 1).otherwise(0))
    counts = aggregates.measures4()
    names = ("total_requests", "success_count", "failure_count", "total_tokens")
    models = rows.groupBy("api", "model").agg(*counts, F.transform(order, lambda x: x["detail"]).alias("details"))
    entry = F.struct(F.col("model").alias("key"), F.struct("total_requests", "total_tokens", "details").alias("value"))
    return models.groupBy("api").agg(*(F.sum(n).alias(n) for n in names), F.map_from_entries(_by_key(F.collect_list(entry))).alias("models"))


def export_document(events: DataFrame, settings: Settings, exported_at: str, version: str = "1.0.0") -> DataFrame:
    """One row, the whole snapshot as JSON text: for logs that an import may hold. write_snapshot() has no such limit."""
    totals = aggregates.overall(events).select("total_requests", "success_count", "failure_count", "total_tokens")
    entry = F.struct(F.col("api").alias("key"), F.struct("total_requests", "success_count", "failure_count", "total_tokens", "models").alias("value"))
    apis = snapshot_apis(events).agg(F.map_from_entries(_by_key(F.collect_list(entry))).alias("apis"))

    def series(df: DataFrame, key: str, value: str) -> DataFrame:
        return df.agg(F.map_from_entries(_by_key(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))))).alias(f"{value}_by_{key}"))

    day, hour = aggregates.by_day(events), aggregates.by_hour(events)
    doc = totals
    for part in (apis, series(day, "day", "requests"), series(hour, "hour", "requests"), series(day, "day", "tokens"), series(hour, "hour", "tokens")):
        doc = doc.crossJoin(part)  # single rows
    usage = F.struct(*doc.columns)
    config = F.from_json(F.lit(_json(settings.public())), F.schema_of_json(F.lit(_json(settings.public()))))
    whole = F.struct(F.lit(1).alias("version"), F.lit(exported_at).alias("exported_at"), F.lit(PLUGIN).alias("plugin"), F.lit(version).alias("plugin_version"), F.col("total_requests").alias("detail_count"), config.alias("config"), usage.alias("usage"))
    return doc.select(F.to_json(whole).alias("value"))


def _json(value) -> str:
    import json

    return json.dumps(value, ensure_ascii=False)


def _quoted(x: Column) -> Column:
    listed = F.to_json(F.array(x))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def _open(x: Column) -> Column:
    """A JSON object's text without its last brace."""
    text = F.to_json(x)
    return F.substr(text, F.lit(1), F.length(text) - 1)


def snapshot_lines(events: DataFrame, before: str = "{", after: str = "}") -> DataFrame:
    """value: the lines of a document `before "usage": snapshot after`, one for each row of events and each group.

    Details are lines of their own, so no row holds more than one. Lines are dealt to tasks by their order and sorted
    there; written as text, the files by name are the document.
    """
    at = F.unix_micros("ts")
    order = ("section", "api", "part", "model", "piece", "at", "seq")
    zero, none = F.lit(0).cast("long"), F.lit("")
    line = lambda df, section, value, api=none, part=0, model=none, piece=0, at=zero, seq=zero, first=None: df.select(
        F.lit(section).alias("section"), api.alias("api"), F.lit(part).alias("part"), model.alias("model"), F.lit(piece).alias("piece"), at.alias("at"), seq.alias("seq"), value.alias("value"), (F.lit(None).cast("boolean") if first is None else first).alias("first"))
    comma = lambda *by: F.when(F.row_number().over(Window.partitionBy(*by[:-1]).orderBy(by[-1])) > 1, ",").otherwise("")
    names = ("total_requests", "success_count", "failure_count", "total_tokens")
    api, model = F.col("api"), F.col("model")
    models = events.groupBy("api", "model").agg(*aggregates.measures4())
    apis = models.groupBy("api").agg(*(F.sum(n).alias(n) for n in names))
    one = apis.agg(*(F.coalesce(F.sum(n), zero).alias(n) for n in names))
    earliest = events.groupBy(api.alias("_api"), model.alias("_model")).agg(F.min(F.struct(at.alias("at"), "ingest_seq")).alias("earliest"))
    rows = events.select("api", "model", at.alias("at"), "ingest_seq", F.to_json(detail(events)).alias("value")).join(earliest, api.eqNullSafe(F.col("_api")) & model.eqNullSafe(F.col("_model")))
    first = F.struct("at", "ingest_seq").eqNullSafe(F.col("earliest"))
    parts = [
        line(one, 0, F.concat(F.lit(f'{before}"usage":'), _open(F.struct(*names)), F.lit(',"apis":{'))),
        line(apis, 1, F.concat(comma("api"), _quoted(api), F.lit(":"), _open(F.struct(*names)), F.lit(',"models":{')), api),
        line(models, 1, F.concat(comma("api", "model"), _quoted(model), F.lit(":"), _open(F.struct("total_requests", "total_tokens")), F.lit(',"details":[')), api, 1, model),
        line(rows, 1, F.col("value"), api, 1, model, 1, F.col("at"), F.col("ingest_seq"), first),
        line(models, 1, F.lit("]}"), api, 1, model, 2),
        line(apis, 1, F.lit("}}"), api, 2),
    ]
    tail = events.sparkSession.range(1).select(F.lit("}").alias("value"))
    for key, df in (("day", aggregates.by_day(events)), ("hour", aggregates.by_hour(events))):
        for value in ("requests", "tokens"):
            counts = df.agg(F.to_json(F.map_from_entries(_by_key(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value")))))).alias("counts"))  # a number for each day or hour
            tail = tail.crossJoin(counts).select(F.concat("value", F.lit(f',"{value}_by_{key}":'), "counts").alias("value"))  # single rows
    parts.append(line(tail, 2, F.concat("value", F.lit("}" + after))))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    among_equals = F.row_number().over(Window.partitionBy(*order).orderBy("value"))  # the ranges serve it too
    out = whole.repartitionByRange(*order).withColumn("n", among_equals).sortWithinPartitions(*order, "value")
    return out.select(F.when(~F.col("first") | (F.col("n") > 1), F.concat(F.lit(","), "value")).otherwise(F.col("value")).alias("value"))


def write_snapshot(events: DataFrame, settings: Settings, exported_at: str, path: str, version: str = "1.0.0") -> None:
    """The document of export_document(), of any size, as a folder of text files: one after the other by name, they are the document."""
    n = events.count()
    head = {"version": 1, "exported_at": exported_at, "plugin": PLUGIN, "plugin_version": version, "detail_count": n, "config": settings.public()}
    snapshot_lines(events, _json(head)[:-1] + ",").write.text(path)


def snapshot_rows(documents: DataFrame) -> DataFrame:
    """Rows (outer_api, outer_model, detail fields) of parsed snapshot documents, in document order."""
    apis = documents.select(F.explode("usage.apis").alias("outer_api", "a"))
    models = apis.select("outer_api", F.explode("a.models").alias("outer_model", "m"))
    rows = models.select("outer_api", "outer_model", F.explode("m.details").alias("detail")).withColumn("ingest_seq", position())
    return flat(rows)


def read_snapshot(spark: SparkSession, path: str, most: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """Rows of a snapshot; ImportRejected for what may not come in, such as more records or bytes than given.

    Documents in lines, like those of write_snapshot(), may be of any size; one of another form has to fit a task.
    """
    if most_bytes is not None and (size := spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0) > most_bytes:
        raise ImportRejected("payload_too_large", f"{size} bytes")
    lines = documents.read(spark, path)
    if lines is not None:
        heads, invalid = lines.filter(F.col("kind") == documents.HEAD).select("doc.version"), not lines.filter("wrong").isEmpty()
    else:
        whole = spark.read.schema(f"{SNAPSHOT}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
        heads = whole.select("version", "_corrupt").limit(1)
        invalid = (head := heads.first()) is None or head["_corrupt"] is not None
    if invalid:
        raise ImportRejected("invalid_json")
    if (other := heads.filter(~F.coalesce("version", F.lit(0)).isin(*VERSIONS)).first()) is not None:
        raise ImportRejected("unsupported_version", str(other["version"]))
    if lines is not None:
        rows = flat(lines.filter(F.col("kind") == documents.ROW).select(F.col("api").alias("outer_api"), F.col("model").alias("outer_model"), F.col("doc.details")[0].alias("detail"), F.col("seq").alias("ingest_seq")))
    else:
        rows = kept(snapshot_rows(whole))  # parsed once
    if most is not None and rows.limit(most + 1).count() > most:
        raise ImportRejected("too_many_records")
    if not negative_tokens(rows).limit(1).isEmpty():
        raise ImportRejected("invalid_record", "a token count is negative")
    return rows


def import_snapshot(spark: SparkSession, path: str, stored: DataFrame, now: Column, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """New rows for stored, and the import counts."""
    rows = normalize_import(read_snapshot(spark, path, MOST_RECORDS, MOST_BYTES), now)
    classified = classify_import(rows, stored, now, settings.retention_days)
    return classified.filter("outcome = 'added'").select(*EVENT_COLUMNS), import_counts(classified)


# -- exports -----------------------------------------------------------------------------------


def csv_rows(events: DataFrame) -> DataFrame:
    c = F.col
    cells = (
        time_text(c("ts"), c("utc_offset")), c("model"), T.or_default(T.strip_credential(c("source")), "-"), c("auth_index"), F.when(c("failed"), "failed").otherwise("success"),
        c("latency_ms"), c("ttft_ms"), c("input_tokens"), c("output_tokens"), c("reasoning_tokens"), N.cached_tokens(c("cached_tokens"), c("cache_tokens")),
        N.total_tokens(c("total_tokens"), c("input_tokens"), c("output_tokens"), c("reasoning_tokens")), c("status_code"), c("failure"))
    return events.select(*(x.cast("string").alias(n) for x, n in zip(cells, CSV_COLUMNS)))


def write_csv(events: DataFrame, path: str) -> None:
    """All fields quoted, quotes doubled, a header in each file."""
    csv_rows(events).write.option("quoteAll", True).option("escape", '"').option("header", True).csv(path)


def write_json(events: DataFrame, path: str) -> None:
    events.select(F.to_json(detail(events)).alias("value")).write.text(path)


def file_name(text: str, most: int = 80) -> str:
    """A name that is safe in any file system."""
    return re.sub(r"[^\w.\-]+", "_", text).strip("_")[:most] or "export"
