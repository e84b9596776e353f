"""The log: decoding, retention, merging, prices, storage, streaming."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from meterlake.config import Settings, as_bool, as_int, read_settings
from meterlake.operators import aggregates as A
from meterlake.operators import events as E
from meterlake.operators import prices as P
from meterlake.operators import retention as R
from meterlake.operators import series
from meterlake.plans.management import UsageLog
from meterlake.schema import EVENT_COLUMNS
from meterlake.sources import records, storage

NOW = None  # a Column, made once there is a session
T0 = dt.datetime(2024, 3, 10, 12, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module", autouse=True)
def clock(spark):
    global NOW
    NOW = F.lit("2024-03-10 12:00:00").cast("timestamp")


def push(spark, *rows):
    return spark.createDataFrame([(json.dumps(r) if isinstance(r, dict) else r,) for r in rows], "value string")


def record(hours_ago=1.0, **more):
    at = (T0 - dt.timedelta(hours=hours_ago)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return {"provider": "codex", "model": "gpt", "api_key": "sk-shop-07-front-qx", "requested_at": at, "detail": {"input_tokens": 10, "output_tokens": 5}} | more


def log_of(spark, *rows, settings=Settings()):
    log = UsageLog(spark, settings)
    log.record(push(spark, *rows), NOW)
    return log


def test_legacy_names_decode_to_the_same_row(spark):
    new = record(failed=True, failure={"status_code": 429, "body": "b"}, latency=2_500_000, base_url="https://x", executor_type="run")
    old = {"Provider": "codex", "Model": "gpt", "APIKey": "sk-shop-07-front-qx", "RequestedAt": new["requested_at"], "Detail": {"InputTokens": 10, "OutputTokens": 5}, "Failed": True, "Failure": {"StatusCode": 429, "Body": "b"}, "Latency": 2_500_000, "baseUrl": "https://x", "ExecutorType": "run", "Unknown": {"a": 1}}
    rows = records.normalize(records.decode(push(spark, new, old)), NOW).drop("ingest_seq").collect()
    assert rows[0] == rows[1]
    assert rows[0]["latency_ms"] == 2 and rows[0]["total_tokens"] == 15 and rows[0]["api_key"] == "sk******qx"


def test_alias_is_not_a_model_and_nonsense_is_left_out(spark):
    rows = records.normalize(records.decode(push(spark, {"alias": "nice"}, "nonsense", "[]", "", "null")), NOW).collect()
    assert [(r["model"], r["api"], r["ts"].year) for r in rows] == [("unknown", "未知接口", 2024)]


def test_repeats_cap_and_retention(spark):
    log = log_of(spark, record(), record(), record(2))
    assert log.rows.count() == 2
    assert log_of(spark, record(), record(), settings=Settings(dedup_window_minutes=0)).rows.count() == 2
    rows = [record(3 - i, detail={"total_tokens": i + 1}) for i in range(3)]
    log = log_of(spark, *rows, settings=Settings(max_details_per_model=2))
    assert A.overall(log.rows).select("total_requests", "total_tokens").first() == (2, 5)
    assert log.evicted_total == 1
    log = log_of(spark, record(48, detail={"total_tokens": 100}), record(0, detail={"total_tokens": 7}), settings=Settings(retention_days=1))
    assert A.overall(log.rows).select("total_requests", "total_tokens").first() == (1, 7)
    assert R.cap_rows(log.rows, 0).count() == 0 and R.cap_rows(log.rows, None).count() == 1


def test_empty_log_answers(spark):
    log = UsageLog(spark)
    assert log.health()["detail_count"] == 0
    assert {n: df.count() for n, df in log.summary(NOW).items()}["health"] == 672
    assert log.events({}, NOW)[1] == 0
    assert A.overall(log.rows).first()["total_tokens"] == 0
    assert json.loads(log.export("x").first()["value"])["detail_count"] == 0


def test_paging_rules(spark):
    log = log_of(spark, *(record(i / 10) for i in range(20)))
    page, total = log.events({"limit": "5", "offset": "5"}, NOW)
    assert (page.count(), total) == (5, 20) and "api" not in page.columns
    assert E.Query(limit=501).page == 50 and E.Query(limit=0).page == 50 and E.Query(limit=500).page == 500
    assert E.Query.parse({"limit": "x", "offset": "-1"}) == E.Query()
    assert log.events({"offset": "100"}, NOW)[0].count() == 0
    assert log.events({"range": "24h", "model": "gpt", "source": "codex", "api": "codex"}, NOW)[1] == 20


def test_clients_with_one_mask_are_one(spark):
    keys = [record(i, api_key=f"sk-{i}-xx", detail={"total_tokens": 80}) for i in (1, 2)]
    rows = A.by_client(log_of(spark, *keys).rows).collect()
    assert [(r["client"], r["total_requests"], r["total_tokens"]) for r in rows] == [("api_key:sk******xx", 2, 160)]


def test_health_grid_ends_now(spark):
    log = log_of(spark, record(0), record(0.1, failed=True), record(7 * 24 + 0.1), record(7 * 24 + 1), record(-1))
    grid = {r["slot"]: (r["total"], r["failure"]) for r in series.health_grid(log.rows, NOW).collect()}
    assert len(grid) == 672 and grid[671] == (1, 1) and grid[0] == (1, 0) and sum(t for t, _ in grid.values()) == 2


def test_prices(spark, tmp_path):
    table = P.make(spark, {"a": (1, 2)})
    table = P.upsert(P.upsert(table, " a ", 3, 4), "b", 0, 0, 5)
    assert {r["model"]: (r["prompt"], r["cache"]) for r in table.collect()} == {"a": (3.0, 3.0), "b": (0.0, 5.0)}
    for bad in (("", 1, 1), ("a", -1, 1), ("a", float("nan"), 1), ("a", 1, float("inf"))):
        with pytest.raises(ValueError):
            P.upsert(table, *bad)
    path = str(tmp_path / "prices.json")
    P.save(table, path, "2024-01-01T00:00:00Z")
    assert os.stat(path).st_mode & 0o777 == 0o600
    assert sorted(P.read(spark, path).collect()) == sorted(table.collect())
    assert P.read(spark, str(tmp_path / "none.json")).count() == 0
    assert P.delete(table, "missing").count() == 2
    log = log_of(spark, record(detail={"input_tokens": 1_000_000, "output_tokens": 500_000, "reasoning_tokens": 100_000, "cached_tokens": 200_000}))
    assert P.cost_by(A.by_model(log.rows), P.make(spark, {"gpt": (30, 60, 15)})).first()["cost"] == 63.0
    assert P.cost_by(A.by_model(log.rows), P.make(spark, {})).first()["cost"] == 0.0


def test_snapshot_goes_out_and_comes_in_once(spark, tmp_path):
    log = log_of(spark, record(1), record(2, model="m2", failed=True), record(3, response_headers={"X-A": ["1"]}), settings=Settings(log_response_headers="*"))
    path = str(tmp_path / "export")
    log.export("2024-03-10T12:00:00Z").coalesce(1).write.text(path)
    other = UsageLog(spark)
    assert other.import_file(path, NOW)["added"] == 3
    assert other.import_file(path, NOW) == {"input_records": 3, "accepted_records": 3, "rejected_records": 0, "added": 0, "skipped": 3, "ignored_by_retention": 0}
    columns = [c for c in EVENT_COLUMNS if c not in ("ingest_seq", "headers", "thinking")]
    assert sorted(map(str, other.rows.select(columns).collect())) == sorted(map(str, log.rows.select(columns).collect()))


@pytest.mark.parametrize("text,code", [("{", "invalid_json"), ('{"version": 7}', "unsupported_version"), ('{"version":1,"usage":{"apis":{"a":{"models":{"m":{"details":[{"tokens":{"input_tokens":-1}}]}}}}}}', "invalid_record")])
def test_bad_imports_are_rejected(spark, tmp_path, text, code):
    path = tmp_path / "in.json"
    path.write_text(text)
    with pytest.raises(storage.ImportRejected) as e:
        storage.read_snapshot(spark, str(path))
    assert e.value.code == code


def test_import_counts(spark, tmp_path):
    detail = lambda at, **more: {"model": "gpt", "timestamp": at, "provider": "codex", "source": "codex", "latency_ms": -5, "tokens": {"input_tokens": 1}} | more
    doc = {"version": 1, "usage": {"apis": {"codex": {"models": {"gpt": {"details": [detail("2024-03-10T11:00:00Z"), detail("2024-03-10T11:00:00Z"), detail("2023-01-01T00:00:00Z")]}}}, " ": {"models": {"gpt": {"details": [detail("2024-03-10T10:00:00Z")]}}}}}}
    path = tmp_path / "in.json"
    path.write_text(json.dumps(doc))
    log = UsageLog(spark)
    assert log.import_file(str(path), NOW) == {"input_records": 4, "accepted_records": 3, "rejected_records": 1, "added": 1, "skipped": 1, "ignored_by_retention": 1}
    assert log.rows.select("latency_ms", "total_tokens").first() == (0, 1)


def test_lines_replay_once_and_pass_over_bad_ones(spark, tmp_path):
    log = log_of(spark, record(1), record(2))
    path = str(tmp_path / "log")
    storage.append_lines(log.rows, path)
    storage.append_lines(log.rows.limit(1), path)
    (tmp_path / "log" / "more.txt").write_text('\n{"api": " ", "detail": {}}\nnot json\n')
    assert storage.replay_lines(spark, path, UsageLog(spark).rows, NOW).count() == 2
    assert storage.replay_lines(spark, path, log.rows, NOW).count() == 0


def test_csv_quotes_everything(spark, tmp_path):
    log = log_of(spark, record(model='a"b', failed=True, failure={"status_code": 500, "body": "x,y"}))
    path = str(tmp_path / "csv")
    storage.write_csv(log.rows, path)
    text = next(p for p in (tmp_path / "csv").glob("part-*")).read_text()
    assert text.splitlines()[0] == ",".join(f'"{c}"' for c in storage.CSV_COLUMNS)
    assert '"a""b"' in text and '"x,y"' in text and '"failed"' in text


def test_stream_stores_each_request_once(spark, tmp_path):
    from meterlake.streaming import ingest

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("\n".join(json.dumps(r) for r in (record(1), record(1), record(2))) + "\nbad\n")
    settings = Settings(retention_days=0)

    def go():
        rows = ingest.event_stream(ingest.record_stream(spark, str(source)), settings)
        ingest.store(rows, str(tmp_path / "table"), str(tmp_path / "check"), settings, once=True).awaitTermination()
        return ingest.stored(spark, str(tmp_path / "table")).count()

    assert go() == 2
    (source / "b.txt").write_text(json.dumps(record(1)) + "\n" + json.dumps(record(0.5)) + "\n")
    assert go() == 3


def test_settings():
    assert read_settings("") == Settings()
    text = "plugins:\n  configs:\n    usage-statistics:\n      retention_days: '7'\n      storage_enabled: 'yes'\n      max_details_per_model: 2.0\n      dedup_window_minutes: -1\n"
    got = read_settings(text)
    assert (got.retention_days, got.storage_enabled, got.max_details_per_model, got.dedup_window_minutes) == (7, True, 2, 1440)
    assert read_settings("usage-statistics: {retention_days: 3}").retention_days == 3
    assert read_settings("retention_days: 4").retention_days == 4
    assert as_int(True) is None and as_int(1.5) is None and as_bool("off") is False and as_bool("x") is None
    assert Settings(api_key_hash_salt="s").patched(api_key_hash_salt="", retention_days=None) == Settings(api_key_hash_salt="s")
    assert "api_key_hash_salt" not in Settings().public()


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    log_of(spark, record(1)).rows.write.parquet(path)
    found = E.select_events(spark.read.parquet(path), E.Query(model="gpt", range="24h"), NOW).agg(F.sum("total_tokens"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(model,gpt)" in plan and "GreaterThanOrEqual(ts" in plan
    assert "base_url" not in plan.split("ReadSchema")[1]


def test_stream_takes_any_time_and_counts_what_has_expired(spark, tmp_path):
    from meterlake.streaming import ingest

    source = tmp_path / "in"
    source.mkdir()
    settings = Settings(retention_days=36_500, storage_enabled=True, storage_path=str(tmp_path / "lines"))

    def go(name, *rows):
        (source / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")
        stream = ingest.event_stream(ingest.record_stream(spark, str(source)), settings)
        ingest.store(stream, str(tmp_path / "table"), str(tmp_path / "check"), settings, once=True).awaitTermination()

    go("a.txt", record(-24 * 365 * 60), record(1))
    go("b.txt", record(1), record(2), record(3), record(24 * 365 * 110))
    rows = ingest.stored(spark, str(tmp_path / "table")).orderBy("ingest_seq").collect()
    assert len(rows) == 4 and len({r["ingest_seq"] for r in rows}) == 4 and {r["ts"].year for r in rows[:2]} == {2024, 2084}
    assert tuple(ingest.ingested(spark, str(tmp_path / "table")).first()) == (5, 1)
    assert storage.replay_lines(spark, str(tmp_path / "lines"), UsageLog(spark).rows, NOW).count() == 4


def test_log_keeps_lines_prices_and_its_last_time(spark, tmp_path):
    where = {"storage_enabled": True, "storage_path": str(tmp_path / "lines"), "price_storage_path": str(tmp_path / "prices.json")}
    log = UsageLog(spark)
    log.patch(NOW, max_details_per_model=7, **where)
    log.record(push(spark, record(1), record(2)), NOW)
    log.record(push(spark, record(2), record(0.5, failed=True)), NOW)
    assert log.rows.count() == 3 and log.rows.select("ingest_seq").distinct().count() == 3
    assert log.rows.orderBy("ingest_seq").collect()[-1]["failed"]
    log.put_price("gpt", 1, 2)
    again = UsageLog(spark)
    again.patch(NOW, **where)
    assert again.rows.count() == 3 and again.prices.count() == 1 and again.settings.max_details_per_model == 5000
    log.patch(NOW, retention_days=7)
    assert log.settings.max_details_per_model == 7  # others stay
    log.record(push(spark, record(1)), NOW + F.expr("INTERVAL 23 HOURS"))
    assert log.rows.count() == 3  # known by the time of its row
    log.patch(NOW + F.expr("INTERVAL 90 DAYS"))
    health = log.health()
    assert (health["total_requests"], health["evicted_total"], health["runtime"]["last_recorded_at"]) == (0, 3, "2024-03-10T11:30:00Z")
    assert health["storage"]["loaded_path"] == where["storage_path"]


def test_keys_are_forgotten_after_the_window_of_arrival(spark):
    log = UsageLog(spark, Settings(dedup_window_minutes=60, retention_days=0))
    for minutes, rows in ((0, 1), (30, 1), (80, 2)):
        log.record(push(spark, record(5)), NOW + F.make_interval(mins=F.lit(minutes)))
        assert log.rows.count() == rows


def test_full_dump_is_one_document(spark):
    log = log_of(spark, record(1), record(2, model='m"2', failed=True), record(3, provider="other"))
    doc = json.loads("\n".join(r["value"] for r in log.dashboard_data("2024-03-10T12:00:00Z").collect()))
    assert doc["failed_requests"] == 1 and doc["usage"]["total_requests"] == 3 and doc["usage"]["requests_by_day"] == {"2024-03-10": 3}
    assert json.loads(log.export("x").first()["value"])["usage"] == doc["usage"]
    assert json.loads("\n".join(r["value"] for r in UsageLog(spark).usage_document().collect()))["usage"]["apis"] == {}


def test_order_of_details_is_by_time_and_needs_no_group_in_one_row(spark, tmp_path):
    from meterlake import catalog

    times = [(i, dt.datetime(2024, 1, 1, 0, 0, 1, us), 1, "view", 1.0, '{"k": 1}') for i, us in enumerate((500_000, 0, 250_000))]
    spark.createDataFrame(times, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    found = catalog.QUERIES["t_detail"](spark, str(tmp_path))
    assert [(r["in_order"], r["n"]) for r in found.collect()] == [(True, 3)]  # as text, 1Z comes after 1.5Z
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    at = lambda *t: spark.createDataFrame([("a", "m", p << 33, (f"2024-01-01T00:00:0{s}Z",)) for p, s in enumerate(t)], "api string, model string, place long, detail struct<timestamp:string>")
    assert [storage.groups_in_order(at(*t)).first()["in_order"] for t in ((1, 2, 2), (1, 3, 2), (2, 1, 3))] == [True, False, False]
    one = at(1, 3, 2).withColumn("place", F.shiftright("place", 33))
    assert storage.groups_in_order(one).first()["in_order"] is False


def dumped(spark, log, path, files=1):
    """The log's export in lines, as files of about equal numbers of lines; some bytes of a block each, if read so."""
    storage.write_snapshot(log.rows, log.settings, "2024-03-10T12:00:00Z", str(path / "whole"))
    text = [x for p in sorted((path / "whole").glob("part-*")) for x in p.read_text().splitlines()]
    (path / "cut").mkdir()
    step = -(-len(text) // files)
    for i in range(0, len(text), step):
        (path / "cut" / f"part-{i:05d}.txt").write_text("\n".join(text[i:i + step]) + "\n")
    return str(path / "cut"), json.loads("\n".join(text))


def test_usage_of_any_size_is_read_and_imports_stay_bounded(spark, tmp_path, monkeypatch):
    from meterlake.plans import dashboard

    log = log_of(spark, record(1), record(2, model="m2"), record(3, model="m2", failed=True), record(4, provider="other"))
    path, _ = dumped(spark, log, tmp_path)
    monkeypatch.setattr(storage, "MOST_BYTES", 1000)
    monkeypatch.setattr(storage, "MOST_RECORDS", 3)
    assert sorted(map(tuple, dashboard.summary_of_document(spark, path, P.make(spark, {}), NOW)["api_models"].select("api", "model", "total_requests").collect())) == [("codex", "gpt", 1), ("codex", "m2", 2), ("other", "gpt", 1)]
    for code in ("payload_too_large", "too_many_records"):
        with pytest.raises(storage.ImportRejected) as e:
            UsageLog(spark).import_file(path, NOW)
        assert e.value.code == code
        monkeypatch.setattr(storage, "MOST_BYTES", 1_000_000)


def test_documents_in_lines_are_read_in_blocks_and_in_order(spark, tmp_path):
    from meterlake.sources import documents

    odd = 'a "details":[ \\ {x}, "apis":{'
    log = log_of(spark, *(record(i / 10, model=("gpt", odd, 'm},"b')[i % 3], provider=("codex", "other")[i % 2], failed=i % 4 == 0, failure={"body": '"}]},{'}) for i in range(30)))
    path, doc = dumped(spark, log, tmp_path, files=7)
    assert sum(len(m["details"]) for a in doc["usage"]["apis"].values() for m in a["models"].values()) == 30
    expected = [(a, m, d["timestamp"], d["failed"]) for a, x in doc["usage"]["apis"].items() for m, y in x["models"].items() for d in y["details"]]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
    try:
        lines = documents.read(spark, path)
        rows = lines.filter("kind = 'row'").orderBy("seq").select("api", "model", F.col("doc.details")[0]["timestamp"], F.col("doc.details")[0]["failed"])
        assert list(map(tuple, rows.collect())) == expected
        other = UsageLog(spark)
        assert other.import_file(path, NOW)["added"] == 30
        assert [tuple(r) for r in other.rows.orderBy("ingest_seq").select("api", "model").collect()] == [x[:2] for x in expected]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    flat = tmp_path / "flat.json"
    flat.write_text(json.dumps(doc, indent=1))
    assert documents.read(spark, str(flat)) is None and storage.read_snapshot(spark, str(flat)).count() == 30
    lines = [x for p in sorted((tmp_path / "cut").glob("part-*")) for x in p.read_text().splitlines()]
    at = next(i for i, x in enumerate(lines) if x.startswith(',{"model"'))
    joined = lines[:at - 1] + [lines[at - 1] + lines[at]] + lines[at + 1:]  # two rows in a line: valid, but another form
    for name, text, kept in (("joined", joined, 30), ("lost", lines[:at - 2] + lines[at:], None), ("short", lines[:-1], None), ("cut", lines[:at] + [lines[at][:-1]] + lines[at + 1:], None)):
        (tmp_path / f"{name}.json").write_text("\n".join(text))
        assert documents.read(spark, str(tmp_path / f"{name}.json")) is None
        if kept:
            assert storage.read_snapshot(spark, str(tmp_path / f"{name}.json")).count() == kept
            continue
        with pytest.raises(storage.ImportRejected) as e:
            storage.read_snapshot(spark, str(tmp_path / f"{name}.json"))
        assert e.value.code == "invalid_json"


def test_equal_rows_of_a_dump_stay_one_document(spark, tmp_path):
    rows = log_of(spark, record(1), record(1), record(2), record(2, failed=True), settings=Settings(dedup_window_minutes=0)).rows.withColumn("ingest_seq", F.lit(5).cast("long"))
    doc = json.loads("\n".join(r["value"] for r in storage.snapshot_lines(rows.unionByName(rows)).collect()))
    assert [len(m["details"]) for a in doc["usage"]["apis"].values() for m in a["models"].values()] == [8]


def test_imported_query_takes_more_than_one_import_may_hold(spark, sf_dir, monkeypatch):
    from meterlake import catalog

    monkeypatch.setattr(storage, "export_document", None)  # one row for all
    monkeypatch.setattr(storage, "MOST_BYTES", 1000)
    monkeypatch.setattr(storage, "MOST_RECORDS", 10)
    assert catalog.QUERIES["s_imp"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_full_dump_is_written_and_read_by_many_tasks(spark, sf_dir, monkeypatch):
    from pyspark.sql import DataFrameReader

    from meterlake import catalog

    def whole(*_, **__):
        raise AssertionError("a document read as one row")

    monkeypatch.setattr(DataFrameReader, "json", whole)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = catalog.QUERIES["dashboard_data"](spark, sf_dir).collect()
        dump = log_of(spark, *(record(i / 10) for i in range(40))).dashboard_data("x").withColumn("task", F.spark_partition_id())
        assert dump.select("task").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["details"] for r in rows) == spark.read.parquet(f"{sf_dir}/events.parquet").count() == rows[0]["total"]
