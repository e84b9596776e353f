"""Registered queries over the usage log and their DuckDB SQL.

Each query is a thin call of the library's operators over the log that plans.adapter makes of the
`events` table; the SQL says the same independently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions import numbers as N
from .functions import text as T
from .operators import aggregates as A
from .operators import events as E
from .operators import prices as P
from .operators import retention as R
from .operators import series as S
from .plans import adapter as D
from .plans import dashboard
from .plans.keep import new_path
from .plans.management import UsageLog
from .schema import DEDUP_KEY, EVENT_COLUMNS, TOKENS
from .sources import documents, records, storage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Days of retention and rows of each group in the retention queries.
DAYS, CAP = 20, 100
_EV = D.EV.strip()
#: Cost of a row; sums have the larger of the two cached counts already.
_ROWCOST = D.COST.replace("greatest(cached_tokens, 0)", "greatest(cached_tokens, cache_tokens, 0)")


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None, *more: str) -> None:
    """Register a query and SQL over `ev`, `clock` and further common table expressions."""
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = "WITH " + ",\n".join([_EV, *more]) + "\n" + sql


def _over(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(D.usage(spark, d))


def _timed(f: Callable[[DataFrame, Column], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(D.usage(spark, d), D.clock(spark, d))


def _priced(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(D.usage(spark, d), P.make(spark, D.PRICED))


def _plain_time(df: DataFrame) -> DataFrame:
    """Times without a zone, as DuckDB has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


# -- roll-ups ----------------------------------------------------------------------------------

_add("a_glob", _over(A.overall), f"SELECT {D.M8}, {D.LAT} FROM ev")
_add("a_api", _over(A.by_api), f"SELECT api, {D.M8}, {D.LAT} FROM ev GROUP BY api")
_add("a_apimodel", _over(A.by_api_model), f"SELECT api, model, {D.M8}, {D.LAT} FROM ev GROUP BY api, model")
_add("a_hier", _over(A.hierarchy), f"SELECT api, model, {D.M8}, {D.LAT}, (2 - (grouping(api) + grouping(model)))::INT AS level FROM ev GROUP BY ROLLUP (api, model)")
_add("a_model", _over(A.by_model), f"SELECT model, {D.M8}, {D.LAT} FROM ev GROUP BY model")
_add("a_src", _over(A.by_source), f"SELECT CASE WHEN source = '' THEN '{T.UNKNOWN_SOURCE}' ELSE source END AS source, arg_min(provider, ingest_seq) AS provider, {D.M4} FROM ev GROUP BY 1")
_add("a_cred", _over(A.by_credential), f"SELECT CASE WHEN auth_index = '' THEN '{T.BLANK_CREDENTIAL}' ELSE auth_index END AS auth_index, {D.M4} FROM ev GROUP BY 1")
_add("a_client", _over(lambda e: A.by_client(e).drop("api_key_hash")), f"SELECT 'api_key:' || api_key AS client, api_key AS label, {D.M8} FROM ev GROUP BY 1, 2")
_add("a_client_hash", _over(lambda e: A.by_client(e).select("client", "api_key_hash")))
_add("a_clientmodel", _over(A.by_client_model), f"SELECT 'api_key:' || api_key AS client, model, {D.M8} FROM ev GROUP BY 1, 2")
_add("a_client_nested", _over(lambda e: A.clients_nested(e).select("client", F.size("models").alias("n_models"), F.element_at("models", 1)["model"].alias("top_model"), F.element_at("models", 1)["total_requests"].alias("top_requests"))),
     "SELECT client, count(*)::INT AS n_models, arg_min(model, -n * 1000 + right(model, 1)::INT) AS top_model, max(n) AS top_requests FROM (SELECT 'api_key:' || api_key AS client, model, count(*) AS n FROM ev GROUP BY 1, 2) GROUP BY 1")
_add("a_day", _over(A.by_day), "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS requests, sum(total_tokens)::BIGINT AS tokens FROM ev GROUP BY 1")
_add("a_hour", _over(A.by_hour), "SELECT strftime(ts, '%H') AS hour, count(*) AS requests, sum(total_tokens)::BIGINT AS tokens FROM ev GROUP BY 1")
_add("a_err", _over(A.errors), "SELECT status_code::VARCHAR AS status, failure AS error, count(*) AS n FROM ev WHERE failed GROUP BY 1, 2 ORDER BY n DESC, status, error LIMIT 10")
_RATE = "CASE WHEN count(*) = 0 THEN 100.0 ELSE count(*) FILTER (NOT failed) / count(*)::DOUBLE * 100 END"
_add("a_rate", _over(lambda e: A.with_rate(A.by_api(e)).select("api", "success_rate", "rate_class")), f"SELECT api, round({_RATE}, 6) AS success_rate, CASE WHEN {_RATE} >= 95 THEN 'ok' WHEN {_RATE} >= 80 THEN 'neutral' ELSE 'bad' END AS rate_class FROM ev GROUP BY api")
_add("a_nmodel", _over(A.distinct_counts), "SELECT api, count(DISTINCT model) AS models, count(DISTINCT source) AS sources FROM ev GROUP BY api")
_add("a_cnt_last", _over(lambda e: _plain_time(A.summary_metrics(e))), "SELECT count(*) AS detail_count, count(DISTINCT ingest_seq) AS seen_count, max(ts) AS last_recorded_at FROM ev")
_add("a_rpm", _timed(A.trailing_rpm), "SELECT round(count(*) FILTER (ts > now - INTERVAL 1 HOUR AND ts <= now) / 60.0::DOUBLE, 6) AS rpm FROM ev, clock")
_add("a_avg", _over(lambda e: e.groupBy("model").agg(F.round(A.mean_positive(F.col("ttft_ms")), 6).alias("avg_ttft_ms"))), "SELECT model, round(coalesce(avg(ttft_ms) FILTER (ttft_ms > 0), 0), 6) AS avg_ttft_ms FROM ev GROUP BY model")
_add("t_stats", _over(lambda e: A.stats_order(A.by_source(e), "source").limit(3).select("source", "total_requests")), f"SELECT CASE WHEN source = '' THEN '{T.UNKNOWN_SOURCE}' ELSE source END AS source, count(*) AS total_requests FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
_add("t_client", _over(lambda e: A.stats_order(A.by_client(e), "client", by="total_tokens").limit(10).select("client", "total_tokens")), "SELECT 'api_key:' || api_key AS client, sum(total_tokens)::BIGINT AS total_tokens FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
_add("t_top8", _over(lambda e: A.top_bars(A.by_credential(e), "auth_index", "total_requests")),
     f"SELECT name, value, greatest(4, round(value / max(value) OVER () * 100)::INT)::INT AS width FROM (SELECT CASE WHEN auth_index = '' THEN '{T.BLANK_CREDENTIAL}' ELSE auth_index END AS name, count(*) AS value FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)")

# -- time grids --------------------------------------------------------------------------------

_GRID = f"""grid AS (
  SELECT s.slot, count(e.slot) AS total, count(*) FILTER (NOT e.failed) AS success, count(*) FILTER (e.failed) AS failure
  FROM (SELECT unnest(range({S.SLOTS})) AS slot) s LEFT JOIN (
    SELECT failed, (epoch_us(ts) - epoch_us(now - INTERVAL 7 DAY)) // 900000000 AS slot FROM ev, clock
    WHERE ts > now - INTERVAL 7 DAY - INTERVAL 15 MINUTE) e USING (slot) GROUP BY 1)"""
_add("t_health", _timed(lambda e, now: _plain_time(S.health_grid(e, now))), "SELECT g.*, now - INTERVAL 7 DAY + slot * INTERVAL 15 MINUTE AS start FROM grid g, clock", _GRID)
_add("a_hsum", _timed(lambda e, now: S.health_rate(S.health_grid(e, now))), "SELECT sum(total)::BIGINT AS total, sum(success)::BIGINT AS success, round(CASE WHEN sum(total) = 0 THEN 100.0 ELSE sum(success) / sum(total)::DOUBLE * 100 END, 6) AS success_rate FROM grid", _GRID)
for _metric, _value in (("requests", "count(*)::DOUBLE"), ("tokens", "sum(total_tokens)::DOUBLE"), ("cost", f"round(sum({_ROWCOST}), 6)")):
    _add(f"a_bucket_{_metric}", lambda spark, d, m=_metric: S.bucket_series(D.usage(spark, d), P.make(spark, D.PRICED), D.clock(spark, d), m, 360, 28),
         f"SELECT b.bucket, coalesce(v.value, 0.0) AS value FROM (SELECT unnest(range(28)) AS bucket) b LEFT JOIN (SELECT (epoch_us(ts) - epoch_us(now) + 28 * 21600000000) // 21600000000 AS bucket, {_value} AS value FROM ev LEFT JOIN prices USING (model), clock WHERE ts < now AND epoch_us(ts) >= epoch_us(now) - 28 * 21600000000 GROUP BY 1) v USING (bucket)", D.PRICE_ROWS)

# -- prices and cost ---------------------------------------------------------------------------

_SUMS = f"sums AS (SELECT api, api_key, model, {D.M8} FROM ev GROUP BY 1, 2, 3), by_model AS (SELECT model, {D.M8} FROM ev GROUP BY 1)"
_add("a_cost", _priced(lambda e, p: P.cost_by(A.by_model(e), p)), f"SELECT round(coalesce(sum({D.COST}), 0), 6) AS cost FROM by_model LEFT JOIN prices USING (model)", D.PRICE_ROWS, _SUMS)
_add("j_price", _priced(lambda e, p: P.cost_by(A.by_model(e), p, "model")), f"SELECT model, round(sum({D.COST}), 6) AS cost FROM by_model LEFT JOIN prices USING (model) GROUP BY model", D.PRICE_ROWS, _SUMS)
_add("a_cost_api", _priced(lambda e, p: P.cost_by(A.by_api_model(e), p, "api")), f"SELECT api, round(sum({D.COST}), 6) AS cost FROM (SELECT api, model, {D.M8} FROM ev GROUP BY 1, 2) LEFT JOIN prices USING (model) GROUP BY api", D.PRICE_ROWS)
_add("a_cost_client", _priced(lambda e, p: P.cost_by(A.by_client_model(e), p, "client")), f"SELECT 'api_key:' || api_key AS client, round(sum({D.COST}), 6) AS cost FROM (SELECT api_key, model, {D.M8} FROM ev GROUP BY 1, 2) LEFT JOIN prices USING (model) GROUP BY 1", D.PRICE_ROWS)
_add("g_cost", _priced(lambda e, p: E.detailed(e, p).select("ingest_seq", "timestamp_ms", "total", "cached", F.round("cost", 6).alias("cost"))), f"SELECT ingest_seq, epoch_us(ts) // 1000 AS timestamp_ms, total_tokens AS total, greatest(cached_tokens, cache_tokens, 0) AS cached, round({_ROWCOST}, 6) AS cost FROM ev LEFT JOIN prices USING (model)", D.PRICE_ROWS)
_add("a_group", _priced(lambda e, p: A.grouped(e, p, F.col("auth_index"), T.or_default(F.col("auth_index"), "-"))),
     f"SELECT auth_index AS key, CASE WHEN auth_index = '' THEN '-' ELSE auth_index END AS label, {D.M4}, sum(greatest(cached_tokens, cache_tokens, 0))::BIGINT AS cached_tokens, sum(reasoning_tokens)::BIGINT AS reasoning_tokens, round(sum({_ROWCOST}), 6) AS cost, {D.LAT}, round(coalesce(avg(ttft_ms) FILTER (ttft_ms > 0), 0), 6) AS avg_ttft_ms FROM ev LEFT JOIN prices USING (model) GROUP BY auth_index", D.PRICE_ROWS)
_add("u_upsert", lambda spark, d: P.upsert(P.upsert(P.make(spark, D.PRICED), " model-2 ", 1, 2), "model-9", 3, 4, 5), "SELECT * FROM prices WHERE model <> 'model-2' UNION ALL VALUES ('model-2', 1.0, 2.0, 1.0), ('model-9', 3.0, 4.0, 5.0)", D.PRICE_ROWS)
_add("u_delete", lambda spark, d: P.delete(P.make(spark, D.PRICED), "model-2"), "SELECT * FROM prices WHERE model <> 'model-2'", D.PRICE_ROWS)
_add("u_read", lambda spark, d: P.make(spark, D.PRICED), "SELECT * FROM prices", D.PRICE_ROWS)
_ODD = {"ok": (1.0, 2.0, 3.0), " ": (1.0, 1.0, 1.0), "negative": (-1.0, 1.0, 1.0), "nan": (float("nan"), 1.0, 1.0), "inf": (1.0, float("inf"), 1.0), "zero": (0.0, 0.0, 0.0)}
_add("w_price", lambda spark, d: P.valid(P.make(spark, _ODD)), "SELECT * FROM (VALUES ('ok', 1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE), ('zero', 0.0, 0.0, 0.0)) t(model, prompt, completion, cache)")
_add("t_options", _priced(lambda e, p: P.options(e, P.overlay(p, P.make(e.sparkSession, {"model-9": (1, 1, 1)})))), "SELECT DISTINCT model FROM ev UNION SELECT model FROM prices UNION SELECT 'model-9'", D.PRICE_ROWS)

# -- filters, order, pages ---------------------------------------------------------------------


def _found(query: E.Query) -> Callable[[SparkSession, str], DataFrame]:
    return _timed(lambda e, now: E.select_events(e, query, now).select("ingest_seq", "api", "model"))


_add("w_range_24h", _found(E.Query(range="24h")), "SELECT ingest_seq, api, model FROM ev, clock WHERE ts >= now - INTERVAL 24 HOUR")
_add("w_range_7d", _found(E.Query(range="7d")), "SELECT ingest_seq, api, model FROM ev, clock WHERE ts >= now - INTERVAL 7 DAY")
_add("w_range_any", _found(E.Query(range="30d", limit=1)), "SELECT ingest_seq, api, model FROM ev")
_add("w_model", _found(E.Query(model="model-3")), "SELECT ingest_seq, api, model FROM ev WHERE model = 'model-3'")
_add("w_src", _found(E.Query(source=T.UNKNOWN_SOURCE)), "SELECT ingest_seq, api, model FROM ev WHERE source = ''")
_add("w_auth", _found(E.Query(auth_index="lane-07")), "SELECT ingest_seq, api, model FROM ev WHERE auth_index = 'lane-07'")
_add("w_auth_blank", _found(E.Query(blank_auth=True)), "SELECT ingest_seq, api, model FROM ev WHERE auth_index = ''")
_add("w_api", _found(E.Query(api="orchard · orchard-site")), "SELECT ingest_seq, api, model FROM ev WHERE api = 'orchard · orchard-site'")
_add("w_fail", _found(E.Query(failed_only=True, range="7h")), "SELECT ingest_seq, api, model FROM ev, clock WHERE failed AND ts >= now - INTERVAL 7 HOUR")
_PAGE = E.Query(range="7d", model="model-1", limit=50, offset=50)
_add("t_page", _timed(lambda e, now: E.page(e, _PAGE, now)[0].select("ingest_seq", "model", "total_tokens")), "SELECT ingest_seq, model, total_tokens FROM ev, clock WHERE model = 'model-1' AND ts >= now - INTERVAL 7 DAY ORDER BY ts DESC, api, ingest_seq DESC LIMIT 50 OFFSET 50")
_add("t_page_total", _timed(lambda e, now: E.page(e, _PAGE, now)[1]), "SELECT count(*) AS total FROM ev, clock WHERE model = 'model-1' AND ts >= now - INTERVAL 7 DAY")
_add("t_page_beyond", _timed(lambda e, now: E.page(e, E.Query(limit=501), now)[0].select("ingest_seq")), "SELECT ingest_seq FROM ev ORDER BY ts DESC, api, ingest_seq DESC LIMIT 50")
_add("t_recent", _over(lambda e: E.recent(e, "quarry · quarry-site").select("ingest_seq")), "SELECT ingest_seq FROM ev WHERE api = 'quarry · quarry-site' ORDER BY ts DESC, ingest_seq DESC LIMIT 120")
_add("t_events", _over(lambda e: E.ordered(e).limit(500).select("ingest_seq", "api")), "SELECT ingest_seq, api FROM ev ORDER BY ts DESC, api, ingest_seq DESC LIMIT 500")
_add("t_names", _over(E.model_names), "SELECT DISTINCT model FROM ev")
_add("t_auths", _over(E.auth_names), "SELECT DISTINCT CASE WHEN auth_index = '' THEN '-' ELSE auth_index END AS auth_index FROM ev")
_add("j_semi", _over(lambda e: E.existing(e, e.sparkSession.createDataFrame([("orchard",), ("gone",), ("harbour · harbour-site",)], "api string"))), "SELECT api FROM (VALUES ('orchard'), ('gone'), ('harbour · harbour-site')) t(api) WHERE api IN (SELECT api FROM ev)")

# -- duplicates, retention, merging ------------------------------------------------------------


def _repeated(e: DataFrame) -> DataFrame:
    again = e.filter(F.col("ingest_seq") % 10 == 0).withColumn("ingest_seq", F.col("ingest_seq") + 10_000_000)
    return e.unionByName(again)


_add("o_dedup1", _over(lambda e: R.first_arrivals(_repeated(e)).select("ingest_seq", "api", "total_tokens")), "SELECT ingest_seq, api, total_tokens FROM ev")
_add("f_dedup", _over(lambda e: R.distinct_keys(_repeated(e)).agg(F.count("*").alias("keys"))), "SELECT count(*) AS keys FROM ev")
_add("t_dedup_off", _over(lambda e: R.dedup_live(_repeated(e), 0).agg(F.count("*").alias("n"))), "SELECT count(*) + count(*) FILTER (ingest_seq % 10 = 0) AS n FROM ev")
_add("w_ret", _timed(lambda e, now: R.within(e, now, DAYS).agg(*A.measures4())), f"SELECT {D.M4} FROM ev, clock WHERE ts >= now - INTERVAL {DAYS} DAY")
_add("o_ret2", _over(lambda e: R.cap_rows(e, CAP).select("api", "model", "ingest_seq")), f"SELECT api, model, ingest_seq FROM ev QUALIFY row_number() OVER (PARTITION BY api, model ORDER BY ts DESC, ingest_seq DESC) <= {CAP}")
_KEPT = f"recent AS (SELECT ev.* FROM ev, clock WHERE ts >= now - INTERVAL {DAYS} DAY), kept AS (SELECT * FROM recent QUALIFY row_number() OVER (PARTITION BY api, model ORDER BY ts DESC, ingest_seq DESC) <= {CAP})"
_add("u_evict", _timed(lambda e, now: A.by_api_model(R.prune(e, now, DAYS, CAP))), f"SELECT api, model, {D.M8}, {D.LAT} FROM kept GROUP BY 1, 2", _KEPT)
_add("a_evict", _timed(lambda e, now: R.evicted(e, now, DAYS, CAP)), "SELECT a - b AS expired, b - c AS capped, a - c AS evicted FROM (SELECT (SELECT count(*) FROM ev) AS a, (SELECT count(*) FROM recent) AS b, (SELECT count(*) FROM kept) AS c)", _KEPT)
_add("j_anti", _over(lambda e: R.without_known(e, e.filter("ingest_seq % 2 = 0")).select("ingest_seq")), "SELECT ingest_seq FROM ev WHERE ingest_seq % 2 = 1")


def _import(e: DataFrame) -> DataFrame:
    """All rows, every tenth twice and every 25th for a blank api, as an import over the even ones."""
    return _repeated(e).withColumn("outer_api", F.when(F.col("ingest_seq") % 25 == 3, " ").otherwise(F.col("api")))


_add("a_impc", _timed(lambda e, now: R.import_counts(R.classify_import(_import(e), e.filter("ingest_seq % 2 = 0"), now, DAYS))),
     """SELECT count(*) AS input_records, count(*) FILTER (o <> 'r') AS accepted_records, count(*) FILTER (o = 'r') AS rejected_records,
        count(*) FILTER (o = 'a') AS added, count(*) FILTER (o = 's') AS skipped, count(*) FILTER (o = 'i') AS ignored_by_retention FROM outcomes""",
     f"""doubled AS (SELECT ev.*, ingest_seq AS seq, 1 AS copy FROM ev UNION ALL SELECT ev.*, ingest_seq + 10000000, 2 FROM ev WHERE ingest_seq % 10 = 0),
outcomes AS (SELECT CASE WHEN seq % 25 = 3 THEN 'r' WHEN ts < now - INTERVAL {DAYS} DAY THEN 'i' WHEN ingest_seq % 2 = 0 OR copy = 2 THEN 's' ELSE 'a' END AS o FROM doubled, clock)""")
_add("u_merge", _timed(lambda e, now: A.by_api_model(R.merge(e.filter("ingest_seq % 2 = 0"), _repeated(e), now, DAYS, CAP)[0])), f"SELECT api, model, {D.M8}, {D.LAT} FROM kept GROUP BY 1, 2", _KEPT)
_add("w_impv", _over(lambda e: R.negative_tokens(e.withColumn("input_tokens", F.when(F.col("ingest_seq") % 100 == 7, -1).otherwise(F.col("input_tokens")))).select("ingest_seq")), "SELECT ingest_seq FROM ev WHERE ingest_seq % 100 = 7")

# -- scalar functions --------------------------------------------------------------------------


def _cases(name: str, f: Callable[[Column], Column], pairs: list[tuple[str, object]]) -> None:
    """A query that applies f to one of the texts of pairs for each event; the SQL has the results."""
    n = len(pairs)

    def query(spark: SparkSession, d: str) -> DataFrame:
        raw = F.element_at(F.array(*(F.lit(a) for a, _ in pairs)), (F.col("event_id") % n + 1).cast("int"))
        return spark.read.parquet(f"{d}/events.parquet").select("event_id", raw.alias("raw")).select("event_id", f(F.col("raw")).alias("result"))

    quote = lambda b: str(b).upper() if isinstance(b, bool) else str(b) if isinstance(b, int) else "'" + str(b).replace("'", "''") + "'"
    QUERIES[name] = query
    ORACLE_SQL[name] = "SELECT event_id, CASE event_id % " + str(n) + "".join(f" WHEN {i} THEN {quote(b)}" for i, (_, b) in enumerate(pairs)) + " END AS result FROM events"


_HEX, _LONG = "0fe1d2c3b4a59687", "a" * 45
_cases("f_mask", T.mask_key, [("sk-shop-07-front-qx", "sk******qx"), ("", ""), (" ab ", "a******"), ("abcd", "a******"), ("abcde", "ab******de")])
_cases("f_tmask", T.mask_token, [("abcd", "******"), ("abcde", "ab******de"), ("sk-1234567", "sk******67")])
_cases("f_secret", T.looks_secret, [("sk-x", True), ("AIzaQ", True), ("hf_", True), ("pk_1", True), ("rk_1", True), ("plain", False), (_LONG, True), ("a-" + _LONG, False), ("a-" * 41, True), ("", False)])
_cases("f_credid", T.looks_credential_id, [("deadbeef", True), ("deadbee", False), ("nothexadecimal", False), ("g" * 32, True), ("g.h" * 12, False)])
_cases("f_sectok", T.looks_secret_token, [("sk-1234", False), ("sk-12345", True), ("x" * 31, False), ("x" * 32, True)])
_cases("f_mark", T.is_marker, [("api-key", True), ("API_KEY", True), (" Credential ", True), ("auth", True), ("keys", False)])
_cases("f_split", lambda x: F.array_join(T.name_parts(x), "+"), [("a · b - c", "a+b - c"), ("a - b", "a+b"), ("a | b/c", "a+b/c"), ("a/b", "a+b"), ("a", "a")])
_cases("f_strip", T.strip_credential, [(f"openai-compatible-harbour · apikey · {_HEX}", "openai-compatible-harbour"), ("openai-compatibility:harbour:77aa88bb99cc", "openai-compatibility:harbour"), ("harbour - sk-77q2", "harbour"), ("harbour | sk-77q2", "harbour"), ("harbour - apikey - tail7", "harbour"), ("apikey/x", "apikey/x"), ("a/b", "a/b"), (" plain ", "plain"), ("", ""), (f"a | b | {_HEX}", "a · b")])
_cases("f_cident", T.credential_identity, [(f"x · apikey · {_HEX}", _HEX), ("x - key - a - b", "a · b"), ("x:auth:y:z", "y:z"), ("a:b:deadbeef01", "deadbeef01"), (f"a/{_HEX}", _HEX), ("plain", ""), ("", "")])
_cases("f_safeid", T.safe_identity, [("x · key · sk-abcdefgh", "sk******gh"), ("auth-01", "auth-01"), ("", ""), ("x:key:me", "me")])
_cases("f_src", lambda x: T.source_label(x, F.lit("codex"), F.lit("")), [("team - sk-abc123", "team"), ("sk-abc123", "codex"), ("", "codex"), ("shop", "shop")])
_cases("f_chan", lambda x: T.channel_label(F.lit(""), x, F.lit("id-9")), [("x · key · me", "上游 me"), ("plain", "上游 id-9")])
_cases("f_api", lambda x: T.group_key(F.lit("codex"), F.lit(""), x, F.lit(""), F.lit("lane-4"), F.lit("")), [("codex", "codex · 上游 lane-4"), ("sk-77q2zz", "codex · 上游 lane-4"), ("shop", "codex · shop"), ("", "codex · 上游 lane-4")])
_cases("f_api_base", lambda x: T.group_key(x, F.lit("run"), F.lit("public"), F.lit("https://gate.example.org/v2"), F.lit(""), F.lit("")), [("codex", "codex · https://gate.example.org/v2"), ("openai-compatible-a", "openai-compatible-a · public"), ("", "run · https://gate.example.org/v2")])
_cases("f_rekey", lambda x: T.rekey(F.lit("old"), x, F.lit("shop"), F.lit(""), F.lit(""), F.lit("")), [("codex", "codex · shop"), ("", "old · shop")])
_cases("f_oai", T.is_openai_compatible, [("OpenAI-Compatible-x", True), (" openai-compatibility:a", True), ("openai", False)])
_cases("f_join", lambda x: T.join_names(x, F.lit(" b "), x, F.lit("")), [("a", "a · b"), ("b", "b"), ("", "b")])
_cases("f_model", T.model_name, [(" gpt ", "gpt"), ("", "unknown"), (" ", "unknown")])
_cases("f_think", lambda x: T.thinking(x)["level"], [(" high ", "high"), ("", "")])
_cases("f_trim", lambda x: F.octet_length(T.cut_long(x)), [("a" * 500, 500), ("a" * 501, 503), ("é" * 251, 503), (" x ", 1), ("a" + "é" * 251, 502)])
_cases("f_redact", T.redact, [("Authorization: Bearer sk-q7w8e9r0t1y2", "Authorization: Bearer sk******y2"), ("task-force", "task******ce"), ("AIzaX!", "AI******aX!"), ("use sk- here", "use ****** here"), ("a?token=" + "x" * 32 + "&b", "a?token=******&b"), ("Bearer " + "t" * 32 + "; x", "Bearer tt******tt; x"), ("x-api-key:" + "q" * 40, "x-api-key:qq******qq"), ("nothing here", "nothing here")])
_cases("f_ckey", lambda x: T.client_group(x, F.lit("h1")), [("sk******zy", "api_key:sk******zy"), ("", "api_key_hash:h1")])
_cases("f_clbl", T.client_label, [("sk******zy", "sk******zy"), (" ", T.UNKNOWN_CLIENT)])
_cases("f_tail", T.path_tail, [("/a/b/usage", "usage"), ("usage", "usage"), ("/a/b/", "b")])
_cases("w_hdr", lambda x: F.array_join(F.array_sort(F.map_keys(T.keep_headers(F.create_map(x, F.array(F.lit("v")), F.lit("X-Trace"), F.array(F.lit("t"))), "x-*, content-type"))), ","), [("X-Api-Key", "X-Trace"), ("Content-Type", "Content-Type,X-Trace"), ("X-Rate", "X-Rate,X-Trace"), ("Cookie", "X-Trace")])
_cases("s_ts", lambda x: F.coalesce(F.unix_micros(N.rfc3339(x)), F.lit(0)), [("2024-01-01T00:00:01Z", 1704067201000000), ("2024-01-01T02:00:00.5+02:00", 1704067200500000), ("no time", 0)])
_cases("f_dayhour", lambda x: F.concat_ws(" ", N.day_key(N.rfc3339(x), N.utc_offset(x)), N.hour_key(N.rfc3339(x), N.utc_offset(x))), [("2024-01-01T00:30:00+08:00", "2024-01-01 00"), ("2024-01-01T23:30:00-05:30", "2024-01-01 23"), ("2024-01-01T12:00:00Z", "2024-01-01 12")])
_cases("g_fmt", lambda x: F.concat_ws(" ", N.compact(x), N.millis_text(x), N.percent_text(x)), [("1234", "1.2k 1.23秒 1234.0%"), ("3400000", "3.4M 3400.00秒 3400000.0%"), ("12.5", "13 13毫秒 12.5%"), ("1000", "1k 1.00秒 1000.0%"), ("-2", "-2 - -2.0%"), ("x", "0 - -")])
QUERIES["f_hash"] = lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", T.hash_key(F.concat(F.lit(" key-"), F.col("user_id").cast("string")), D.SALT).alias("result"))

_add("f_tok1", _over(lambda e: e.select("ingest_seq", "total_tokens")), "SELECT ingest_seq, total_tokens FROM ev")
_add("f_cache", _over(lambda e: e.select("ingest_seq", N.cached_tokens(F.col("cached_tokens"), F.col("cache_tokens")).alias("cached"), N.ingested_cache(F.col("cached_tokens"), F.col("cache_tokens"), F.col("input_tokens")).alias("ingested"))), "SELECT ingest_seq, greatest(cached_tokens, cache_tokens, 0) AS cached, greatest(cached_tokens, cache_tokens + input_tokens) AS ingested FROM ev")
_add("f_ms", _over(lambda e: e.select("ingest_seq", N.millis(F.col("latency_ms") * 999_999 - 5_000_000).alias("ms"), N.non_negative(F.col("latency_ms") - 100).alias("nn"))), "SELECT ingest_seq, trunc((latency_ms * 999999 - 5000000) / 1000000.0)::BIGINT AS ms, greatest(latency_ms - 100, 0) AS nn FROM ev")

# -- records, documents, files -----------------------------------------------------------------


def _pushed(spark: SparkSession, d: str) -> DataFrame:
    """The events as pushed JSON records, every other one in the legacy spelling."""
    e = D.base(spark, d)
    c, k = F.col, F.get_json_object("props", "$.k").cast("long")
    new = c("event_id") % 2 == 0
    time = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    fields = {
        ("provider", "Provider"): F.concat(F.lit(" p"), (c("user_id") % 3).cast("string")), ("model", "Model"): F.concat(F.lit("m"), (c("user_id") % 5).cast("string")), ("alias", "Alias"): F.lit("never"),
        ("api_key", "APIKey"): F.concat(F.lit("sk-key-"), c("user_id").cast("string")), ("auth_index", "AuthIndex"): F.concat(F.lit("auth-"), (c("user_id") % 4).cast("string")), ("requested_at", "RequestedAt"): time,
        ("latency", "Latency"): k * 1_500_000, ("failed", "Failed"): c("event_type") == "error", ("failure", "Failure"): None, ("detail", "Detail"): None}
    failure = {("status_code", "StatusCode"): F.when(c("event_type") == "error", 500).otherwise(0), ("body", "Body"): F.lit("key sk-abcdefgh")}
    detail = {("input_tokens", "InputTokens"): k, ("output_tokens", "OutputTokens"): k * 2, ("cache_read_tokens", "CacheReadTokens"): k * 3, ("cache_creation_tokens", "CacheCreationTokens"): F.lit(1).cast("long")}

    def spelled(i: int) -> Column:
        part = lambda given: F.struct(*(v.alias(n[i]) for n, v in given.items()))
        nested = {"failure": part(failure), "detail": part(detail)}
        return F.to_json(F.struct(*((nested[n[0]] if v is None else v).alias(n[i]) for n, v in fields.items())))

    return e.select(c("event_id"), F.when(new, spelled(0)).otherwise(spelled(1)).alias("value"))


def _ingested(spark: SparkSession, d: str) -> DataFrame:
    pushed = _pushed(spark, d).unionByName(spark.createDataFrame([(-1, "not json"), (-2, "[1]")], "event_id long, value string"))
    return records.normalize(records.decode(pushed), D.clock(spark, d), Settings(), seq=F.col("event_id"))


_INGESTED = "SELECT event_id AS ingest_seq, 'p' || (user_id % 3) || ' · 上游 auth-' || (user_id % 4) AS api, 'm' || (user_id % 5) AS model, ts, 'p' || (user_id % 3) AS source, 'sk******' || right('-' || user_id, 2) AS api_key, trunc(k * 1500000 / 1000000.0)::BIGINT AS latency_ms, k * 3 AS total_tokens, greatest(0, k * 3 + 1) AS cache_tokens, event_type = 'error' AS failed, (CASE WHEN event_type = 'error' THEN 500 ELSE 0 END)::INT AS status_code, 'key sk******gh' AS failure FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"
_INGEST_COLUMNS = ("ingest_seq", "api", "model", "ts", "source", "api_key", "latency_ms", "total_tokens", "cache_tokens", "failed", "status_code", "failure")
QUERIES["s_dec"] = lambda spark, d: _plain_time(_ingested(spark, d).select(*_INGEST_COLUMNS))
ORACLE_SQL["s_dec"] = _INGESTED


def _written(e: DataFrame, write: Callable[[DataFrame, str], None]) -> str:
    path = new_path(e.sparkSession, "written")
    write(e, path)
    return path


def _replayed(spark: SparkSession, d: str) -> DataFrame:
    e = D.usage(spark, d)
    path = _written(_repeated(e), storage.append_lines)
    return storage.replay_lines(spark, path, e.filter("ingest_seq % 2 = 0"), D.clock(spark, d))


_add("s_jsonl", lambda spark, d: A.by_api_model(_replayed(spark, d)), f"SELECT CASE WHEN source = '' THEN provider || CASE WHEN auth_index = '' THEN '' ELSE ' · 上游 ' || auth_index END ELSE api END AS api, model, {D.M8}, {D.LAT} FROM ev WHERE ingest_seq % 2 = 1 OR (source = '' AND auth_index <> '') GROUP BY 1, 2")


def _exported(spark: SparkSession, d: str) -> DataFrame:
    e = D.usage(spark, d)
    path = _written(e, lambda x, p: storage.write_snapshot(x, Settings(), "2024-02-01T00:00:00Z", p))
    return storage.read_snapshot(spark, path)


_add("s_imp", lambda spark, d: _plain_time(_exported(spark, d).select("outer_api", "outer_model", "ts", "total_tokens", "failed", "api_key")), "SELECT api AS outer_api, model AS outer_model, ts, total_tokens, failed, api_key FROM ev")
_add("k_exp", _over(lambda e: storage.snapshot_apis(e).select("api", "total_requests", "success_count", "failure_count", "total_tokens", F.array_join(F.map_keys("models"), ",").alias("models"), F.aggregate(F.map_values("models"), F.lit(0), lambda a, m: a + F.size(m["details"])).alias("details"))),
     f"SELECT api, {D.M4}, string_agg(DISTINCT model, ',' ORDER BY model) AS models, count(*)::INT AS details FROM ev GROUP BY api")
_add("k_csv", _over(lambda e: e.sparkSession.read.option("header", True).option("escape", '"').csv(_written(e.limit(0).unionByName(e), storage.write_csv)).select("model", "source", "result", F.col("total").cast("long").alias("total"), "status")), "SELECT model, CASE WHEN source = '' THEN '-' ELSE source END AS source, CASE WHEN failed THEN 'failed' ELSE 'success' END AS result, total_tokens AS total, status_code::VARCHAR AS status FROM ev")
_add("k_json", _over(lambda e: e.sparkSession.read.text(_written(e, storage.write_json)).select(F.get_json_object("value", "$.model").alias("model"), F.get_json_object("value", "$.tokens.total_tokens").cast("long").alias("total"))), "SELECT model, total_tokens AS total FROM ev")


def _streamed(spark: SparkSession, d: str, settings: Settings) -> str:
    """Records pushed through the streaming path in several micro-batches, some again later, with one from the future and one long past."""
    from .streaming import ingest

    odd = [(-3, '{"provider": "p9", "model": "m9", "requested_at": "2099-01-01T00:00:00Z"}'), (-4, '{"provider": "p9", "model": "m9", "requested_at": "1901-01-01T00:00:00Z"}')]
    pushed = _pushed(spark, d)
    rows = pushed.filter("event_id % 2 = 0").unionByName(spark.createDataFrame(odd, "event_id long, value string"))
    source = _written(rows, lambda x, p: x.select("value").repartition(2).write.text(p))
    pushed.filter("event_id % 2 = 1 OR event_id % 10 = 0").select("value").repartition(2).write.mode("append").text(source)
    stream = ingest.event_stream(ingest.record_stream(spark, source, 1), settings)
    ingest.store(stream, f"{source}-table", f"{source}-checkpoint", settings, once=True).awaitTermination()
    return f"{source}-table"


def _stream_rows(spark: SparkSession, d: str) -> DataFrame:
    from .streaming import ingest

    return ingest.stored(spark, _streamed(spark, d, Settings(retention_days=0)))


def _stream_counts(spark: SparkSession, d: str) -> DataFrame:
    from .streaming import ingest

    table = _streamed(spark, d, Settings(retention_days=36_500))
    order = ingest.stored(spark, table).agg((F.count_distinct("ingest_seq") == F.count("*")).alias("numbered"))
    return ingest.ingested(spark, table).crossJoin(order)  # two single rows


QUERIES["s_rec_stream"] = lambda spark, d: _plain_time(_stream_rows(spark, d).select("api", "model", "ts", "total_tokens", "failed"))
ORACLE_SQL["s_rec_stream"] = f"SELECT api, model, ts, total_tokens, failed FROM ({_INGESTED}) UNION ALL VALUES ('p9', 'm9', TIMESTAMP '2099-01-01', 0, FALSE), ('p9', 'm9', TIMESTAMP '1901-01-01', 0, FALSE)"
QUERIES["t_late"] = _stream_counts
ORACLE_SQL["t_late"] = "SELECT (count(*) + 2)::BIGINT AS rows, 1::BIGINT AS expired, TRUE AS numbered FROM events"


def _counted(spark: SparkSession, d: str) -> DataFrame:
    """Running counts by api and model of the records, kept by a streaming aggregation over several files."""
    from .streaming import ingest

    source = _written(_pushed(spark, d), lambda x, p: x.select("value").repartition(3).write.text(p))
    counts = ingest.running_counts(ingest.event_stream(ingest.record_stream(spark, source, 1), Settings(dedup_window_minutes=0)))
    out = f"{source}-counts"
    ingest.keep_latest(counts, out, f"{source}-checkpoint").awaitTermination()
    return spark.read.parquet(out)


QUERIES["a_inc_stream"] = _counted
ORACLE_SQL["a_inc_stream"] = f"SELECT api, model, {D.M4} FROM ({_INGESTED}) GROUP BY api, model"


def _saved_prices(spark: SparkSession, d: str) -> DataFrame:
    import json

    doc = json.dumps({"updated_at": "2024-01-01T00:00:00Z", "prices": {m: dict(zip(("prompt", "completion", "cache"), p)) for m, p in {**D.PRICED, " ": (1, 1, 1), "free": (-1, 0, 0)}.items()}})
    return P.read(spark, _written(spark.range(1).select(F.lit(doc).alias("value")), lambda x, p: x.write.text(p)))


_add("s_price", _saved_prices, "SELECT * FROM prices", D.PRICE_ROWS)
_add("p_imp", _timed(lambda e, now: _plain_time(R.normalize_import(e.withColumns({"outer_api": F.col("api"), "outer_model": F.col("model"), "model": F.when(F.col("ingest_seq") % 2 == 0, " ").otherwise(F.col("model")), "latency_ms": F.col("latency_ms") - 300, "total_tokens": F.lit(0).cast("long"), "source": F.lit("shop")}), now).select("ingest_seq", "ts", "api", "model", "latency_ms", "total_tokens"))),
     "SELECT ingest_seq, ts, provider || ' · shop' AS api, model, greatest(latency_ms - 300, 0) AS latency_ms, input_tokens + output_tokens + reasoning_tokens AS total_tokens FROM ev")
_add("dashboard_models", _priced(lambda e, p: dashboard.model_costs(e, p)),
     f"SELECT b.*, round({_RATE.replace('count(*) FILTER (NOT failed)', 'success_count').replace('count(*)', 'total_requests')}, 6) AS success_rate, CASE WHEN success_count / total_requests::DOUBLE * 100 >= 95 THEN 'ok' WHEN success_count / total_requests::DOUBLE * 100 >= 80 THEN 'neutral' ELSE 'bad' END AS rate_class, round({D.COST}, 6) AS cost FROM (SELECT model, {D.M8}, {D.LAT} FROM ev GROUP BY model) b LEFT JOIN prices USING (model)", D.PRICE_ROWS)


# -- the log as a whole ------------------------------------------------------------------------


def _log(spark: SparkSession, d: str, **settings) -> tuple[UsageLog, Column]:
    """The pushed records as a log, in two pushes that share a tenth of them."""
    now, log = D.clock(spark, d), UsageLog(spark)
    log.patch(now, price_storage_path=new_path(spark, "prices") + ".json", **settings)
    pushed = _pushed(spark, d)
    log.record(pushed.filter("event_id % 2 = 0 OR event_id % 5 = 0"), now)
    log.record(pushed.filter("event_id % 2 = 1"), now)
    return log, now


_WHOLE = {"retention_days": 0, "max_details_per_model": 1_000_000}


def _restarted(spark: SparkSession, d: str) -> DataFrame:
    """What a new log reads from the lines that another one has appended."""
    path = new_path(spark, "lines")
    _, now = _log(spark, d, storage_enabled=True, storage_path=path, **_WHOLE)
    log = UsageLog(spark)
    log.patch(now, storage_enabled=True, storage_path=path, price_storage_path=path + "-prices.json", **_WHOLE)
    return A.by_api_model(log.rows)


QUERIES["storage_replay"] = _restarted
ORACLE_SQL["storage_replay"] = "SELECT api, model, count(*) AS total_requests, count(*) FILTER (NOT failed) AS success_count, count(*) FILTER (failed) AS failure_count, sum(total_tokens)::BIGINT AS total_tokens, sum(k)::BIGINT AS input_tokens, sum(2 * k)::BIGINT AS output_tokens, sum(cache_tokens)::BIGINT AS cached_tokens, 0::BIGINT AS reasoning_tokens, round(coalesce(avg(latency_ms) FILTER (latency_ms > 0), 0), 6) AS avg_latency_ms FROM (" + _INGESTED.replace("SELECT event_id AS ingest_seq,", "SELECT k, event_id AS ingest_seq,", 1) + ") GROUP BY api, model"


def _kept_prices(spark: SparkSession, d: str) -> DataFrame:
    """Prices that one log has saved, as the next one reads them."""
    path, now = new_path(spark, "prices") + ".json", D.clock(spark, d)
    first, second = UsageLog(spark), UsageLog(spark)
    first.patch(now, price_storage_path=path)
    for model, p in {**D.PRICED, "gone": (1, 2, 3)}.items():
        first.put_price(model, *p)
    first.delete_price("gone")
    second.patch(now, price_storage_path=path)
    return second.prices


_add("k_price", _kept_prices, "SELECT * FROM prices", D.PRICE_ROWS)


def _dumped(spark: SparkSession, d: str) -> DataFrame:
    """The full dump, parsed again: a row for each of its details."""
    log, _ = _log(spark, d, **_WHOLE)
    path = _written(log.dashboard_data("2024-02-01T00:00:00Z"), lambda x, p: x.write.text(p))
    lines = documents.read(spark, path, "struct<timestamp:string,failed:boolean>")
    if lines is None or not lines.filter("wrong").isEmpty():
        raise ValueError("the dump is no document in lines")
    of = lambda kind, *columns: lines.filter(F.col("kind") == kind).select(*columns)
    total = of(documents.HEAD, "doc.failed_requests", "doc.generated_at", F.col("doc.usage.total_requests").alias("total"))
    days = of(documents.TAIL, F.size("doc.usage.requests_by_day").alias("days"))
    apis = of(documents.API, "api", F.map_values("doc.apis")[0]["total_requests"].alias("api_requests"))
    models = of(documents.MODEL, "api", "model", F.map_values("doc.models")[0]["total_tokens"].alias("total_tokens"))
    details = of(documents.ROW, "api", "model").groupBy("api", "model").agg(F.count("*").cast("int").alias("details"))
    groups = models.join(apis, "api").join(details, ["api", "model"], "left").crossJoin(total).crossJoin(days)  # two single rows
    return groups.select("failed_requests", "generated_at", "total", "days", "api", "api_requests", "model", "total_tokens", F.coalesce("details", F.lit(0)).alias("details"))


QUERIES["dashboard_data"] = _dumped
ORACLE_SQL["dashboard_data"] = f"WITH r AS ({_INGESTED}) SELECT (SELECT count(*) FROM r WHERE failed) AS failed_requests, '2024-02-01T00:00:00Z' AS generated_at, (SELECT count(*) FROM r) AS total, (SELECT count(DISTINCT ts::DATE) FROM r)::INT AS days, api, sum(count(*)) OVER (PARTITION BY api)::BIGINT AS api_requests, model, sum(total_tokens)::BIGINT AS total_tokens, count(*)::INT AS details FROM r GROUP BY api, model"


def _last(spark: SparkSession, d: str) -> DataFrame:
    """The last time that was recorded, after retention has removed its row."""
    log, now = _log(spark, d, **_WHOLE)
    log.patch(now + F.expr("INTERVAL 400 DAYS"), retention_days=30)
    health = log.health()
    return spark.createDataFrame([(health["runtime"]["last_recorded_at"], health["total_requests"], health["evicted_total"])], "last_recorded_at string, total_requests long, evicted_total long")


_add("last_recorded", _last, "SELECT strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last_recorded_at, 0::BIGINT AS total_requests, count(*) AS evicted_total FROM ev")


def _from_document(spark: SparkSession, d: str) -> DataFrame:
    e = D.usage(spark, d).withColumn("source", F.lit("shop"))
    path = _written(e, lambda x, p: storage.write_snapshot(x, Settings(), "2024-02-01T00:00:00Z", p))
    return dashboard.summary_of_document(spark, path, P.make(spark, D.PRICED), D.clock(spark, d))["api_models"]


_add("a_full", _from_document, f"SELECT provider || ' · shop' AS api, model, {D.M8}, {D.LAT} FROM ev GROUP BY 1, 2")
_SETS = {"total": "total", "apis": "api", "api_models": "api, model", "sources": "source", "credentials": "auth_index", "days": "day", "hours": "hour"}


def _page_one(spark: SparkSession, d: str) -> DataFrame:
    """Requests and tokens of the first page's result sets, one below the other."""
    sets = dashboard.summary(D.usage(spark, d), P.make(spark, D.PRICED), D.clock(spark, d))
    rows = None
    for name, keys in _SETS.items():
        own = [F.lit("all")] if name == "total" else [F.col(k) for k in keys.split(", ")]
        names = ("requests", "tokens") if name in ("days", "hours") else ("total_requests", "total_tokens")
        part = sets[name].select(F.lit(name).alias("part"), F.concat_ws("/", *own).alias("key"), *(F.col(n).alias(x) for n, x in zip(names, ("requests", "tokens"))))
        rows = part if rows is None else rows.unionByName(part)
    return rows


_add("dashboard_summary", _page_one, " UNION ALL ".join(f"SELECT '{n}' AS part, {k} AS key, count(*) AS requests, sum(total_tokens)::BIGINT AS tokens FROM ev GROUP BY 1, 2" for n, k in {
    "total": "'all'", "apis": "api", "api_models": "api || '/' || model", "sources": f"CASE WHEN source = '' THEN '{T.UNKNOWN_SOURCE}' ELSE source END", "credentials": f"CASE WHEN auth_index = '' THEN '{T.BLANK_CREDENTIAL}' ELSE auth_index END",
    "days": "strftime(ts, '%Y-%m-%d')", "hours": "strftime(ts, '%H')"}.items()))
_add("t_page_past", _timed(lambda e, now: E.page(e, E.Query(offset=10_000_000), now)[0].select("ingest_seq")), "SELECT ingest_seq FROM ev ORDER BY ts DESC LIMIT 50 OFFSET 10000000")
_add("t_detail", _over(lambda e: storage.groups_in_order(storage.ordered_details(e))), "SELECT api, model, TRUE AS in_order, count(*)::INT AS n FROM ev GROUP BY api, model")
_add("g_health", lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", N.health_color((F.col("event_id") % 101 - 1) / 99).alias("color"), N.health_cell(F.col("event_id") % 672, 672)["column"].alias("col"), N.health_cell(F.col("event_id") % 672, 672)["row"].alias("row")),
     """SELECT event_id, CASE WHEN r < 0 THEN '' ELSE 'rgb(' || floor(a + (b - a) * t + 0.5)::INT || ',' || floor(c + (e - c) * t + 0.5)::INT || ',' || floor(f + (g - f) * t + 0.5)::INT || ')' END AS color,
       96 - (671 - event_id % 672) // 7 AS col, 7 - (671 - event_id % 672) % 7 AS row
FROM (SELECT event_id, r, CASE WHEN r < 0.5 THEN r * 2 ELSE (r - 0.5) * 2 END AS t, CASE WHEN r < 0.5 THEN 239 ELSE 250 END AS a, CASE WHEN r < 0.5 THEN 250 ELSE 34 END AS b,
  CASE WHEN r < 0.5 THEN 68 ELSE 204 END AS c, CASE WHEN r < 0.5 THEN 204 ELSE 197 END AS e, CASE WHEN r < 0.5 THEN 68 ELSE 21 END AS f, CASE WHEN r < 0.5 THEN 21 ELSE 94 END AS g
  FROM (SELECT event_id, (event_id % 101 - 1) / 99.0::DOUBLE AS r FROM events))""")
_cases("g_label", lambda x: F.concat_ws(" / ", T.friendly_api(x), T.source_key(x, F.lit("codex"))), [("harbour · lane 3", "harbour · lane 3 / harbour · lane 3"), (f"harbour · key · {_HEX}", "harbour / harbour"), ("", f"{T.UNKNOWN_API} / codex"), ("sk-77q2zz · harbour", "harbour / codex"), ("codex · 凭证 x9", "codex / codex · 凭证 x9")])
_cases("g_esc", T.escaped, [("<a b='c'>", "&lt;a b=&#39;c&#39;&gt;"), ('x & "y"', "x &amp; &quot;y&quot;"), ("plain", "plain")])

# rules of secrets and names over texts made of the table, with the rule itself in SQL
_MADE = "['sk-', 'AIza', 'hf_', 'shop', 'a b ', ' x.', ''][(event_id % 7 + 1)::INT] || left(md5(event_id::VARCHAR) || md5(user_id::VARCHAR) || md5(event_id::VARCHAR), (event_id % 97)::INT)"


def _made() -> Column:
    first = F.element_at(F.array(*(F.lit(x) for x in ("sk-", "AIza", "hf_", "shop", "a b ", " x.", ""))), (F.col("event_id") % 7 + 1).cast("int"))
    id_, user = F.md5(F.col("event_id").cast("string")), F.md5(F.col("user_id").cast("string"))
    return F.concat(first, F.left(F.concat(id_, user, id_), (F.col("event_id") % 97).cast("int")))


def _over_made(name: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str]) -> None:
    """columns is called when the query is: there may be no session yet when this module is imported."""
    QUERIES[name] = lambda spark, d: spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", _made().alias("x")).select("event_id", *(c.alias(n) for n, c in columns().items()))
    ORACLE_SQL[name] = "SELECT event_id, " + ", ".join(f"{c} AS {n}" for n, c in sql.items()) + f" FROM (SELECT event_id, user_id, trim(x) AS s, x FROM (SELECT *, {_MADE} AS x FROM events))"


_SECRET = "(regexp_matches({0}, '^(sk-|AIza|hf_|pk_|rk_)') OR (strlen({0}) >= 40 AND NOT regexp_matches({0}, '[ /._-]')) OR (strlen({0}) >= 80 AND NOT contains({0}, ' ')))"
_ID = "(regexp_matches({0}, '^[0-9a-fA-F]{{8,}}$') OR (strlen({0}) >= 32 AND NOT regexp_matches({0}, '[ /._-]')))"
_over_made("f_secret_made", lambda: {"secret": T.looks_secret(F.col("x")), "id": T.looks_credential_id(F.col("x")), "token": T.looks_secret_token(F.col("x")), "mask": T.mask_key(F.col("x"))}, {
    "secret": _SECRET.format("s"), "id": _ID.format("s"), "token": "(strlen(s) >= 8 AND (regexp_matches(s, '^(sk-|AIza|hf_|pk_|rk_)') OR (strlen(s) >= 32 AND NOT contains(s, ' '))))",
    "mask": "CASE WHEN s = '' THEN '' WHEN strlen(s) <= 4 THEN left(s, 1) || '******' ELSE left(s, 2) || '******' || right(s, 2) END"})
_NAMED = lambda x: F.concat(F.lit("team "), (F.col("user_id") % 9).cast("string"), F.lit(" · "), F.trim(x))
_over_made("f_strip_made", lambda: {"stripped": T.strip_credential(_NAMED(F.col("x"))), "source": T.source_label(F.col("x"), F.lit("codex"), F.lit("")), "api": T.group_key(F.lit("codex"), F.lit(""), F.concat(F.lit("s"), (F.col("user_id") % 9).cast("string")), F.lit(""), F.trim(F.col("x")), F.lit(""))}, {
    "stripped": f"CASE WHEN {_ID.format('s')} OR {_SECRET.format('s')} THEN 'team ' || user_id % 9 ELSE trim('team ' || user_id % 9 || ' · ' || s) END",
    "source": f"CASE WHEN s = '' OR {_SECRET.format('s')} THEN 'codex' ELSE s END", "api": "'codex · s' || user_id % 9"})
_over_made("f_redact_made", lambda: {"result": T.redact(F.concat(F.lit("ask "), F.regexp_replace("x", "^(sk-|AIza|hf_)", ""), F.lit(" with pk_"), F.left(F.md5(F.col("event_id").cast("string")), (F.col("event_id") % 30).cast("int")), F.lit(" end")))}, {
    "result": "'ask ' || regexp_replace(x, '^(sk-|AIza|hf_)', '') || ' with ' || CASE WHEN event_id % 30 < 2 THEN '******' ELSE 'pk******' || right(left(md5(event_id::VARCHAR), (event_id % 30)::INT), 2) END || ' end'"})
