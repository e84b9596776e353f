"""Literal cases of the text functions; each list is one Spark job."""

import hashlib

import pytest
from pyspark.sql import functions as F

from meterlake.functions import numbers as N
from meterlake.functions import text as T


def apply(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", f(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows)]


CASES = {
    "mask": (T.mask_key, {"sk-shop-07-front-qx": "sk******qx", None: "", "  ": "", "abcd": "a******", "abcde": "ab******de"}),
    "strip": (T.strip_credential, {
        "openai-compatible-harbour · apikey · 0fe1d2c3b4a59687": "openai-compatible-harbour", "openai-compatibility:harbour:77aa88bb99cc": "openai-compatibility:harbour",
        "harbour - sk-77q2zz": "harbour", "harbour | sk-77q2zz": "harbour", "harbour - apikey - tail7": "harbour", "plain": "plain", None: "", "key · x": "key · x", "a:b:c": "a:b:c"}),
    "identity": (T.credential_identity, {"x · api_key · me": "me", "x:auth:y:z": "y:z", "a/deadbeef00": "deadbeef00", "a/b": "", None: ""}),
    "redact": (T.redact, {
        "Authorization: Bearer sk-q7w8e9r0t1y2": "Authorization: Bearer sk******y2", None: "", "sk-1 hf_abc pk_abcdef": "****** hf******bc pk******ef",
        "api_key=" + "z" * 40: "api_key=******", "token = " + "a" * 40: "token = " + "a" * 40, "first\nAuthorization: " + "q" * 33 + ",x": "first\nAuthorization: qq******qq,x"}),
    "source": (lambda x: T.source_label(x, F.lit(""), F.lit("")), {"sk-secret": "unknown", "shop": "shop", None: "unknown"}),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    f, cases = CASES[name]
    assert apply(spark, f, list(cases)) == list(cases.values())


def test_redaction_leaves_no_key(spark):
    texts = ["Bearer " + "t" * 40, "x-api-key:" + "k" * 40, "?key=sk-harbour7788&a", "AIzaQw90rtyu7788 and rk_dock_5566778899"]
    for text, out in zip(texts, apply(spark, T.redact, texts)):
        for secret in ("t" * 40, "k" * 40, "harbour7788", "Qw90rtyu7788", "dock_5566778899"):
            assert secret not in out, (text, out)


def test_strict_redaction_needs_its_blanks(spark):
    text = "x-api-key:" + "k" * 40
    assert apply(spark, lambda x: T.redact(x, strict=True), [text]) == [text]


def test_hash_is_salted_sha224(spark):
    assert apply(spark, lambda x: T.hash_key(x, "s"), [" key ", "", None]) == [hashlib.sha224(b"s:key").hexdigest(), "", ""]


def test_group_keys(spark):
    key = lambda p, e, s, b, i, a: spark.range(1).select(T.group_key(*(F.lit(x) for x in (p, e, s, b, i, a))).alias("k")).first()["k"]
    assert key("codex", "", "codex", "", "lane-4", "") == "codex · 上游 lane-4"
    assert key("codex", "", "sk-77q2zz88", "", "lane-4", "") == "codex · 上游 lane-4"
    assert key("codex", "", "x", "https://gate.example.org/v2", "", "") == "codex · https://gate.example.org/v2"
    assert key("openai-compatible-a", "", "public", "https://b", "i", "") == "openai-compatible-a · public"
    assert key("", "", "", "", "", "") == "未知接口"
    assert key("", "runner", "shop · key · abc", "", "", "") == "runner · shop"
    assert key("codex", "", "", "", "", "x · key · sk-0123456789") == "codex · 上游 sk******89"


def test_headers(spark):
    headers = F.create_map(*(F.lit(x) if i % 2 == 0 else F.array(F.lit(x)) for i, x in enumerate(["X-Rate", "1", "Set-Cookie", "2", "Authorization", "3", "Date", "4"])))
    keep = lambda rules: spark.range(1).select(T.keep_headers(headers, rules).alias("h")).first()["h"]
    assert keep("") is None and keep("missing") is None
    assert keep("*") == {"X-Rate": ["1"], "Date": ["4"]}
    assert keep(" x-* , nothing") == {"X-Rate": ["1"]}
    assert keep("date,authorization") == {"Date": ["4"]}
    assert T.header_rules_text(T.header_rules("b, *, A-*")) == "*,a-*,b"


def test_long_text_is_cut_on_a_character(spark):
    out = apply(spark, T.cut_long, ["é" * 300, "a" + "é" * 300, "😀" * 200, " short "])
    assert out == ["é" * 250 + "...", "a" + "é" * 249 + "...", "😀" * 125 + "...", "short"]


def test_numbers(spark):
    one = lambda x: spark.range(1).select(x.alias("x")).first()["x"]
    long = lambda *v: [F.lit(x).cast("long") for x in v]
    assert one(N.total_tokens(*long(0, 11, 7, 0))) == 18
    assert one(N.total_tokens(*long(-5, 1, 1, 1))) == 0
    assert one(N.cached_tokens(*long(-1, 4))) == 4
    assert one(N.millis(F.lit(-1_999_999))) == -1
    assert one(N.cost(*long(1_000_000, 500_000, 200_000, 100_000), *(F.lit(x) for x in (30.0, 60.0, 15.0)))) == pytest.approx(63)
    assert one(N.cost(*long(1_000_000, 1_000_000, 100_000, 1_000_000), *(F.lit(x) for x in (10.0, 20.0, 1.0)))) == pytest.approx(49.1)
    assert one(N.success_rate(*long(0, 0))) == 100.0


def test_labels_and_formats(spark):
    assert apply(spark, T.friendly_api, ["harbour · lane 3", "harbour · key · x", "", "sk-77q2zz · harbour", "codex · auth x9", None]) == ["harbour · lane 3", "harbour", "未知接口", "harbour", "codex", "未知接口"]
    assert apply(spark, lambda x: T.source_key(x, F.lit("sk-77q2zz")), ["shop", "sk-1", None]) == ["shop", "未知来源", "未知来源"]
    assert apply(spark, T.escaped, ["<&>\"'", None]) == ["&lt;&amp;&gt;&quot;&#39;", ""]
    assert apply(spark, N.compact, ["1000", "1250000", "999", "nan", None]) == ["1k", "1.3M", "999", "0", "0"]
    assert apply(spark, N.percent_text, ["12.34", "x"]) == ["12.3%", "-"] and apply(spark, N.millis_text, ["1500", "0", "-3", "999.5"]) == ["1.50秒", "-", "-", "1000毫秒"]
    assert apply(spark, lambda x: N.health_color(x.cast("double")), ["-1", "0", "0.5", "1"]) == ["", "rgb(239,68,68)", "rgb(250,204,21)", "rgb(34,197,94)"]
