"""Piece codec and language identification against full searches and sums over all segmentations."""

import copy
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import language_id as L
from meterlake.llm import piece_codec as P
from meterlake.llm.vocabulary import SPACE, Vocabulary


@pytest.fixture(scope="module")
def public():
    return Vocabulary.load()


def small(pieces, scores=None, spread=False):
    v = Vocabulary([*pieces, *[""] * 256], [*(scores or [-float(i + 1) for i in range(len(pieces))]), *[0.0] * 256], [len(pieces) + b for b in range(256)])
    return v


def full_search(v, text):
    """Score of the best segmentation, over the whole text at once."""
    best = [0.0] + [-math.inf] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - v.longest), end):
            i = v.ids.get(text[start:end])
            if i is not None:
                best[end] = max(best[end], best[start] + v.scores[i])
        if text[end - 1] not in v.ids:
            best[end] = max(best[end], best[end - 1] + v.unknown_score)
    return best[-1]


def score(v, ids):
    """Of a text without characters that the vocabulary lacks."""
    return sum(v.scores[i] for i in ids)


def test_streaming_finds_the_best_score_and_bounds_its_window():
    rng = random.Random(3)
    pieces = sorted({"".join(rng.choice("abc" + SPACE) for _ in range(rng.randint(2, 6))) for _ in range(60)}) + ["a", "b", "c", SPACE]
    v = small(pieces, [-rng.random() * 9 for _ in pieces])
    assert v.cut_pattern == r"(?s:.+)"
    e, d = P.Encoder(v), P.Decoder(v)
    for n in (1, 2, 5, 17, 60, 400, 3000):
        text = "".join(rng.choice("abc ") for _ in range(n))
        parts = list(e.stream((" " + text).replace(" ", SPACE)))
        ids = [i for p in parts for i in p]
        assert score(v, ids) == pytest.approx(full_search(v, (" " + text).replace(" ", SPACE)))
        assert d.decode(ids) == text
        assert n < 400 or len(parts) > 3  # committed on the way


def test_public_vocabulary_round_trip_and_best_score(public, odd_texts):
    e, d = P.Encoder(public), P.Decoder(public)
    assert public.longest == 16 and len(public.byte_ids) == 256
    for t in [t or "" for t in odd_texts] + ["Äußerst schön — naïve œuvre", " lead", "tail ", "tabs\tand\nlines", "▁", "▁▁ x▁", "\U0010ffff", "x" * 70, "word" * 40]:
        ids = memoryview(e.encode(t)).cast("i").tolist()
        assert d.decode(ids) == t
        if t and SPACE not in t and all(c in public.ids or c == " " for c in t):
            assert score(public, ids) == pytest.approx(full_search(public, (" " + t).replace(" ", SPACE)))
    assert e.encode("") == b""


def test_memory_is_bounded(public, monkeypatch):
    monkeypatch.setattr(P, "MEMORY_WORDS", 10)
    e, d = P.Encoder(public), P.Decoder(public)
    text = " ".join(f"w{i}" for i in range(100))
    assert d.decode(memoryview(e.encode(text)).cast("i")) == text and len(e.memory) + len(e.before) <= 10


def test_documents_go_to_ids_and_back(spark, documents, odd_texts):
    docs = documents(odd_texts)
    ids = P.encode_documents(docs, keep=("doc_id", "n"))
    assert ids.columns == ["doc_id", "n", "ids", "round_trip"] and ids.filter("round_trip").count() == len(odd_texts)
    back = {r["doc_id"]: r["text"] for r in P.decode_documents(ids).collect()}
    assert back == {i: t or "" for i, t in enumerate(odd_texts)}
    assert P.encode_documents(docs.filter("false")).count() == 0


def test_names_that_are_taken_and_repeated_rows(spark, documents):
    docs = documents(["some words"]).withColumnRenamed("n", "ids").withColumnRenamed("score", "round_trip")
    out = P.encode_documents(docs.union(docs), keep=("doc_id", "ids", "round_trip"))
    assert out.columns == ["doc_id", "ids", "round_trip", "_ids", "_round_trip"]
    assert [(r["ids"], r["round_trip"], r["_round_trip"]) for r in out.collect()] == [(2, "x", True)] * 2
    back = P.decode_documents(out.withColumnRenamed("round_trip", "text"), "_ids", ("doc_id", "text"))
    assert [r["_text"] for r in back.collect()] == ["some words"] * 2


def test_vocabularies_that_differ_in_bytes_have_their_own_codec(public):
    other = copy.copy(public)
    other.byte_ids = list(reversed(public.byte_ids))
    assert P.codec(public) is P.codec(public) and P.codec(other) is not P.codec(public)


def segmentations(word):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        for rest in segmentations(word[k:]):
            yield [word[:k], *rest]


def brute(v, p, word):
    total = np.zeros(p.shape[1])
    for parts in segmentations(word):
        if all(x in v.ids or len(x) == 1 for x in parts):
            total += np.prod([p[v.ids.get(x, len(v.pieces))] for x in parts], axis=0)
    return total


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(5)
    v = small([SPACE, SPACE + "a", "a", "ab", "b", "abc", "bc", "ca", SPACE + "ab"])
    p = rng.random((len(v.pieces) + 1, 3)) / 4
    s = L.Scorer(v, ["x", "y", "z"], p)
    for word in ("a", "abc", "abcabca", "qab", "zz", "cabbca"):
        want = np.log(brute(v, p, SPACE + word))
        assert np.allclose(L.Lattice([SPACE + word], v).forward(p)[-1][0], np.exp(want))
        assert np.allclose(s.long_word(word), want)
    total = s.texts(["abc, abc! zz", None, "123", "ABC"])
    assert np.allclose(total[0], 2 * np.log(brute(v, p, SPACE + "abc")) + np.log(brute(v, p, SPACE + "zz")))
    assert total[1] is None and total[2] is None and np.allclose(total[3], np.log(brute(v, p, SPACE + "abc")))


def test_expected_counts_equal_brute_force():
    rng = np.random.default_rng(6)
    v = small([SPACE, "a", "ab", "b", SPACE + "a", "ba"])
    p = rng.random(len(v.pieces) + 1)
    into = np.zeros(len(v.pieces) + 1)
    L.Lattice([SPACE + "abab", SPACE + "baqb"], v).expected(p, np.array([2.0, 3.0]), into)
    want = np.zeros_like(into)
    for word, n in ((SPACE + "abab", 2), (SPACE + "baqb", 3)):
        each = [(parts, np.prod([p[v.ids.get(x, len(v.pieces))] for x in parts])) for parts in segmentations(word) if all(x in v.ids or len(x) == 1 and x not in v.ids for x in parts)]
        z = sum(w for _, w in each)
        for parts, w in each:
            for x in parts:
                want[v.ids.get(x, len(v.pieces))] += n * w / z
    assert np.allclose(into, want)


def test_long_words_do_not_underflow(public):
    p = np.full((len(public.pieces) + 1, 2), 1e-5)
    assert np.isfinite(L.Scorer(public, ["a", "b"], p).long_word("ab" * 5000)).all()


def test_languages_of_held_out_documents(spark):
    out = L.op10_language_id(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = out.select(F.count_if(F.col("lang_pred") == F.col("lang")), F.count("*")).first()
    assert n > 30 and right / n > 0.95


def test_odd_texts_and_no_training(spark, documents, odd_texts, public):
    docs = documents(odd_texts)
    model = L.fit(docs, public)
    rows = {r["doc_id"]: r for r in L.identify(docs, model, public).collect()}
    assert model[0] == ["en"] and len(rows) == len(odd_texts)
    for i, t in enumerate(odd_texts):
        blank = not any(c.isalpha() for c in t or "")
        assert rows[i]["lang_pred"] == ("und" if blank else "en") and 0 <= rows[i]["score"] <= 1
    untaught = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in L.identify(untaught, L.fit(untaught, public), public).collect()} == {"und"}
    assert L.identify(docs.filter("false"), model, public).count() == 0


def test_long_runs_teach_as_short_ones_do(spark, public):
    rng = np.random.default_rng(5)
    p = rng.random(len(public.pieces) + 1) + 1e-3
    p /= p.sum()
    for word in ("abab", "strength日x", "running" * 3):
        want, got = np.zeros(len(p)), np.zeros(len(p))
        L.Lattice([SPACE + word], public).expected(p, np.array([3.0]), want)
        L.expected_long(SPACE + word, public, p, 3, got)
        assert np.allclose(want, got)
    rows = [(i, x, {"aa": "thequickbrownfox" * 500, "bb": "einzweidreivierzug" * 500}[x]) for x in ("aa", "bb") for i in range(*((0, 40) if x == "aa" else (40, 80)))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = L.fit(docs, public)
    assert model[0] == ["aa", "bb"] and {(r["lang"], r["lang_pred"]) for r in docs.join(L.identify(docs, model, public), "doc_id").collect()} == {("aa", "aa"), ("bb", "bb")}


def test_numerals_are_no_letters(spark, public):
    assert L.words_of("½ ② ² Ⅷ 12") == [] and L.words_of("a½b Ⅷx É٣ª") == ["a", "b", "x", "é", "ª"] and L.words_of("日本 ǅ ʰ") == ["日本", "ǆ", "ʰ"]
    docs = spark.createDataFrame([(None, "½ ② ² Ⅷ", "en"), (None, "some words", "en"), (1, "some words", "en"), (2, "other words", "en"), (3, "12 34", None)], "doc_id long, text string, lang string")
    got = [(r["doc_id"], r["lang_pred"]) for r in L.identify(docs, L.fit(docs, public), public).collect()]
    assert got == [(None, "und"), (None, "en"), (1, "en"), (2, "en"), (3, "und")]


def test_languages_without_spaces(spark, public):
    rng = random.Random(8)
    letters = {"xa": "あいうえおかきくけこさしすせそ", "xb": "กขคงจฉชซญดตถทธน"}
    rows = [(k, x, "".join(rng.choice(letters[x]) for _ in range(n))) for k, (x, n) in enumerate((x, n) for x in letters for n in [40, 45, 700, 5000] * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    out = docs.join(L.identify(docs, L.fit(docs, public), public), "doc_id").collect()
    assert all(r["lang"] == r["lang_pred"] for r in out) and len(out) == 48
