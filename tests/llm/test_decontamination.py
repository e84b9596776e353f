"""Leaks against a plain semi-global edit distance."""

import random

import numpy as np
import pytest

from meterlake.llm import decontamination as D


def plain_distances(patterns, text):
    """Fewest edits of each of some patterns of one length against any part of text."""
    patterns = np.array(patterns)
    row = np.zeros((len(text) + 1, len(patterns)), int)
    for c in patterns.T:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        for j, t in enumerate(text, 1):
            new[j] = np.minimum(np.minimum(row[j], new[j - 1]) + 1, row[j - 1] + (c != t))
        row = new
    return row.min(axis=0)


def form(text):
    return D.normal(text)[0].tolist()


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def edited(rng, text, n):
    z = list(text)
    for _ in range(n):
        j = rng.randrange(len(z))
        z[j : j + 1] = rng.choice(["", "q", z[j] + "w"])
    return "".join(z)


def test_normal_form_and_places():
    points, at = D.normal("  Ab,\n c—É2 ")
    assert "".join(map(chr, points)) == "ab c é2 " and [("  Ab,\n c—É2 ")[i] for i in at[:2]] == ["A", "b"]
    assert len(D.normal(None)[0]) == len(D.normal("")[0]) == 0 and "".join(map(chr, D.normal("İx")[0])) == "İx"


def test_qgrams_tell_texts_apart():
    a = np.array([ord(c) for c in "abcdefghijklmnopqrst"], np.uint32)
    for q in (1, 2, 3, 7, 10, 13):
        codes = D.qgrams(a, q)
        assert len(codes) == 21 - q and len(set(codes.tolist())) == len(codes)
        assert (D.qgrams(a[3:], q) == codes[3:]).all()


def test_search_equals_brute_force():
    rng = random.Random(7)
    items = [(i, prose(rng, 14)) for i in range(6)] + [(6, "tiny"), (7, prose(rng, 6)), (8, "")]
    index = D.Index.build(items)
    texts = []
    for k in range(60):
        i, item = rng.choice(items[:6])
        part = item if k % 3 else item[: rng.randint(40, 80)]
        texts.append(prose(rng, rng.choice([0, 3, 30])) + " " + edited(rng, part, rng.choice([0, 1, 2, 3, 5, 8])) + " " + prose(rng, rng.choice([0, 4, 30])))
    got = set((k, w) for k, w, *_ in index.search(texts))
    for k, t in enumerate(texts):
        f = form(t)
        for item in range(9):
            windows = [x for x, o in zip(index.texts, index.items) if o == item]
            near = bool(windows) and bool((plain_distances(windows, f) <= D.budget(len(windows[0]))).any())
            assert ((k, item) in got) == near, (k, item)


def test_extents_are_in_the_text():
    item = "the quick brown fox jumps over the lazy dog and then it runs away from all the others"
    text = "Xyz!! THE quick, brown   fox jumps over the lazy dog; and then it runs away from all the others. End"
    found = list(D.Index.build([(1, item)]).search(["nothing", text, None, ""]))
    assert {f[:2] for f in found} == {(1, 1)}
    assert text[min(f[2] for f in found) : max(f[3] for f in found)] == text[6:-5] and all(f[4] == 0 for f in found)


def test_documents(spark, documents, odd_texts, monkeypatch):
    rng = random.Random(8)
    items = [(i, prose(rng, 16)) for i in range(5)] + [(5, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = list(odd_texts) + [prose(rng, 50) for _ in range(10)] + [prose(rng, 20) + " " + x.upper() + prose(rng, 20) for _, x in items[:5]]
    docs = documents(texts)
    want = {(len(texts) - 5 + i, i) for i in range(5)}
    assert {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, benchmark).collect()} == want
    monkeypatch.setattr(D, "BLOCK_CHARS", 100)  # several passes find the same
    assert {(r["doc_id"], r["item_id"]) for r in D.leaks(docs, benchmark).collect()} == want
    clean = D.without_leaks(docs, benchmark)
    assert clean.schema == docs.schema and {r["doc_id"] for r in clean.collect()} == set(range(len(texts) - 5))
    assert D.leaks(docs, benchmark.filter("false")).count() == 0 and D.leaks(docs.filter("false"), benchmark).count() == 0
    assert D.without_leaks(docs, benchmark.filter("false")).count() == len(texts)


@pytest.mark.parametrize("cut", [0, 1, 2, 3])
def test_leaks_at_the_ends_of_a_text(cut):
    item = "several words that stand in one line and are long enough to be a window"
    index = D.Index.build([(1, item)], window=64)
    assert {f[1] for f in index.search(["before that", item[cut:], "after", item[: len(item) - cut]])} == {1}


def test_runs_of_a_window_count_wherever_they_start():
    rng = random.Random(12)
    item = prose(rng, 50)[:200].strip()
    index = D.Index.build([(4, item)])
    runs = [(a, n) for n in (64, 70, 88, 95) for a in range(0, len(item) - n + 1)]
    runs = [(a, n) for a, n in runs if item[a] != " " != item[a + n - 1]]
    texts = ["1 2 3 4 5 6 7 8 9 " + item[a : a + n] + " 9 8 7 6 5 4 3 2 1" for a, n in runs]
    assert {f[0] for f in index.search(texts)} == set(range(len(texts)))
    assert not list(index.search([item[40:96], item[100:158]]))


def test_a_huge_text_and_many_items():
    items = [(i, f"item{i:06d}") for i in range(100_000)]  # windows x diagonals x characters exceed 2**63
    found = list(D.Index.build(items, edits=1).search(["x" * 10_000_000 + " item099999"]))
    assert found == [(0, 99_999, 10_000_001, 10_000_011, 0)]


def test_items_without_an_id(spark, documents):
    item = prose(random.Random(3), 16)
    docs, benchmark = documents(["other words", "so " + item]), spark.createDataFrame([(None, item)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in D.leaks(docs, benchmark).collect()] == [(1, None)]
    assert [r["doc_id"] for r in D.without_leaks(docs, benchmark).collect()] == [0]


def test_repetitive_items_and_texts_in_bounded_slices(monkeypatch):
    rng = random.Random(4)
    items = [(0, "a" * 300), (1, "ab" * 90), (2, "abcab " * 30), (3, prose(rng, 30)), (4, "a" * 70 + prose(rng, 12) + "a" * 70), (5, "b" * 30)]
    texts = ["a" * 500, "ab" * 100 + "a" * 90, prose(rng, 40), "abcab " * 60 + items[3][1], "b" * 90 + "c" + "b" * 29, items[4][1] + "x" + items[4][1][20:], "a" * 63, "c" * 90]
    index = D.Index.build(items)
    sliced = list(index.search(texts))
    monkeypatch.setattr(D, "PAIRS", 50)
    monkeypatch.setattr(D, "TOGETHER", 64)
    assert list(index.search(texts)) == sliced
    monkeypatch.setattr(D, "PAIRS", 1 << 40)
    monkeypatch.setattr(D._Texts, "inside", lambda self, text, *_: np.zeros(len(text), bool))  # every window is aligned
    assert list(index.search(texts)) == sliced
    for k, t in enumerate(texts):
        for i, _ in items:
            windows = [w for w, o in zip(index.texts, index.items) if o == i]
            near = bool((plain_distances(windows, form(t)) <= D.budget(len(windows[0]))).any())
            assert any(f[:2] == (k, i) for f in sliced) == near, (k, i)


def test_memory_of_a_long_run_is_bounded():
    import tracemalloc

    index = D.Index.build([(1, "a" * 300)])
    tracemalloc.start()
    assert list(index.search(["a" * 30_000])) == [(0, 1, 0, 30_000, 0)]
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_long_texts_are_looked_up_in_pieces(monkeypatch):
    rng = random.Random(5)
    item = prose(rng, 16)
    texts = [prose(rng, 60) + " " + item + " " + prose(rng, k) for k in range(0, 90, 9)]
    want = list(D.Index.build([(1, item)]).search(texts))
    monkeypatch.setattr(D, "CHUNK", 37)
    assert [(f[0], f[2:]) for f in D.Index.build([(1, item)]).search(texts)] == [(f[0], f[2:]) for f in want] and len(want) == len(texts)


def test_a_sieve_lets_every_region_pass(monkeypatch):
    rng = random.Random(6)
    items = [(i, prose(rng, 20)) for i in range(30)] + [(30, "short item here"), (31, "tiny")]
    texts = [prose(rng, 40) + " " + edited(rng, t[a : a + n], e) + " " + prose(rng, 40) for _, t in items[:30] for a, n, e in ((0, 64, 0), (9, 66, 3), (3, 90, 3))]
    texts += ["so " + prose(rng, 9) + " short item here " + prose(rng, 9)] + [prose(rng, 200) for _ in range(100)] + [None, "", "ab"]
    sieve = D.Sieve.build(iter(items), sum(len(t) for _, t in items), D.WINDOW, D.EDITS)
    leaky = {f[0] for f in D.Index.build(items).search(texts)}
    for chunk in (1 << 20, 50):
        monkeypatch.setattr(D, "CHUNK", chunk)
        passed = {k for k, t in enumerate(texts) if sieve.passes(t)}
        assert leaky <= passed and len(passed - leaky) < 5 and len(leaky) > 85
