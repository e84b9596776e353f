"""Shingles, tables, components and groups against brute force."""

import random
import re

import numpy as np
import pytest

from meterlake.llm import near_duplicates as M
from meterlake.llm.components import components
from meterlake.llm.shingles import Tensored, fingerprint, shingles

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return set() if not words else {tuple(words)} if len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def plain_components(texts, n, percent):
    sets = [plain_set(t, n) for t in texts]
    top = list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_shingle_sets(odd_texts):
    for n in (1, 3, 5):
        for t in [*odd_texts, "A b C d E f a B c", "x\x0by\x0cz\x1cq", "one two"]:
            assert len(shingles(t, n)) == len(plain_set(t, n))
    assert (shingles("A b\nC", 3) == shingles("a  B c", 3)).all()
    assert fingerprint(shingles("a b", 3)) != fingerprint(shingles("b a", 3))
    assert fingerprint(shingles("É a b", 3)) != fingerprint(shingles("é a b", 3))


def test_tables_find_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    tensored = Tensored(M.COLLECTION, M.GROUP)
    assert len(tensored.multiply) == 72
    found = 0
    for _ in range(300):  # similarity 0.85
        both, a, b = rng.integers(0, 2**63, 170, dtype=np.uint64), *rng.integers(0, 2**63, (2, 15), dtype=np.uint64)
        x, y = (tensored.signature(np.unique(np.concatenate([both, z])))[0] for z in (a, b))
        found += bool((x[0] == y[0]).any() and (x[1] == y[1]).any())
    assert found == 300


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_groups_equal_brute_force(spark, documents, odd_texts, n, percent):
    rng = random.Random(9)
    prose = lambda k: " ".join(f"v{rng.randrange(400)}" for _ in range(k))
    texts = list(odd_texts) + [prose(60) for _ in range(20)]
    texts += family(rng, prose(120), 40, 9) + family(rng, prose(40), 20, 2) + [prose(30)] * 12
    passage = prose(60)
    texts += [prose(40) + " " + passage + " " + prose(40) for _ in range(25)]
    chain = prose(100).split()  # neighbours are linked, the ends are not
    texts += [" ".join(chain[k : k + 80]) for k in range(0, 20, 2)]
    rng.shuffle(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in M.near_duplicates(documents(texts), words=n, percent=percent).collect()}
    assert [got[i] for i in range(len(texts))] == plain_components(texts, n, percent)


def test_blocks_of_a_family_lose_no_link(spark, documents, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_CLASSES", 8)
    monkeypatch.setattr(M, "CHUNK", 16)
    rng = random.Random(2)
    texts = family(rng, " ".join(f"u{i}" for i in range(150)), 60, 12)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in M.near_duplicates(documents(texts), words=3, percent=85).collect()}
    assert [got[i] for i in range(60)] == plain_components(texts, 3, 85)


def test_repeated_rows_and_empty_tables(spark, documents):
    docs = documents(["a b c d e f", "a b c d e f", None])
    got = sorted(map(tuple, M.near_duplicates(docs.union(docs)).collect()))
    assert got == sorted([(0, 2, 0, True), (1, 2, 0, False), (2, 0, 2, True)] * 2)
    assert M.near_duplicates(docs.filter("false")).count() == 0
    assert M.keep_one(spark, docs, "").columns == ["doc_id", *[c for c in docs.columns if c != "doc_id"]]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(40)] + [(300, 300 + i) for i in range(30)]
    top = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: v for k, v in top.items() if k in got} and all(top[k] == k for k in top if k not in got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_tables_suffice_at_any_threshold(documents, monkeypatch):
    assert M.groups_for(85) == M.COLLECTION == 12 and M.groups_for(80) == 16 and M.groups_for(100) == 1
    assert all(2 * (1 - (p / 100) ** g) ** M.groups_for(p, g) <= M.ESCAPE for p in range(50, 100) for g in (3, 4))
    made = []
    monkeypatch.setattr(M, "Tensored", lambda *a: made.append(a) or Tensored(*a))
    M.near_duplicates(documents(["a b"]))
    M.near_duplicates(documents(["a b"]), words=3, percent=85)
    assert made == [(16, 3), (12, 3)]


def test_null_and_repeated_keys_lose_no_text(spark):
    rng = random.Random(6)
    a, b, c, d = (" ".join(f"k{rng.randrange(10**6)}" for _ in range(100)) for _ in range(4))
    near = lambda t: t + " end"
    rows = [(None, a), (None, near(a)), (None, b), (3, near(b)), (5, c), (7, near(c)), (7, d), (9, near(d)), (None, None), (None, "one more text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in M.near_duplicates(docs).collect()}
    assert {x for x in got if x[0] is not None} == {(3, 97, 3, True), (5, 96, 5, True), (7, 97, 5, False), (7, 96, 7, True), (9, 97, 7, False)}
    out = [tuple(r) for r in M.keep_one(spark, docs, "").collect()]
    assert len([r for r in out if r in rows[:2]]) == 1
    assert sorted(map(str, (r for r in out if r not in rows[:2]))) == sorted(map(str, [(3, near(b)), (5, c), (7, d), (None, None), (None, "one more text")]))


def test_shuffled_joins_say_what_broadcasts_say(spark, documents, monkeypatch):
    """Bit maps and spread hot values instead of broadcasts, and large families, without AQE."""
    from meterlake.llm import shared

    rng = random.Random(13)
    prose = lambda k: " ".join(f"v{rng.randrange(300)}" for _ in range(k))
    texts = family(rng, prose(90), 30, 6) + [prose(40)] * 25 + [None, "", "a b"] + [prose(50) for _ in range(20)]
    passage = prose(50)
    texts += [prose(30) + " " + passage + " " + prose(30) for _ in range(12)]
    rng.shuffle(texts)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(shared, "HOT", 4)
    monkeypatch.setattr(M, "BLOCK_CLASSES", 6)
    monkeypatch.setattr(M, "ROUNDS", 2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in M.near_duplicates(documents(texts), words=3, percent=85).collect()}
        docs = documents(texts).union(documents(texts))
        stage = sorted(r["doc_id"] for r in M.keep_one(spark, docs, "").collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert [got[i] for i in range(len(texts))] == [(n, c, c == i) for i, (n, c) in enumerate(plain_components(texts, 3, 85))]
    assert stage == sorted([i for i, (_, c) in enumerate(plain_components(texts, 5, 80)) if c == i] * 2)
