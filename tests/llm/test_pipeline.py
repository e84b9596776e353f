"""The corpus pipeline against plain Python: every stage written again, on a table of odd rows."""

import math
import random

import numpy as np

import corpus_pipeline as P
from meterlake.llm import piece_codec
from meterlake.llm import quality_classifier as C
from meterlake.llm import quality_rules as R
from meterlake.llm.text_stats import document_stats

from test_decontamination import form, plain_distances
from test_near_duplicates import plain_components


def plain_quality(stats, labels):
    """Whether each row of stats is kept, by numpy; labels: (label, stats) of the rows that teach."""

    def features(s):
        share = lambda a, b: math.sqrt(s[a] / max(s[b], 1))
        words = max(s["n_words"], 1)
        return [math.log1p(s["n_words"]), math.log1p(s["word_chars"] / words), share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"),
                math.log1p(s["n_distinct_words"]) - 0.8 * math.log1p(s["n_words"]), share("n_upper", "word_chars"), share("n_exclaims", "n_words"), share("n_stops", "n_words"), share("n_digits", "word_chars"), share("n_lines", "n_words")]

    x = {k: np.array([features(s) for y, s in labels if y == k]) for k in (0, 1)}
    flat = np.array([features(s) for s in stats])
    pooled = sum(len(x[k]) * np.cov(x[k].T, bias=True) for k in x) / sum(map(len, x.values()))
    odds = np.full(len(flat), math.log((len(x[1]) + 1) / (len(x[0]) + 1)))
    for k in x:
        cov = (1 - C.TO_POOLED) * np.cov(x[k].T, bias=True) + C.TO_POOLED * pooled
        cov = cov * (1 - C.TO_DIAGONAL) + np.diag(np.diag(cov)) * C.TO_DIAGONAL + np.eye(len(cov)) * C.LEAST_VARIANCE
        z = flat - x[k].mean(axis=0)
        odds += (1 if k else -1) * -0.5 * (np.linalg.slogdet(cov)[1] + np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z))
    return odds >= 0


def plain_rules(stats):
    """Whether the rules keep each row of stats: votes by Python, EM over rows instead of patterns."""
    run = lambda rule, s: eval(rule.replace(" OR ", " or ").replace(" AND ", " and ").replace(" = ", " == "), {}, s)  # noqa: E731, S307
    votes = np.array([[1 if not s["n_words"] else 0 if run(bad, s) else 2 if run(good, s) else 1 for bad, good in R.RULES.values()] for s in stats])
    share, on = np.array([1 - R.PRIOR_GOOD, R.PRIOR_GOOD]), np.array([R.ON_BAD, R.ON_GOOD])
    prior, weight = math.log(share[1] / share[0]), np.tile(np.log(on[1] / on[0]), (votes.shape[1], 1))
    at = np.arange(votes.shape[1])
    for _ in range(R.ITERATIONS):
        good = 1 / (1 + np.exp(-(prior + weight[at, votes].sum(axis=1))))
        part = np.stack([1 - good, good])
        believed = R.BELIEF * len(stats)
        mass = believed * share + part.sum(axis=1)
        seen = np.array([[[believed * share[k] * on[k][v] + part[k][votes[:, x] == v].sum() for v in range(3)] for k in (0, 1)] for x in at])
        prior, weight = math.log(mass[1] / mass[0]), np.log(seen[:, 1] / mass[1]) - np.log(seen[:, 0] / mass[0])
    probability = 1 / (1 + np.exp(-(prior + weight[at, votes].sum(axis=1))))
    return [p >= 0.5 and s["n_words"] >= 10 and 100 * s["n_repeat_words"] <= 20 * s["n_words"] for p, s in zip(probability, stats)]


def test_run_equals_plain_python(spark, tmp_path):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary) + (".\n" if i % 9 == 8 else "") for i in range(n))
    good = [prose(rng.randint(60, 160)) for _ in range(90)]
    junk = [prose(60).upper().replace(" ", "!! ") for _ in range(15)] + [prose(60).replace(" ", "*** ") for _ in range(15)]
    items = [prose(22) for _ in range(4)]
    texts = good + junk + [good[3], good[4] + " end", good[5].replace(good[5].split()[40], "changed")] + [g + " " + x for g, x in zip(good[10:14], items)] + [None, "", " \n", "too short"] + [prose(20) * 6]
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), 7, "x") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[20], (None, prose(80), None, None, None, None, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long, n long, _row string"
    documents = spark.createDataFrame(rows, names)
    labels = [(i, int(i < 90), 0) for i in range(120)] + [(3, 1, 0)]
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)) + [(9, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    texts = [r[:2] for r in rows]
    numbered = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    stats = [r.asDict() for r in document_stats(numbered).orderBy("doc_id").collect()]  # held against plain Python in test_quality
    from zlib import crc32

    told = {(k, y) for k, y, _ in labels if crc32(str(k).encode()) % 3 != 1}
    left = [i for i, ok in enumerate(plain_quality(stats, [(y, stats[i]) for k, y in told for i, (key, _) in enumerate(texts) if key == k])) if ok]
    assert 60 < len(left) < len(texts) - 20
    left = [i for i, ok in zip(left, plain_rules([stats[i] for i in left])) if ok]
    groups = plain_components([texts[i][1] for i in left], 5, 80)
    name = lambda i: (math.inf if texts[i][0] is None else texts[i][0], texts[i][1])
    least = {c: min(name(j) for j, (_, b) in zip(left, groups) if b == c) for _, c in groups}
    left = [i for i, (_, c) in zip(left, groups) if name(i) == least[c]]
    windows = [np.array(form(x.strip())) for x in items]
    windows = [np.stack([w[a : a + 64] for a in range(len(w) - 63)]) for w in windows]
    left = [i for i in left if not any((plain_distances(w, form(texts[i][1])) <= 3).any() for w in windows)]

    out = P.run(spark, str(tmp_path))
    got = sorted(((r["doc_id"], r["text"]) for r in piece_codec.decode_documents(out).collect()), key=str)
    assert got == sorted((texts[i] for i in left), key=str)
    assert P.run(spark, str(empty(documents, tmp_path))).count() == 0


def empty(documents, tmp_path):
    """The same folder without documents."""
    where = tmp_path / "empty"
    documents.filter("false").write.parquet(f"{where}/documents.parquet")
    for name in ("labels", "benchmark"):
        documents.sparkSession.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{where}/{name}.parquet")
    return where
