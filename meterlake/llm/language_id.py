"""Language identification with unigram piece models, summed over all segmentations.

For each language, every piece of a fixed public vocabulary has a probability. The probability of a
word is the sum over all its segmentations into pieces (forward algorithm), that of a text the
product over its words. No piece crosses a word's start, so this equals the sum over all
segmentations of the text.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_classifier import held_out
from .shared import bounded_sample, materialize, small_batches, table
from .vocabulary import PIECES, SPACE, Vocabulary

#: Documents of each language that the model is fitted on, at most; EM steps; added to each expected count.
TRAIN_ROWS, STEPS, SMOOTHING = 2_000, 2, 0.05
#: Probability of a character that no piece covers, in every language.
UNCOVERED = 1e-6
#: Words remembered by a process, and the longest of them in characters with the leading space.
MEMORY_WORDS, MEMORY_CHARS = 300_000, 32
#: Words whose lattices are built at once in an EM step.
TOGETHER = 20_000
UNDETERMINED = "und"
#: Runs of characters that make up words, and of those the letters by Unicode category, without other numerals.
WORDLIKE, LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters (Unicode category L), lower case. The same splitting learns and predicts."""
    out = WORDLIKE.findall(text.lower()) if text else []
    if all(map(str.isalpha, out)):
        return out
    return [x for w in out for x in ((w,) if w.isalpha() else LETTERS.findall(w))]


class Lattice:
    """All pieces at all places of words of one length."""

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        self.n = len(words[0])
        self.m = len(words)
        rows, ids = defaultdict(list), defaultdict(list)
        root, uncovered = vocabulary.trie, len(vocabulary.pieces)
        for r, word in enumerate(words):
            for start in range(self.n):
                node, end, covered = root, start, False
                while end < self.n and (node := node.get(word[end])) is not None:
                    end += 1
                    if "" in node:
                        covered |= end == start + 1
                        rows[start, end].append(r)
                        ids[start, end].append(node[""])
                if not covered:
                    rows[start, start + 1].append(r)
                    ids[start, start + 1].append(uncovered)
        self.edges = [(*at, np.array(rows[at]), np.array(ids[at])) for at in sorted(rows)]

    def forward(self, p: np.ndarray) -> np.ndarray:
        """p: probabilities, (pieces + 1) x languages. Returns places x words x languages."""
        alpha = np.zeros((self.n + 1, self.m, p.shape[1]))
        alpha[0] = 1
        for start, end, rows, ids in self.edges:
            alpha[end, rows] += alpha[start, rows] * p[ids]
        return alpha

    def expected(self, p: np.ndarray, counts: np.ndarray, into: np.ndarray) -> None:
        """Add to into the expected uses of each piece, for one language; counts: of each word."""
        alpha = self.forward(p[:, None])[:, :, 0]
        beta = np.zeros((self.n + 1, self.m))
        beta[self.n] = counts / alpha[self.n]
        for start, end, rows, ids in reversed(self.edges):
            use = p[ids] * beta[end, rows]
            beta[start, rows] += use
            np.add.at(into, ids, alpha[start, rows] * use)


def expected_long(text: str, v: Vocabulary, p: np.ndarray, count: float, into: np.ndarray) -> None:
    """Lattice.expected() for one text of any length; sums are kept as logarithms, as they fall below any float."""
    n, uncovered, root = len(text), len(v.pieces), v.trie
    logs = np.log(p).tolist()

    def edges(at: int) -> list[tuple[int, int]]:
        node, end, out, covered = root, at, [], False
        while end < n and (node := node.get(text[end])) is not None:
            end += 1
            if "" in node:
                covered |= end == at + 1
                out.append((end, node[""]))
        return out if covered else [*out, (at + 1, uncovered)]

    def total(terms: list[float]) -> float:
        top = max(terms)
        return top + math.log(sum(math.exp(x - top) for x in terms))

    ahead: dict[int, list[float]] = {0: [0.0]}
    alpha, beta = np.zeros(n + 1), np.zeros(n + 1)
    for at in range(n + 1):
        alpha[at] = here = total(ahead.pop(at))
        for end, i in edges(at) if at < n else ():
            ahead.setdefault(end, []).append(here + logs[i])
    for at in range(n - 1, -1, -1):
        ways = [(i, logs[i] + beta[end]) for end, i in edges(at)]
        beta[at] = total([x for _, x in ways])
        for i, x in ways:
            into[i] += count * math.exp(alpha[at] + x - alpha[n])


def chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Rows of batches, some `most` at a time."""
    held: list[tuple] = []
    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns))
        if len(held) >= most:
            yield held
            held = []
    if held:
        yield held


def by_length(words: list[str]) -> dict[int, list[int]]:
    out = defaultdict(list)
    for i, w in enumerate(words):
        out[len(w)].append(i)
    return out


class Scorer:
    """Log probabilities of words in all languages. Broadcast, so that a process has one and keeps its memory from task to task."""

    def __init__(self, vocabulary: Vocabulary, languages: list[str], p: np.ndarray):
        self.v, self.languages, self.p = vocabulary, languages, p
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((1 << 12, len(self.languages)))

    def learn(self, words: list[str]) -> None:
        """Put words into the memory, those of one length at a time."""
        if len(self.index) + len(words) > MEMORY_WORDS:
            self.forget()
        marked = [SPACE + w for w in words]
        at = len(self.index)
        while at + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for group in by_length(marked).values():
            lattice = Lattice([marked[i] for i in group], self.v)
            self.table[at : at + len(group)] = np.log(lattice.forward(self.p)[-1])
            self.index.update(zip([words[i] for i in group], range(at, at + len(group))))
            at += len(group)

    def long_word(self, word: str) -> np.ndarray:
        """A word of any length: forward sums are kept for the longest piece only, scaled at each step."""
        text, root, uncovered = SPACE + word, self.v.trie, len(self.v.pieces)
        window: dict[int, np.ndarray] = {0: np.ones(len(self.languages))}
        log = np.zeros(len(self.languages))
        for at in range(len(text)):
            here = window.pop(at)
            log += np.log(here)  # what is ahead is relative to the sum here
            for x in window:
                window[x] = window[x] / here
            node, end, covered = root, at, False
            while end < len(text) and (node := node.get(text[end])) is not None:
                end += 1
                if "" in node:
                    covered |= end == at + 1
                    window[end] = window.get(end, 0) + self.p[node[""]]
            if not covered:
                window[at + 1] = window.get(at + 1, 0) + self.p[uncovered]
        return log + np.log(window[len(text)])

    def texts(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Summed log probabilities of each text; None without a letter."""
        split = [words_of(t) for t in texts]
        index = self.index
        fresh = {w for words in split for w in words if w not in index and len(w) < MEMORY_CHARS}
        if fresh and len(index) + len(fresh) > MEMORY_WORDS:
            self.forget()
            index = self.index
            fresh = {w for words in split for w in words if len(w) < MEMORY_CHARS}
        if fresh:
            self.learn(sorted(fresh))
        out: list[np.ndarray | None] = []
        for words in split:
            known = [i for w in words if (i := index.get(w)) is not None]
            total = self.table[known].sum(axis=0) if known else np.zeros(len(self.languages))
            if len(known) < len(words):
                for w in words:
                    if w not in index:
                        total = total + self.long_word(w)
            out.append(total if words else None)
        return out


def training_words(docs: DataFrame, text: str, lang: str, key: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """lang, word, n over at most `rows` documents of each language, those with the smallest hashes, whole texts."""
    spark = docs.sparkSession
    small_batches(spark)
    told = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang")).filter(F.col("lang").isNotNull() & ~held_out("key"))
    chosen = F.broadcast(materialize(bounded_sample(told, "key", rows, "lang").distinct(), "language-sample"))  # rows times the number of languages
    sample = docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(chosen, ["key", "lang"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple[str, str], int] = defaultdict(int)
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in words_of(t):
                    seen[x, w] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities, (pieces + 1) x languages, the last row for uncovered characters.

    Starts with all pieces alike and takes STEPS of EM over runs of letters of any length; a language
    whose sample has no letter is not learned. What the driver gathers is at most one
    number for each piece and language, as Arrow columns: 16 bytes each.
    Null texts and languages and rows with a null key teach nothing; repeated rows teach as often as they occur.
    """
    spark = docs.sparkSession
    counts = materialize(training_words(docs, text, lang, key, rows), "language-words")
    languages = sorted(r[0] for r in counts.select("lang").distinct().collect())
    size = len(vocabulary.pieces)
    p = np.full((size + 1, max(1, len(languages))), 1.0 / max(1, len(vocabulary.ids)))
    p[size] = UNCOVERED
    shared = spark.sparkContext.broadcast(vocabulary)
    for _ in range(STEPS if languages else 0):
        now = spark.sparkContext.broadcast(p)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            into = np.zeros((len(languages), size + 1))
            for rows in chunks(batches, TOGETHER):
                for k, x in enumerate(languages):
                    own = [(w, n) for y, w, n in rows if y == x and len(w) < MEMORY_CHARS]
                    for y, w, n in rows:
                        if y == x and len(w) >= MEMORY_CHARS:
                            expected_long(SPACE + w, shared.value, now.value[:, k], n, into[k])
                    for group in by_length([w for w, _ in own]).values():
                        Lattice([SPACE + own[i][0] for i in group], shared.value).expected(now.value[:, k], np.array([own[i][1] for i in group], float), into[k])
            k, i = np.nonzero(into[:, :size])
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, pa.int32()), pa.array(into[k, i])], ["k", "i", "x"])

        got = counts.select("lang", "word", "n").mapInArrow(expect, "k int, i int, x double").groupBy("k", "i").agg(F.sum("x").alias("x")).toArrow()
        used = np.zeros((len(languages), size))
        used[got["k"].to_numpy(), got["i"].to_numpy()] = got["x"].to_numpy()
        plain = np.array([bool(x) for x in vocabulary.pieces])
        used[:, plain] += SMOOTHING
        p = np.concatenate([(used / used.sum(axis=1, keepdims=True)).T, np.full((1, len(languages)), UNCOVERED)])
    return languages, p


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], vocabulary: Vocabulary, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, lang_pred and score of every row, whole texts, in one pass without a shuffle.

    score is the posterior probability of lang_pred, all languages alike beforehand; ties go to the
    first language by name. Null texts, texts without a letter (numerals such as Roman ones are none)
    and an untrained model give `und` and 0. Texts and words may be of any length. Repeated rows are
    treated alike, null keys as any; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Scorer(vocabulary, *model))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        languages = scorer.languages
        for batch in batches:
            langs, scores = [], []
            for total in scorer.texts(batch.column(1).to_pylist()) if languages else [None] * batch.num_rows:
                if total is None:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                else:
                    best = int(total.argmax())
                    langs.append(languages[best])
                    scores.append(1.0 / sum(math.exp(max(-700.0, x - total[best])) for x in total))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(predict, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vocabulary = Vocabulary.load(PIECES)
    out = identify(docs, fit(docs, vocabulary), vocabulary)
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")
