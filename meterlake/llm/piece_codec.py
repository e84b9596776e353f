"""SentencePiece encoding and decoding by a streaming Viterbi search.

Scores are kept for a window of the last `longest` positions only. Ids are committed as soon as the
backpointer paths of all positions in that window run through one boundary. Spaces become U+2581 and
a dummy one is put in front; a literal U+2581 and characters outside the vocabulary become byte
pieces, so decoding gives back the text exactly.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table
from .vocabulary import PIECES, SPACE, Vocabulary

#: Entries and characters of the per-process memory of encoded words.
MEMORY_WORDS, MEMORY_CHARS = 600_000, 48


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.memory: dict[str, bytes] = {}  # of this generation; words that the one before knows come over when they are used
        self.before: dict[str, bytes] = {}

    def unknown(self, c: str) -> list[int]:
        if not self.v.byte_ids:
            raise ValueError("the vocabulary has no byte pieces, so it cannot encode every text")
        return [self.v.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of text, spaces already replaced, in committed runs. Ties go to the longer last piece."""
        trie, scores, bad = self.v.trie, self.v.scores, self.v.unknown_score
        longest, worst = self.v.longest, float("-inf")
        best: dict[int, float] = {0: 0.0}  # positions in the window
        back: dict[int, tuple[int, int]] = {}  # position: (start of its last piece, id; -1 unknown), since the last commit
        committed = 0
        n = len(text)
        for at in range(n):
            here = best.pop(at)
            node, end = trie, at
            covered = False
            while end < n and (node := node.get(text[end])) is not None:
                end += 1
                if "" in node:
                    i = node[""]
                    if end == at + 1:
                        covered = True
                    s = here + scores[i]
                    if s > best.get(end, worst):
                        best[end], back[end] = s, (at, i)
            if not covered and (s := here + bad) > best.get(at + 1, worst):
                best[at + 1], back[at + 1] = s, (at, -1)
            if at - committed >= longest and (len(best) == 1 or at % longest == 0):
                to = self.convergence(best, back, committed)
                if to > committed:
                    yield self.run(text, back, committed, to)
                    back = {p: x for p, x in back.items() if p > to}
                    committed = to
        if committed < n:
            yield self.run(text, back, committed, n)

    @staticmethod
    def convergence(best: dict[int, float], back: dict[int, tuple[int, int]], committed: int) -> int:
        """The last boundary on the paths of all live positions."""
        live = set(best)
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(back[last][0] if last > committed else committed)
        return live.pop()

    def run(self, text: str, back: dict[int, tuple[int, int]], start: int, end: int) -> list[int]:
        steps = []
        while end > start:
            steps.append((end, *back[end]))
            end = back[end][0]
        return [x for end, at, i in reversed(steps) for x in ([i] if i >= 0 else self.unknown(text[at:end]))]

    def word_ids(self, word: str) -> bytes:
        """Ids of one stretch between cuts as 32-bit integers; short ones are remembered."""
        got = self.before.get(word)
        if got is None:
            ids = array("i")
            for part in self.stream(word.replace(" ", SPACE)):
                ids.extend(part)
            got = ids.tobytes()
        if len(word) <= MEMORY_CHARS:
            if 2 * len(self.memory) >= MEMORY_WORDS:
                self.before, self.memory = self.memory, {}
            self.memory[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers in machine order; none for the empty text."""
        if not text:
            return b""
        get, slow = self.memory.get, self.word_ids
        literal = array("i", self.unknown(SPACE)).tobytes() if SPACE in text else b""
        return literal.join([b"".join([get(w) or slow(w) for w in self.v.cuts(part)]) for part in (" " + text).split(SPACE)])


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        self.table = [p.replace(SPACE, " ").encode() for p in vocabulary.pieces]
        for b, i in enumerate(vocabulary.byte_ids):
            self.table[i] = bytes([b])

    def decode(self, ids) -> str:
        """The text of ids. Control pieces are empty; bytes that aren't UTF-8 become U+FFFD."""
        table = self.table
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")[1:]


_codecs: dict[int, tuple[Encoder, Decoder]] = {}


def codec(vocabulary: Vocabulary) -> tuple[Encoder, Decoder]:
    """One encoder and decoder for each vocabulary and process."""
    key = hash((tuple(vocabulary.pieces), tuple(vocabulary.scores), tuple(vocabulary.byte_ids)))
    if key not in _codecs:
        _codecs[key] = Encoder(vocabulary), Decoder(vocabulary)
    return _codecs[key]


def free_name(name: str, taken: tuple[str, ...]) -> str:
    while name in taken:
        name = f"_{name}"
    return name


def encode_documents(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | Vocabulary = PIECES) -> DataFrame:
    """The columns of keep, ids (array of int) and round_trip (ids decode to the text).

    Rows stay in their partitions. Null and empty texts have no ids and round_trip true. A text may
    be of any length; words longer than the memory's limit are searched again each time. Repeated rows
    are encoded each; an empty table gives no rows; columns beyond keep are ignored. A name that keep
    holds already gets underscores in front (`_ids`).
    """
    added = [free_name(x, keep) for x in ("ids", "round_trip")]
    spark = df.sparkSession
    small_batches(spark)
    v = vocabulary if isinstance(vocabulary, Vocabulary) else Vocabulary.load(vocabulary)
    shared = spark.sparkContext.broadcast(v)  # a few MB: the size of the vocabulary file
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = codec(shared.value)
        for batch in batches:
            offsets, parts, same = array("i", [0]), [], []
            for t in batch.column(n).to_pylist():
                ids = encoder.encode(t or "")
                parts.append(ids)
                offsets.append(offsets[-1] + len(ids) // 4)
                same.append(decoder.decode(memoryview(ids).cast("i")) == (t or ""))
            values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(parts))])
            lists = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets.tobytes())]), values)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], lists, pa.array(same, pa.bool_())], [*(f"k{i}" for i in range(n)), "ids", "round_trip"])

    named = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).alias("text"))
    kinds = dict(named.dtypes)
    schema = ", ".join([*(f"k{i} {kinds[f'k{i}']}" for i in range(n)), "ids array<int>", "round_trip boolean"])
    return named.mapInArrow(run, schema).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("ids").alias(added[0]), F.col("round_trip").alias(added[1]))


def decode_documents(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | Vocabulary = PIECES) -> DataFrame:
    """The columns of keep and text (`_text` if keep has one), decoded from ids; null ids give an empty text."""
    spark = df.sparkSession
    small_batches(spark)
    v = vocabulary if isinstance(vocabulary, Vocabulary) else Vocabulary.load(vocabulary)
    shared = spark.sparkContext.broadcast(v)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = codec(shared.value)
        for batch in batches:
            texts = [decoder.decode(x or []) for x in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(texts, pa.string())], [*(f"k{i}" for i in range(n)), "text"])

    named = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(ids).alias("ids"))
    kinds = dict(named.dtypes)
    schema = ", ".join([*(f"k{i} {kinds[f'k{i}']}" for i in range(n)), "text string"])
    return named.mapInArrow(run, schema).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("text").alias(free_name("text", keep)))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the number of its ids, a digest of them, and whether they decode to the text."""
    out = encode_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_digest"), "round_trip")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: doc_id, ids and their number for every row of docs."""
    return encode_documents(docs).select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"))
