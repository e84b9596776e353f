"""Benchmark decontamination by the q-gram lemma and banded alignment.

Two strings of length w within e edits share at least w + 1 - q * (e + 1) of their q-grams, and the
shared ones lie in a band of diagonals as wide as the budget. Every stretch of an item of a window's
length counts: a window slides over the q-grams that an item shares with a text in each of overlapping
diagonal bands; where it reaches the bound, a banded alignment verifies it. Documents are never
shuffled. The items of a benchmark of one block are broadcast. Of a larger one, a sieve of its q-grams
is, and one pass over the documents writes those that may have a region; each block of items is then
compared with those few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, new_path, small_batches, table

#: Length of a q-gram, of a window, and edits for a window of full length, in characters of the normal form.
Q, WINDOW, EDITS = 10, 64, 3
#: Benchmark text that one pass compares with all documents, in characters.
BLOCK_CHARS = 2_000_000
#: Of a benchmark beyond that: bits of its sieve for each q-gram, and in all as a power of 2 (256 MB).
SIEVE_BITS, MOST_SIEVE_BITS = 16, 31
#: Characters of documents that are looked up at once.
CHUNK = 1 << 20
#: Pairs of a place in an item and one in a text that are held at once, unless one item has more in one band.
PAIRS = 1 << 18
#: Windows that are aligned at once, and bits that hold a diagonal of a band.
TOGETHER, START_BITS = 4_096, 16
#: One window in so many is aligned first.
SPARSE = 32
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The normal form of a text as code points, and the place of each in the text.

    Lower case; whatever is no letter or digit becomes a space; runs of spaces become one.
    """
    if not text:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    low = text.lower()
    if len(low) != len(text):  # a few letters become two
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    narrow = points < 128
    plain = np.where(narrow, _ASCII[np.minimum(points, 127)], True)
    if not narrow.all():
        wide = np.unique(points[~narrow])
        marks = wide[[not chr(c).isalnum() for c in wide.tolist()]]
        if len(marks):
            plain &= ~np.isin(points, marks)
    points[~plain] = 32
    keep = plain.copy()
    keep[1:] |= plain[:-1]  # the first space of a run stays, but none at the start
    at = np.flatnonzero(keep)
    return points[at], at


_ASCII = np.array([chr(c).isalnum() for c in range(128)])


def qgrams(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code for each q-gram, by doubling: codes of 2, 4, 8 characters are made of halves."""
    if len(points) < q:
        return np.zeros(0, np.uint64)
    codes, have, power = points.astype(np.uint64) + np.uint64(1), 1, _PRIME
    powers = {1: power}
    steps = {1: codes}
    while have * 2 <= q:
        codes = codes[:-have] * power + codes[have:]
        have, power = have * 2, np.uint64(int(power) ** 2 % 2**64)
        steps[have], powers[have] = codes, power
    out, length = codes, have
    n = len(points) - q + 1
    for size in sorted(steps, reverse=True)[1:]:
        if length + size <= q:
            out = out[: len(out) - size] * powers[size] + steps[size][length : length + len(out) - size]
            length += size
    return out[:n]


def budget(length: int, window: int = WINDOW, edits: int = EDITS) -> int:
    return edits * length // window


@dataclass
class Index:
    """Benchmark items and where each q-gram stands in them. Every stretch of a window's length is a window."""

    window: int
    q: int
    edits: int
    keys: np.ndarray  # of each item
    flat: np.ndarray  # normal forms of all items
    begins: np.ndarray  # of each item in flat, and the end
    codes: np.ndarray  # sorted, distinct
    offsets: np.ndarray  # of each code in places
    places: np.ndarray  # rows of (item, position)
    filter: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[int, str]], window: int = WINDOW, edits: int = EDITS, q: int = Q) -> Index:
        """Windows start at every character; an item of less than a window is one. Items of fewer than q characters have none."""
        keys, forms, codes, places = [], [], [], []
        for item, text in rows:
            points = item_form(text)
            if len(points) < q:
                continue
            grams = qgrams(points, q)
            codes.append(grams)
            places.append(np.stack([np.full(len(grams), len(keys)), np.arange(len(grams))], 1))
            keys.append(item)
            forms.append(points)
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        distinct, offsets = np.unique(flat[order], return_index=True)
        bits = np.zeros(1 << 20, bool)
        bits[_slot(distinct)] = True
        begins = np.cumsum([0] + [len(x) for x in forms])
        return cls(window, q, edits, np.array(keys, np.int64), np.concatenate(forms) if forms else np.zeros(0, np.uint32), begins, distinct, np.append(offsets, len(flat)), (np.concatenate(places) if places else np.zeros((0, 2), np.int64))[order], bits)

    @property
    def texts(self) -> list[np.ndarray]:
        """All windows."""
        return [self.flat[x : x + min(n, self.window)] for b, n in zip(self.begins, np.diff(self.begins)) for x in range(b, b + max(0, n - self.window) + 1)]

    @property
    def items(self) -> np.ndarray:
        """The item of each window."""
        return np.repeat(self.keys, np.maximum(0, np.diff(self.begins) - self.window) + 1)

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, start, end, edits) of every verified region, start and end in characters of the text."""
        forms, owners, size = [], [], 0
        for k, t in enumerate(texts):
            points, at = normal(t)
            if len(points) >= self.q and len(self.codes):
                forms.append((points, at))
                owners.append(k)
                size += len(points)
            if forms and (size >= CHUNK or k == len(texts) - 1):
                yield from self._regions(forms, owners)
                forms, owners, size = [], [], 0
        if forms:
            yield from self._regions(forms, owners)

    def _hits(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of flat where a q-gram of the items starts, and its number among codes; looked up a piece at a time."""
        hits, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in range(0, len(flat), CHUNK):
            codes = qgrams(flat[x : x + CHUNK + self.q - 1], self.q)
            hit = np.flatnonzero(self.filter[_slot(codes)])
            at = np.searchsorted(self.codes, codes[hit])
            ok = self.codes[np.minimum(at, len(self.codes) - 1)] == codes[hit]
            hits.append(hit[ok] + x)
            found.append(at[ok])
        return np.concatenate(hits), np.concatenate(found)

    def _regions(self, forms, owners) -> Iterator[tuple[int, int, int, int, int]]:
        """Places of the items that have hits are compared with them a range of diagonals at a time, some PAIRS together."""
        gap = np.full(self.q, 0xFFFFFFF0, np.uint32)  # no q-gram runs from one text into the next
        begins = np.cumsum([0] + [len(p) + self.q for p, _ in forms])
        flat = np.concatenate([x for p, _ in forms for x in (p, gap)])
        hit, found = self._hits(flat)
        if not len(hit):
            return
        order = np.argsort(found, kind="stable")  # by code, then by position
        hit, found = hit[order], found[order]
        code, first, times = np.unique(found, return_index=True, return_counts=True)
        here = self.offsets[code + 1] - self.offsets[code]
        row = np.repeat(self.offsets[code], here) + np.arange(here.sum()) - np.repeat(np.cumsum(here) - here, here)
        places = self.places[row]
        order = np.argsort(places[:, 0], kind="stable")  # by item
        sorted_hits = _Hits(hit, np.repeat(np.arange(len(code)), times), int(begins[-1]) + 1)
        seen = _Places(places[order, 0], places[order, 1], np.repeat(np.arange(len(code)), here)[order], np.repeat(first, here)[order])
        step, ahead = max(1, self.edits), int(np.diff(self.begins).max())
        texts = _Texts(flat, begins, np.array([len(p) for p, _ in forms]), step, ahead, (int(begins[-1]) + ahead) // step + 3)
        self._pairs(seen, sorted_hits, texts, 0, len(seen.item), 0, texts.width)
        for k, w, start, end, edits in texts.regions.tolist():
            at = forms[k][1]
            yield owners[k], int(self.keys[w]), int(at[start]), int(at[end - 1]) + 1, edits

    def _pairs(self, seen: _Places, hits: _Hits, texts: _Texts, x: int, y: int, low: int, high: int) -> None:
        """Add the regions of the places x ... y (whole items) in the bands low ... high.

        A band is two cells of `step` diagonals, its own and the next one, so each half of a range is
        complete by itself. What holds over PAIRS is halved: its bands or, in a single band, its items.
        """
        begin, end = seen.inner[x:y] - texts.ahead + (low - 1) * texts.step, seen.inner[x:y] - texts.ahead + high * texts.step
        a, b = hits.between(seen.code[x:y], begin, end)
        n = int((b - a).sum())
        if not n:
            return
        if n > PAIRS and high - low > 1:
            middle = (low + high) // 2
            self._pairs(seen, hits, texts, x, y, low, middle)
            self._pairs(seen, hits, texts, x, y, middle, high)
        elif n > PAIRS and seen.item[x] != seen.item[y - 1]:
            middle = int(np.searchsorted(seen.item, seen.item[(x + y) // 2]))
            middle = middle if middle > x else int(np.searchsorted(seen.item, seen.item[x], "right"))
            self._pairs(seen, hits, texts, x, middle, low, high)
            self._pairs(seen, hits, texts, middle, y, low, high)
        else:
            times = b - a
            at = hits.at[np.repeat(a, times) + np.arange(n) - np.repeat(np.cumsum(times) - times, times)]
            self._windows(np.repeat(seen.item[x:y], times), np.repeat(seen.inner[x:y], times), at, texts, low, high)

    def _windows(self, item: np.ndarray, inner: np.ndarray, at: np.ndarray, texts: _Texts, low: int, high: int) -> None:
        """Add the regions among pairs of a place in an item and one in the texts, in the bands low ... high."""
        owner = np.searchsorted(texts.begins, at, "right") - 1
        cell = (at - inner + texts.ahead) // texts.step + 1
        band = np.concatenate([cell, cell - 1])
        item, owner, inner = np.concatenate([item, item]), np.concatenate([owner, owner]), np.concatenate([inner, inner])
        own = np.flatnonzero((band >= low) & (band < high))
        if not len(own):
            return
        item, band, owner, inner = item[own], band[own], owner[own], inner[own]
        order = np.lexsort((inner, owner, band, item))
        item, band, owner, inner = item[order], band[order], owner[order], inner[order]
        # a q-gram of the item counts once for a band and text
        apart = (np.diff(item) != 0) | (np.diff(band) != 0) | (np.diff(owner) != 0)
        fresh = np.append(True, apart | (np.diff(inner) != 0))
        group = np.cumsum(np.append(False, apart))[fresh]
        item, band, owner, inner = item[fresh], band[fresh], owner[fresh], inner[fresh]
        sizes = np.diff(self.begins)
        size = np.minimum(sizes[item], self.window)
        least = np.maximum(1, size + 1 - self.q * (budget(size, self.window, self.edits) + 1))
        # windows that hold this q-gram and as many after it as the lemma asks for
        last = np.arange(len(item)) + least - 1
        ok = np.flatnonzero(last < len(item))
        ok = ok[(group[last[ok]] == group[ok]) & (inner[last[ok]] - inner[ok] <= size[ok] - self.q)]
        if not len(ok):
            return
        start = np.maximum(0, inner[last[ok]] - (size[ok] - self.q))
        stop = np.minimum(inner[ok], sizes[item[ok]] - size[ok])
        again = np.append(False, group[ok][1:] == group[ok][:-1])
        start = np.where(again, np.maximum(start, np.append(0, stop[:-1]) + 1), start)  # each window once for a band and text
        times = np.maximum(0, stop - start + 1)
        self._verified(texts, item[ok], band[ok], owner[ok], size[ok], start, times)

    def _verified(self, texts: _Texts, item, band, owner, size, low, times) -> None:
        """Add the regions where the windows low ... low + times of the bands match, some aligned at once.

        A window that can match only inside a region that is known to match without edits changes nothing and
        isn't aligned; every SPARSE-th window comes first, so that long runs are known early.
        """
        ends = np.cumsum(times)
        n = int(ends[-1])
        for skip in (0, 1):
            for x in range(0, n, TOGETHER * (1 if skip else SPARSE)):
                number = np.arange(x, min(x + TOGETHER, n)) if skip else np.arange(x, min(x + TOGETHER * SPARSE, n), SPARSE)
                number = number[number % SPARSE != 0] if skip else number
                at = np.searchsorted(ends, number, "right")
                start = low[at] + number - (ends[at] - times[at])
                which, text, length = item[at], owner[at], size[at]
                first = (band[at] - 1) * texts.step - texts.ahead - texts.begins[text] + start  # where the band's lowest diagonal puts the window
                open_ = np.flatnonzero(~texts.inside(text, which, first - budget(length, self.window, self.edits), first + length + 2 * texts.step + budget(length, self.window, self.edits)))
                found = [texts.regions]
                for k in np.unique(length[open_]).tolist():
                    own = open_[length[open_] == k]
                    patterns = self.flat[(self.begins[which[own]] + start[own])[:, None] + np.arange(k)]
                    got = align(patterns, texts.flat, texts.begins[text[own]], texts.lengths[text[own]], first[own], 2 * texts.step, budget(k, self.window, self.edits))
                    good = np.flatnonzero(got[2] >= 0)
                    found.append(np.stack([text[own[good]], which[own[good]], *(c[good] for c in got)], 1))
                texts.regions = merged(np.concatenate(found))


@dataclass
class _Hits:
    """Positions with a q-gram of the items, sorted by its number and position; span is over every position."""

    at: np.ndarray
    code: np.ndarray
    span: int

    def between(self, code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each code, the range of its positions begin <= at < end."""
        if not hasattr(self, "key"):
            self.key = self.code * self.span + self.at  # both below 2**31
        clip = lambda x: code * self.span + np.clip(x, 0, self.span - 1)
        return np.searchsorted(self.key, clip(begin)), np.searchsorted(self.key, clip(end))


@dataclass
class _Places:
    """Places of items whose q-gram the texts have, by item."""

    item: np.ndarray
    inner: np.ndarray
    code: np.ndarray
    first: np.ndarray


@dataclass
class _Texts:
    """Some texts in a row, how their diagonals fall into cells, and the regions found so far: rows of merged()."""

    flat: np.ndarray
    begins: np.ndarray
    lengths: np.ndarray
    step: int
    ahead: int
    width: int
    regions: np.ndarray = field(default_factory=lambda: np.zeros((0, 5), np.int64))

    def inside(self, text: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether begin ... end, as far as the text reaches, lies in one region of the text and item without edits."""
        whole = self.regions[self.regions[:, 4] == 0]
        if not len(whole) or not len(text):
            return np.zeros(len(text), bool)
        begin, end = np.clip(begin, 0, self.lengths[text]), np.clip(end, 0, self.lengths[text])
        items, span = max(int(whole[:, 1].max()), int(item.max())) + 1, int(self.lengths.max()) + 1
        pairs, rank = np.unique(whole[:, 0] * items + whole[:, 1], return_inverse=True)
        own = np.searchsorted(pairs, text * items + item)
        same = pairs[np.minimum(own, len(pairs) - 1)] == text * items + item
        last = np.searchsorted(rank * span + whole[:, 2], own * span + begin, "right") - 1  # the last region that starts by then
        near = np.maximum(last, 0)
        return same & (last >= 0) & (rank[near] == own) & (whole[near, 3] >= end)


def merged(rows: np.ndarray) -> np.ndarray:
    """Rows (text, item, start, end, edits), overlapping extents of a text and item as one with the fewest edits.

    Merging some rows first and the rest later gives the same.
    """
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    apart = np.append(True, (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0))
    span = int(rows[:, 3].max()) + 1
    reach = np.maximum.accumulate(rows[:, 3] + (np.cumsum(apart) - 1) * span) - (np.cumsum(apart) - 1) * span  # the furthest end so far
    first = np.flatnonzero(apart | np.append(True, rows[1:, 2] >= reach[:-1]))
    out = rows[first].copy()
    out[:, 3] = np.maximum.reduceat(rows[:, 3], first)
    out[:, 4] = np.minimum.reduceat(rows[:, 4], first)
    return out


def _slot(codes: np.ndarray) -> np.ndarray:
    return ((codes * _PRIME) >> np.uint64(44)).astype(np.int64)


def align(patterns: np.ndarray, flat: np.ndarray, begins: np.ndarray, lengths: np.ndarray, first: np.ndarray, width: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best place of each pattern in its text with at most `most` edits on diagonals near first ... first + width.

    patterns: rows of one length; text i is flat[begins[i] : begins[i] + lengths[i]]. Returns starts,
    ends and edits, -1 where there is no such place; of the best places the one that ends first. The
    band holds `most` diagonals more than asked for on both sides, as no path leaves it by more.
    """
    n, diagonals = patterns.shape[1], width + 2 * most + 1
    base = first - most
    where = base[None, :] + np.arange(n + diagonals)[:, None]
    inside = (where >= 0) & (where < lengths)
    strip = np.where(inside, flat[np.clip(where + begins, 0, len(flat) - 1)], 0xFFFFFFFF).astype(np.uint32)
    place = np.arange(diagonals, dtype=np.int32)[:, None]
    # edits in the upper bits; below them the start, the latest being the smallest
    cost = np.where((where[:diagonals] >= 0) & (where[:diagonals] <= lengths), diagonals - 1 - place, 1 << 29).astype(np.int32)
    one = np.int32(1 << START_BITS)
    slope = place * one
    for i, c in enumerate(np.ascontiguousarray(patterns.T)):
        new = cost + (strip[i : i + diagonals] != c) * one
        np.minimum(new[:-1], cost[1:] + one, out=new[:-1])
        new -= slope
        np.minimum.accumulate(new, axis=0, out=new)
        cost = new + slope
    edits = cost >> START_BITS
    end = edits.argmin(axis=0)
    each = np.arange(len(end))
    best = edits[end, each]
    start = base + diagonals - 1 - (cost[end, each] & ((1 << START_BITS) - 1))
    end = np.minimum(base + n + end, lengths)
    return start, end, np.where((best <= most) & (end > start), best, -1)


@dataclass
class Sieve:
    """Hashes of all q-grams of any number of items, as bit maps: says which texts may have a region.

    A region has as many q-grams of a window as the lemma asks for, at places of the text that no two of them
    share and that lie as near as a window with its edits; a region of a shorter item has one at least.
    """

    window: int
    q: int
    edits: int
    shift: int
    all: np.ndarray  # packed bits
    short: np.ndarray  # of items of less than a window

    @classmethod
    def build(cls, rows: Iterator[tuple[int | None, str]], chars: int, window: int, edits: int, q: int = Q) -> Sieve:
        bits = min(max(20, (chars * SIEVE_BITS).bit_length()), MOST_SIEVE_BITS)
        out = cls(window, q, edits, 64 - bits, np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << (bits - 3), np.uint8))
        for _, text in rows:
            points = item_form(text)
            for map_ in (out.all, out.short)[: 1 + (len(points) < window)]:
                slots = out.slots(qgrams(points, q))
                np.bitwise_or.at(map_, slots >> np.uint64(3), np.uint8(1) << (slots & np.uint64(7)).astype(np.uint8))
        return out

    def slots(self, codes: np.ndarray) -> np.ndarray:
        return (codes * _PRIME) >> np.uint64(self.shift)

    def passes(self, text: str | None) -> bool:
        points, _ = normal(text)
        near = self.window + self.edits - self.q + 1
        least = self.window + 1 - self.q * (budget(self.window, self.window, self.edits) + 1)
        for x in range(0, len(points), CHUNK):
            slots = self.slots(qgrams(points[x : x + CHUNK + near + self.q], self.q))
            byte, bit = slots >> np.uint64(3), (slots & np.uint64(7)).astype(np.uint8)
            if ((self.short[byte] >> bit) & 1).any():
                return True
            total = np.append(0, np.cumsum((self.all[byte] >> bit) & 1, dtype=np.int64))
            if len(total) and (total[min(near, len(total) - 1) :] - total[: max(1, len(total) - near)] >= max(1, least)).any():
                return True
        return False


def item_form(text: str | None) -> np.ndarray:
    points, _ = normal(text)
    return points[:-1] if len(points) and points[-1] == 32 else points


def items_of(benchmark: DataFrame, key: str, text: str) -> Iterator[tuple[int | None, str]]:
    """Items, read one partition at a time; null texts are left out, null keys are not."""
    return map(tuple, benchmark.select(key, text).filter(F.col(text).isNotNull()).toLocalIterator())


def blocks(items: Iterator[tuple[int | None, str]], chars: int | None = None) -> Iterator[list[tuple[int | None, str]]]:
    """Items in blocks of a bounded size."""
    block: list[tuple[int | None, str]] = []
    size = 0
    for item in items:
        block.append(item)
        size += len(item[1])
        if size >= (chars or BLOCK_CHARS):
            yield block
            block, size = [], 0
    if block:
        yield block


def numbered(rows: list[tuple[int | None, str]]) -> list[tuple[int, str]]:
    return [(i, t) for i, (_, t) in enumerate(rows)]


def regions(named: DataFrame, rows: list[tuple[int | None, str]], window: int, edits: int) -> tuple[DataFrame, object]:
    """key, item, start, end, edits of the regions of one block of items in named (key, text); and the broadcast that they need."""
    shared = named.sparkSession.sparkContext.broadcast((Index.build(numbered(rows), window, edits), [r[0] for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids = shared.value
        for batch in batches:
            keys = batch.column(0)
            got = [(k, ids[i], *x) for k, i, *x in index.search(batch.column(1).to_pylist())]
            columns = list(zip(*got)) if got else [[]] * 5
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int64(), pa.int64(), pa.int64(), pa.int32())))], ["key", "item", "start", "end", "edits"])

    return named.mapInArrow(run, f"key {dict(named.dtypes)['key']}, item long, start long, end long, edits int"), shared


def sieved(docs: DataFrame, sieve, text: str, passing: bool) -> DataFrame:
    """The rows of docs that the broadcast sieve lets pass, or the others."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([sieve.value.passes(t) == passing for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def all_regions(named: DataFrame, benchmark: DataFrame, item: str, item_text: str, window: int, edits: int) -> DataFrame:
    """regions() of every block in named, candidates that are written: one block after the other, each reading them once."""
    path = new_path(named.sparkSession, "regions")
    for rows in blocks(items_of(benchmark, item, item_text)):
        found, shared = regions(named, rows, window, edits)
        found.write.mode("append").parquet(path)
        shared.destroy()
    return named.sparkSession.read.schema(found.schema).parquet(path)


def build_sieve(benchmark: DataFrame, item: str, item_text: str, window: int, edits: int):
    chars = benchmark.agg(F.coalesce(F.sum(F.length(item_text)), F.lit(0))).first()[0]
    return benchmark.sparkSession.sparkContext.broadcast(Sieve.build(items_of(benchmark, item, item_text), chars, window, edits))


def leading_blocks(benchmark: DataFrame, item: str, item_text: str) -> list[list[tuple[int | None, str]]]:
    """The first block and, if there are more, the second."""
    return list(islice(blocks(items_of(benchmark, item, item_text)), 2))


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, edits: int = EDITS) -> DataFrame:
    """key, item, start, end, edits: a row for every verified region of every document.

    A region matches any stretch of `window` characters of an item (the whole item, if shorter, with
    a budget in proportion) within `edits` edits, both in normal form; overlapping matches of an item
    are one region with the edits of the closest. Whole texts are searched, very long ones a piece at a time.
    Null and empty texts and items shorter than a q-gram give nothing; repeated rows give their
    regions each; a null item id is reported as null; an empty benchmark gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = dict(benchmark.dtypes)[item]
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    first = leading_blocks(benchmark, item, item_text)
    if not first:
        out = named.filter("false").selectExpr("key", "0L AS item", "0L AS start", "0L AS end", "0 AS edits")
    elif len(first) == 1:
        out, _ = regions(named, first[0], window, edits)
    else:
        sieve = build_sieve(benchmark, item, item_text, window, edits)
        out = all_regions(materialize(sieved(named, sieve, "text", True), "leak-candidates"), benchmark, item, item_text, window, edits)
    return out.select(F.col("key").alias(key), F.col("item").cast(kind).alias(item), "start", "end", "edits")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and item that leaks into it: matched regions, their extent and fewest edits."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_regions"), F.min("start").alias("first_char"), F.max("end").alias("last_char"), F.min("edits").alias("least_edits"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, edits: int = EDITS) -> DataFrame:
    """The rows of docs that have no region of leaks(), with all their columns; no text is shuffled.

    Rows with a null or empty text stay; repeated rows stay or go together; an empty benchmark leaves all.
    """
    small_batches(docs.sparkSession)
    first = leading_blocks(benchmark, item, item_text)
    if len(first) == 1:
        return free_of(docs, first[0], text, window, edits)
    if not first:
        return docs
    sieve = build_sieve(benchmark, item, item_text, window, edits)
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    doubtful = materialize(sieved(packed, sieve, "text", True).withColumn("key", F.monotonically_increasing_id()), "leak-candidates")
    bad = all_regions(doubtful.select("key", "text"), benchmark, item, item_text, window, edits).select("key").distinct()
    return sieved(packed, sieve, "text", False).select("row.*").unionByName(doubtful.join(bad, "key", "left_anti").select("row.*"))


def free_of(docs: DataFrame, rows: list[tuple[int | None, str]], text: str, window: int, edits: int) -> DataFrame:
    """The rows of docs without a region of one block of items."""
    shared = docs.sparkSession.sparkContext.broadcast(Index.build(numbered(rows), window, edits))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = {x[0] for x in shared.value.search(batch.column(at).to_pylist())}
            yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of docs without a region that matches the benchmark."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))
