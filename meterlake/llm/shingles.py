"""Word shingles of a text as 64-bit codes, and tensored MinHash keys over them."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose codes a process remembers: some 15 MB.
MEMORY_WORDS = 100_000
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY_WORDS:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word)
        return code


_codes = _Codes()


def forget() -> None:
    """Drop the remembered codes: processes stay alive between tasks, beside others that need the memory."""
    _codes.clear()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct shingles of `size` words, sorted; A-Z lower-cased, words cut at ASCII blanks.

    A text of fewer words is one shingle; a text without words, or null, has none. Two different
    shingles get one code with probability 2**-64.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    codes = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    n = len(codes) - size + 1
    out = codes[:n]
    for k in range(1, size):
        out = (out ^ (out >> _HALF)) * _MIX + codes[k : k + n]
    out = (out ^ (out >> _HALF)) * _MIX
    return np.unique(out ^ (out >> _HALF))


def fingerprint(codes: np.ndarray) -> bytes:
    """128 bits that stand for the whole set."""
    return xxhash.xxh3_128_digest(codes.tobytes())


class Tensored:
    """Two collections of `collection` groups of `group` minhashes each.

    Table (i, j) has the key of group i of the first and group j of the second collection, so
    2 * collection * group minhashes make collection ** 2 tables of 2 * group minhashes. A pair of
    similarity s misses all tables only if it misses one whole collection: about
    2 * (1 - s ** group) ** collection.
    """

    def __init__(self, collection: int, group: int, seed: int = 7):
        self.collection, self.group = collection, group
        draw = np.random.Generator(np.random.PCG64(seed))
        n = 2 * collection * group
        self.multiply = draw.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = draw.integers(0, 2**63, n, dtype=np.uint64)

    def signature(self, codes: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Keys of the groups of both collections, 2 x collection, as signed 64-bit integers; a byte of each minhash."""
        least = np.full(len(self.multiply), np.iinfo(np.uint64).max)
        for at in range(0, len(codes), 4096):
            part = codes[None, at : at + 4096] * self.multiply[:, None] + self.add[:, None]
            np.minimum(least, part.min(axis=1), out=least)
        least = least.reshape(2 * self.collection, self.group)
        out = np.arange(1, 2 * self.collection + 1, dtype=np.uint64) * _MIX  # groups of different places never share a key on purpose
        for k in range(self.group):
            out = (out ^ (out >> _HALF)) * _MIX + least[:, k]
        out = (out ^ (out >> _HALF)) * _MIX
        return out.view(np.int64).reshape(2, self.collection), ((least * _MIX) >> np.uint64(56)).astype(np.uint8).tobytes()
