"""Vectorised word hashing over the UTF-8 bytes of many texts at once.

A word is a maximal run of ASCII letters, digits and non-ASCII bytes; A-Z count as a-z.
Each word gets a 64-bit hash from a position-free polynomial over its bytes, so the work
is a handful of numpy passes over a block of bytes, whatever the number of words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of texts worked on at once; the fewer serve the pipeline's stages, whose arrays take some fifty times as much.
BLOCK_BYTES, FEW_BYTES = 1 << 20, 1 << 18
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _trim = None


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U64(shift)
        x *= U64(factor)
    x ^= x >> U64(31)
    return x


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    code = np.arange(256)
    letter = ((code | 32) >= 97) & ((code | 32) <= 122) & (code < 128)
    is_word = letter | ((code >= 48) & (code <= 57)) | (code >= 128)
    folded = np.where(letter, code | 32, code)
    return is_word, mix(folded.astype(U64) + U64(0x9E3779B97F4A7C15))


IS_WORD, BYTE_VALUE = _byte_tables()
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(kind: str, n: int) -> np.ndarray:
    """The first ``n`` powers of the base, or of its inverse, modulo 2**64."""
    have = _powers[kind]
    while len(have) < n:
        step = pow(_BASE if kind == "up" else _BASE_INVERSE, len(have), 1 << 64)
        have = np.concatenate([have, have * U64(step)])
    _powers[kind] = have
    return have[:n]


@dataclass
class Words:
    """Words of a block of texts: ``hash[i]`` belongs to text ``doc[i]``; text d has words first[d]..first[d+1]."""

    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    text_start: np.ndarray
    _sums: np.ndarray

    def prefix_hash(self, n_bytes: int) -> np.ndarray:
        """Hash of each word's first ``n_bytes`` bytes (of the whole word if it is shorter)."""
        return self._span(self.start, np.minimum(self.end, self.start + n_bytes))

    def _span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._sums[end] - self._sums[start]) * _power("down", len(self.data) + 1)[start]
        return mix(raw + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def words_of(texts: Sequence[str]) -> Words:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    text_start = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in raw], out=text_start[1:])
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = IS_WORD[data]
    edges = np.diff(flags)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_VALUE[data] * _power("up", len(data)), out=sums[1:])
    first = np.searchsorted(start, text_start)
    doc = np.repeat(np.arange(len(raw)), np.diff(first))
    words = Words(np.zeros(0, U64), doc, first, start, end, data, text_start, sums)
    words.hash = words._span(start, end)
    return words


def blocks(texts: Sequence[str], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters each (a longer text stands alone)."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def give_back() -> None:
    """Return to the system what Arrow and NumPy have freed and hold for later.

    Spark's Python workers go from stage to stage, and would keep the most that any of them took beside the JVM's heap.
    """
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of about ``limit`` bytes each (a longer text stands alone) and their texts, made one range at a time; free memory goes back after the last."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False) + 1)
    begin = 0
    while begin < len(ends):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield begin, end, column.slice(begin, end - begin).to_pylist()
        begin = end
    give_back()


def grams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words (runs over text borders included)."""
    count = max(0, len(hashes) - n + 1)
    out = np.full(count, salt, U64)
    for j in range(n):
        out = out * U64(0x9E3779B97F4A7C15) + hashes[j : j + count]
        out ^= out >> U64(29)
    return mix(out)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all shingles of ``n`` words; a text of 1 to n-1 words has one shingle, all of it."""
    size = np.diff(words.first)
    every = grams(words.hash, n)
    ok = words.doc[: len(every)] == words.doc[n - 1 :] if len(every) else np.zeros(0, bool)
    value, doc = every[ok], words.doc[: len(every)][ok]
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        extra = np.array([grams(words.hash[words.first[d] : words.first[d + 1]], int(size[d]), salt=int(size[d]))[0] for d in short], U64)
        value, doc = np.concatenate([value, extra]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        value, doc = value[order], doc[order]
    return value, doc
