"""Word hashing over whole Arrow batches with numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D, so words are the same in UTF-8 as in code points.
Hashes are polynomials modulo 2**64 over random byte values, finished by an avalanche step; the same word has the same
hash in every task, at every size of input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE, _STEP = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)
#: Bytes of text that are hashed at a time; a longer document is a chunk of its own. A worker holds some 100 times as much in arrays.
CHUNK_BYTES = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64. Those for one chunk are kept; a longer text has its own, which go with it."""

    KEPT = CHUNK_BYTES + (1 << 12)

    def __init__(self, base: np.uint64):
        self.base, self.kept = base, None

    def _made(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        up, down = np.full(n, self.base, U), np.full(n, _inverse(int(self.base)), U)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.KEPT:
            return self._made(n)
        if self.kept is None:
            self.kept = self._made(self.KEPT)
        return self.kept


_bytes, _words = _Powers(_BASE), _Powers(_STEP)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
VALUE = mix(np.arange(1, 257, dtype=U) * _STEP)
LOWER_VALUE = VALUE.copy()
LOWER_VALUE[65:91] = VALUE[97:123]


class Chunk:
    """Words of some documents. first[d]:first[d+1] are the words of document d; hash, start and end are by word."""

    def __init__(self, texts: list[bytes | None], lower: bool, space: np.ndarray = SPACE):
        self.texts = [t or b"" for t in texts]
        self.data = b"\n".join([*self.texts, b""])
        buf = np.frombuffer(self.data, np.uint8)
        blank = space[buf]
        edge = np.empty(len(buf), bool)
        edge[:1] = ~blank[:1]
        np.not_equal(blank[1:], blank[:-1], out=edge[1:])
        at = np.flatnonzero(edge)
        self.start, self.end = at[0::2], at[1::2]  # a chunk ends with a separator, so edges pair up
        up, down = _bytes.get(len(buf) + 1)
        sums = np.empty(len(buf) + 1, U)
        sums[0] = 0
        np.cumsum((LOWER_VALUE if lower else VALUE)[buf] * up[: len(buf)], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in self.texts), np.int64, len(self.texts)))
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)
        self.count = np.diff(self.first)
        m = len(self.hash)
        up, self._down = _words.get(m + 1)
        self._sums = np.empty(m + 1, U)
        self._sums[0] = 0
        np.cumsum(self.hash * up[:m], out=self._sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words start to end (not included), for each pair."""
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(U))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, hash) of every run of k words inside one document."""
        counts = np.maximum(self.count - k + 1, 0)
        doc = np.repeat(np.arange(len(counts)), counts)
        word = np.arange(len(doc)) + np.repeat(self.first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        return doc, word, self.span(word, word + k)


def chunks(texts: pa.Array, lower: bool = False, most: int = 4000, space: np.ndarray = SPACE) -> Iterator[tuple[int, Chunk]]:
    """(first row, Chunk) for successive rows of a string column."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(ends):
        end = min(at + most, max(at + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, side="right"))))
        # Only this chunk's texts become Python objects.
        yield at, Chunk(texts.slice(at, end - at).cast(pa.binary()).to_pylist(), lower, space)
        at, before = end, int(ends[end - 1])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(signed(x) if x.dtype == U else x.astype(np.int64, copy=False), pa.int64())
