"""Vectorised scanning of UTF-8 text in Arrow batches with numpy.

A batch is cut into chunks of a bounded number of bytes; in a chunk, words and n-grams of all
documents are found and hashed together, without a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: Letters, digits and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x41:0x5B] = WORD[0x61:0x7B] = True
WORD[0x80:] = True

#: Everything but the six ASCII white-space characters.
TOKEN = np.ones(256, bool)
TOKEN[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    _, offset_buffer, data_buffer = column.buffers()
    if n == 0 or offset_buffer is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8)[offsets[0] : offsets[-1]] if data_buffer is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end document, bytes, offsets) of runs of documents of about ``limit`` bytes; one document is never cut."""
    n, first = len(offsets) - 1, 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of bytes of ``kind`` inside a document."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = kind[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1]
    before[edges[edges < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    tails = offsets[1:]
    after[tails[tails > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        up, down = np.full(size, _MULTIPLIER, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        tables = np.cumprod(up), np.cumprod(down)
        if size > 4 * CHUNK_BYTES:  # a single huge document: not worth holding
            return tables
        _powers = tables
    return _powers


class Hasher:
    """Hashes of any byte ranges of one chunk, in constant time each."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self.down = _power_tables(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data] * up[:n], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = self.sums[ends] - self.sums[starts]
        out *= self.down[starts]
        return mix(out)

    def grams(self, n: int) -> np.ndarray:
        """Hash of the ``n`` bytes from each position at which there are as many."""
        m = len(self.sums) - 1 - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        out = self.sums[n : n + m] - self.sums[:m]
        out *= self.down[:m]
        return mix(out)


    def gram_buckets(self, n: int, bits: int) -> np.ndarray:
        """``grams`` reduced to ``bits`` bits by a multiplication, with another factor for each ``n``."""
        m = len(self.sums) - 1 - n + 1
        if m <= 0:
            return np.zeros(0, np.int32)
        out = self.sums[n : n + m] - self.sums[:m]
        out *= self.down[:m]
        out ^= out >> np.uint64(29)
        out *= np.uint64((0xBF58476D1CE4E5B9 + 2 * n) & (2**64 - 1))
        out >>= np.uint64(64 - bits)
        return out.astype(np.int32)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_grams(words: np.ndarray, docs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every run of ``n`` words; a shorter document is one run of all its words."""
    if len(words) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(words) - n + 1
    out = gram_docs = None
    if m > 0:
        whole = docs[:m] == docs[n - 1 :]
        at = np.flatnonzero(whole)
        out = words[at].copy()
        for i in range(1, n):
            out *= np.uint64(0x100000001B3)
            out += words[at + i]
        out, gram_docs = mix(out), docs[at]
    first = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    count = np.diff(np.r_[first, len(docs)])
    short = count < n
    if short.any():
        extra, extra_docs = [], []
        for f, c in zip(first[short], count[short], strict=True):
            h = words[f]
            with np.errstate(over="ignore"):
                for i in range(1, c):
                    h = h * np.uint64(0x100000001B3) + words[f + i]
            extra.append(h)
            extra_docs.append(docs[f])
        extra = mix(np.array(extra, np.uint64) ^ np.uint64(0x5BD1E995))
        if out is None:
            return extra, np.array(extra_docs, np.int64)
        out, gram_docs = np.r_[out, extra], np.r_[gram_docs, np.array(extra_docs, np.int64)]
        order = np.argsort(gram_docs, kind="stable")
        out, gram_docs = out[order], gram_docs[order]
    if out is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return out, gram_docs
