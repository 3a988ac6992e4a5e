"""Vectorised words, hashes and shingles over Arrow string arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D, so every other
Unicode character belongs to words. All functions work on whole texts of a batch at
once; nulls count as empty texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers of the two hash functions
SLICE_BYTES = 2 << 20  # of text that is hashed at once; one longer text is hashed alone
LONG_WORD = 64  # bytes; longer words are hashed by BLAKE2b, 64 bits of it for each function


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], _U)


class Words:
    """The words of a batch: byte spans, the text each is from, and hashes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.bounds = bounds
        n = len(self.data)
        inside = np.zeros(n + 2, bool)
        np.take(_IS_WORD, self.data, out=inside[1 : n + 1])
        fresh = np.zeros(n + 1, bool)  # a text starts here
        fresh[bounds] = True
        here, before = inside[1:], inside[:-1]
        self.start = np.flatnonzero(here & (~before | fresh))
        self.end = np.flatnonzero(before & (~here | fresh))
        self.first = np.searchsorted(self.start, bounds)  # word number at each text's start
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(bounds) - 1), self.count)

    def hashes(self, k: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes: every eight bytes are mixed into it, the length too."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        size, odd = self.end - self.start, _U(_ODD[k])
        out = mix(((eight[self.start] & _LOW_BYTES[np.minimum(size, 8)]) + size.astype(_U) * _U(_ODD[1 - k])) * odd)
        for at in range(8, LONG_WORD, 8):
            more = np.flatnonzero(size > at)
            if not len(more):
                break
            block = eight[self.start[more] + at] & _LOW_BYTES[np.minimum(size[more] - at, 8)]
            out[more] = mix((out[more] ^ block) * odd)
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            digest = hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=16).digest()
            out[i] = int.from_bytes(digest[8 * k : 8 * k + 8], "little")
        return out

    def grams(self, n: int, k: int = 0, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n consecutive words within one text, and the number of the first word of each."""
        h = self.hashes(k) if hashes is None else hashes
        at = np.flatnonzero(self.first[self.text + 1] - np.arange(len(h)) >= n) if len(h) else np.zeros(0, np.int64)
        return rolled(h, n, k)[at], at


def rolled(h: np.ndarray, n: int, k: int = 0) -> np.ndarray:
    """At i, a hash of h[i:i+n] in its order, mixed at each doubling of the width; entries whose span leaves h are meaningless."""

    def joined(a: np.ndarray, width: int, b: np.ndarray) -> np.ndarray:
        out, m = a.copy(), max(0, len(a) - width)
        out[:m] = mix(a[:m] * _U(_ODD[k]) + b[len(b) - m :])
        return out

    power, width, out, done = h, 1, None, 0
    while True:
        if n & width:
            out, done = (power if out is None else joined(out, done, power)), done + width
        if 2 * width > n:
            return out
        power, width = joined(power, width, power), 2 * width


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an array, and where each starts and the last ends."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    bounds = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with about size bytes of text: rows, bytes and bounds. Every row is in one part."""
    data, bounds = raw(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, len(batch)
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1)
        yield batch.slice(at, to - at), data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to
