"""Vectorised text helpers for tasks: Arrow text columns as byte arrays, words and word n-grams as 64-bit hashes.

A word is a maximal run of ASCII letters, digits and non-ASCII characters; ASCII letters are
lower-cased. Null texts are empty. Hashes are the same in every process and on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _IS_WORD[_low:_high] = True
_NGRAM = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64) | np.uint64(1)


class Words(NamedTuple):
    """Words of some rows: hash by word, and where each row's words start (one more entry than rows)."""

    hashes: np.ndarray
    bounds: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse, as far as they were needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n + 1:
            m = max(n + 1, CHUNK_BYTES + 1)
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                table = np.full(m, base, np.uint64)
                table[0] = 1
                setattr(cls, name, np.multiply.accumulate(table))
        return cls.up, cls.down


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    text = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = text.buffers()
    bounds = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(bounds: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer row is a range of its own. Rows are never cut."""
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def words(raw: np.ndarray, bounds: np.ndarray) -> Words:
    """Hashes of all words, row by row."""
    n = len(raw)
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64))
    inside = _IS_WORD[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = bounds[:-1]
    cuts = cuts[cuts < n]
    begins[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = bounds[1:] - 1
    last = last[(last >= 0)]
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _Powers.upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(hashes, np.searchsorted(start, bounds).astype(np.int64))


def ngrams(found: Words, n: int) -> Words:
    """Hashes of all n consecutive words of a row; rows with fewer words have none."""
    h, bounds = found
    count = np.diff(bounds)
    per_row = np.maximum(count - n + 1, 0)
    out_bounds = np.concatenate([[0], np.cumsum(per_row)]).astype(np.int64)
    at = np.repeat(bounds[:-1] - out_bounds[:-1], per_row) + np.arange(out_bounds[-1])
    total = np.full(len(at), n, np.uint64)
    for k in range(n):
        total = total * np.uint64(0x9FB21C651E98DF25) + h[at + k] * _NGRAM[k % len(_NGRAM)]
    return Words(mix(total), out_bounds)
