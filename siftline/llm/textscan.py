"""Vectorised word scanning of Arrow text columns.

Words are maximal runs of ASCII letters, digits and non-ASCII bytes of the
lower-cased text; each gets a 64-bit hash. All work is numpy over the column's
UTF-8 buffer, in slices of bounded size, so memory does not follow the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Inverse of _MULT modulo 2**64.
_INVERSE = np.uint64(pow(int(_MULT), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def tidy(run: Callable) -> Callable:
    """``run`` of mapInArrow; a worker that is kept for later tasks gives what it freed back to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


class _Powers:
    """Powers of a multiplier, grown as longer slices come."""

    def __init__(self, base: np.uint64):
        self.base, self.values = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            steps = np.full(n, self.base, np.uint64)
            steps[0] = 1
            self.values = np.cumprod(steps, dtype=np.uint64)
        return self.values


_POWERS, _BACK = _Powers(_MULT), _Powers(_INVERSE)


@dataclass
class Words:
    """Words of consecutive rows: ``first[i]:first[i + 1]`` are those of row ``i``."""

    row0: int
    first: np.ndarray
    hashes: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)


def scan_words(texts: pa.Array | pa.ChunkedArray) -> Iterator[Words]:
    """Hash the words of every row; null texts have none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(offsets, offsets[begin] + SLICE_BYTES, "right")) - 1
        end = min(max(end, begin + 1), len(texts))
        yield _scan(texts.slice(begin, end - begin), begin)
        begin = end


def _scan(texts: pa.Array, row0: int) -> Words:
    texts = pc.utf8_lower(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or offsets[0] == offsets[-1]:
        return Words(row0, np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint64))
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS.upto(len(data))[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _BACK.upto(len(data))[starts])
    return Words(row0, np.searchsorted(starts, bounds).astype(np.int64), hashes)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, position) of every run of ``width`` words.

    A row with fewer words, but at least one, has a single shingle of them all.
    """
    n = words.counts
    own = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    rows = np.repeat(np.arange(words.rows), own)
    first = np.concatenate(([0], np.cumsum(own)))
    at = np.arange(first[-1]) - first[rows]
    word = words.first[rows] + at
    out = np.zeros(len(rows), np.uint64)
    short = n[rows] < width
    padded = np.concatenate((words.hashes, np.zeros(width, np.uint64)))
    for k in range(width):
        term = padded[word + k]
        if short.any():
            term = np.where(short & (k >= n[rows]), np.uint64(0), term)
        out = (out + term) * _MULT + np.uint64(k + 1)
    return mix(out), rows, at


def label_occurrences(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Make equal keys of one row distinct: the n-th occurrence gets label n."""
    both = mix(keys ^ (rows.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    ordered = np.sort(both)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return keys
    where = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, both), len(twice) - 1)] == both)
    order = where[np.argsort(both[where], kind="stable")]
    values = both[order]
    begins = np.concatenate(([True], values[1:] != values[:-1]))
    nth = np.arange(len(order)) - np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))
    out = keys.copy()
    late = nth > 0
    out[order[late]] = mix(keys[order[late]] + nth[late].astype(np.uint64) * _MULT)
    return out


def digest128(words: Words) -> np.ndarray:
    """16 bytes for each row's word sequence; rows of equal words have equal bytes."""
    place = np.arange(len(words.hashes)) - np.repeat(words.first[:-1], words.counts)
    out = np.zeros((words.rows, 2), np.uint64)
    some = words.counts > 0
    for k, salt in enumerate((0x2545F4914F6CDD1D, 0xA0761D6478BD642F)):
        terms = mix(words.hashes * np.uint64(salt) + place.astype(np.uint64) * _MULT)
        out[some, k] = np.add.reduceat(terms, words.first[:-1][some]) if some.any() else 0
    out[:, 0] += words.counts.astype(np.uint64)
    return mix(out)
