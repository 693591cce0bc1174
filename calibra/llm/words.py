"""Words, lines and hashes of many texts at once, over the UTF-8 bytes that Arrow already holds.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64 bits wide: a random
odd-base polynomial over the bytes, then a non-linear finisher, so equal words have equal hashes on
every executor and in every run.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
GRAM_BASE = 0xD1342543DE82EF95
CHUNK_BYTES = 1 << 20


def process_store() -> dict:
    """A dictionary that lives as long as this Python process and never travels with a function."""
    return sys.modules.setdefault("_calibra_process", types.ModuleType("_calibra_process")).__dict__.setdefault("store", {})


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept in the process up to a few chunks' length."""
    kept = process_store()
    have = kept.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 4096)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK_BYTES:
            kept[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each (one more than texts); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about `size` bytes of text, so that working arrays stay small; whole rows always."""
    if batch.num_rows == 0:
        return
    _, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    """Words of several texts: byte ranges, the text each is in, and each text's range of words."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # text -> its first word; one more than texts

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return range_hashes(self.data, self.start, self.end)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash for each byte range."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power = powers(BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    back = powers(pow(BASE, -1, 1 << 64), len(data) + 1)
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64) * np.uint64(GRAM_BASE))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def words(column, lower: bool = False) -> Words:
    data, offsets = utf8(column)
    if lower:
        data = lower_ascii(data)
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    inside = ~space[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[tails] = inside[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def gram_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """A hash for the k words from each position on (len - k + 1 of them); texts are not told apart."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k <= 8:
        total = word[:n] * np.uint64(1)
        for j in range(1, k):
            total = total * np.uint64(GRAM_BASE) + word[j : j + n]
    else:
        power = powers(GRAM_BASE, len(word) + 1)
        sums = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(word * power[:-1], out=sums[1:])
        total = (sums[k:] - sums[:-k]) * powers(pow(GRAM_BASE, -1, 1 << 64), len(word) + 1)[:n]
    return mix(total + np.uint64(k))


def grams_within(first: np.ndarray, k: int) -> np.ndarray:
    """Word positions from which k words lie in one text."""
    lengths = np.diff(first)
    count = np.maximum(lengths - k + 1, 0)
    total = int(count.sum())
    before = np.cumsum(count) - count
    return np.arange(total) - np.repeat(before, count) + np.repeat(first[:-1], count)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of the w values from each position on (len - w + 1 of them)."""
    if len(x) < w:
        return x[:0]
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and each text's range of them.

    A text of fewer than k words, but at least one, has its whole sequence as its one shingle.
    """
    hashes = w.hashes()
    at = grams_within(w.first, k)
    value = gram_hashes(hashes, k)[at] if len(at) else np.zeros(0, np.uint64)
    doc = w.doc[at]
    lengths = np.diff(w.first)
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    if len(short):
        extra = [gram_hashes(hashes[w.first[d] : w.first[d + 1]], int(lengths[d]))[0] for d in short]
        value, doc = np.concatenate([value, np.array(extra, np.uint64)]), np.concatenate([doc, short])
    if len(short):
        order = np.argsort(doc, kind="stable")
        value, doc = value[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(len(lengths) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        value[a:b].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(lengths) + 1))
