"""Reproducible draws that any SQL engine can repeat: the first 32 bits of an md5."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts) -> Column:
    """A whole number below 2 ** 32 from the parts joined by |."""
    columns = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in columns])), 1, 8), 16, 10).cast("long")


def draw_sql(*parts: str) -> str:
    """The same in DuckDB; parts are SQL expressions."""
    joined = " || '|' || ".join(f"({p})::varchar" for p in parts)
    return f"('0x' || substr(md5({joined}), 1, 8))::bigint"


#: Numbers hashed at a time: what a round of md5 works on stays in a core's cache.
HASHED = 1 << 14
_SHIFTS = [n for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for n in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _block(state: list[np.ndarray], words: list[np.ndarray]) -> list[np.ndarray]:
    """md5's state after one more block of 16 words; arrays of uint32 that broadcast to one shape."""
    a, b, c, d = state
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f = f + a + (words[g] + np.uint32(_SINES[i]))
        turned = f >> np.uint32(32 - _SHIFTS[i])
        f <<= np.uint32(_SHIFTS[i])
        f |= turned
        a, b, c, d = d, b + f, b, c
    return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


def _runs(numbers: range, most: int) -> Iterator[range]:
    """Pieces of at most `most` numbers with as many digits each."""
    at = numbers.start
    while at < numbers.stop:
        end = min(numbers.stop, at + most, 10 ** len(str(at)))
        yield range(at, end)
        at = end


def _digits(numbers: range, width: int, at: int) -> np.ndarray:
    """(len(numbers), width) bytes that hold the numbers' digits from place `at` on."""
    n = len(str(numbers.start))
    out = np.zeros((len(numbers), width), np.uint8)
    out[:, at : at + n] = np.arange(numbers.start, numbers.stop)[:, None] // 10 ** np.arange(n - 1, -1, -1) % 10 + 48
    return out


def draws(seed: str, b: range, j: range) -> np.ndarray:
    """draw(seed, b, j) of all numbers b (rows) and j (columns), in numpy: many at a time, so that one takes a
    fourth of the time of a call for each."""
    out = np.empty((len(b), len(j)), np.uint32)
    head = f"{seed}|".encode()
    for js in _runs(j, HASHED):
        for bs in _runs(b, max(1, HASHED // len(js))):
            middle = len(head) + len(str(bs.start))
            n = middle + 1 + len(str(js.start))
            width = (n + 9 + 63) // 64 * 64
            tail = np.zeros(width, np.uint8)
            tail[: len(head)], tail[middle], tail[n] = np.frombuffer(head, np.uint8), 124, 128
            tail[-8:] = np.frombuffer((8 * n).to_bytes(8, "little"), np.uint8)
            rows, columns = (_digits(bs, width, len(head)) | tail).view("<u4"), _digits(js, width, middle + 1).view("<u4")
            words = [rows[:, i, None] | columns[None, :, i] if columns[:, i].any() else rows[:, i, None] for i in range(width // 4)]
            state = [np.full((1, 1), x, np.uint32) for x in _START]
            for i in range(0, len(words), 16):
                state = _block(state, words[i : i + 16])
            out[bs.start - b.start : bs.stop - b.start, js.start - j.start : js.stop - j.start] = state[0].byteswap()
    return out
