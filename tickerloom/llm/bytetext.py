"""Texts of an Arrow batch as one byte array, and whole-array passes over it.

Every function works on a chunk of some megabytes of text, so its memory is
bounded by the chunk (or by the longest single text), not by the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 1024
SEGMENT = 1 << 20
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))
    if lower:
        values[65:91] = values[97:123]
    return values


BYTES = {False: _byte_values(False), True: _byte_values(True)}


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; sizes are rounded up so that few are kept."""
    return _powers(base, 1 << max(20, int(n - 1).bit_length()))[:n]


class Texts:
    """``data`` holds the UTF-8 bytes of all texts end to end; text i is ``data[at[i]:at[i + 1]]``; null is empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        self.at = offsets - offsets[0]
        self.n = len(column)

    def bytes(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()

    def code_points(self) -> np.ndarray:
        """Code points of each text."""
        return sums((self.data & 0xC0) != 0x80, self.at)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between each two neighbours of ``at``; 0 for an empty stretch."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def counts(positions: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the ascending ``positions`` fall into each stretch of ``at``."""
    return np.diff(np.searchsorted(positions, at))


class Words:
    """Maximal runs of bytes other than space and tab to carriage return, none across two texts.

    ``start``, ``end``: places in ``texts.data``; ``per_text``: words of each
    text; ``first``: index of a text's first word; ``key``: 64-bit hash.
    """

    def __init__(self, texts: Texts, lower: bool = False):
        data, at = texts.data, texts.at
        gap = SPACE[data]
        begins = ~gap
        begins[1:] &= gap[:-1]
        inner = at[(at > 0) & (at < len(data))]
        begins[inner] = ~gap[inner]
        ends = ~gap
        ends[:-1] &= gap[1:]
        ends[inner - 1] = ~gap[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)
        self.per_text = np.diff(self.first)
        self.first = self.first[:-1]
        self.key = hash_runs(data, self.start, gap, lower)

    def __len__(self) -> int:
        return len(self.start)


def hash_runs(data: np.ndarray, start: np.ndarray, skipped: np.ndarray | None = None, lower: bool = False) -> np.ndarray:
    """Hash of the bytes from each start to the next one, ``skipped`` bytes left out at the end of a run."""
    out = np.zeros(len(start), np.uint64)
    # About SEGMENT bytes at a time: the numbers take eight times the room of the bytes.
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(start, start[first] + SEGMENT)))
        a, b = int(start[first]), int(start[last]) if last < len(start) else len(data)
        values = BYTES[lower][data[a:b]]
        if skipped is not None:
            values[skipped[a:b]] = 0
        values *= powers(_MULT, b - a)
        here = start[first:last] - a
        out[first:last] = mix(np.add.reduceat(values, here) * powers(_INV, b - a)[here])
        first = last
    return out


def windows(words: Words, width: int, short_as_one: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` neighbouring words of one text, their texts, and the index of their first word.

    ``short_as_one``: a text with 1 to ``width`` - 1 words gives its whole sequence as one.
    """
    n, total = words.per_text, len(words)
    text_of = np.repeat(np.arange(len(n)), n)
    # Words left in the text from each word on, itself included.
    left = np.repeat(words.first + n, n) - np.arange(total)
    out = np.zeros(total, np.uint64)
    for k in range(width):
        out[: total - k] += words.key[k:] * np.uint64(pow(_MULT, k + 1, 1 << 64)) if k < total else 0
    full = np.flatnonzero(left >= width)
    keys, texts, index = mix(out[full]), text_of[full], full
    if short_as_one:
        short = np.flatnonzero((n > 0) & (n < width))
        if len(short):
            own = np.zeros(len(short), np.uint64)
            for k in range(width - 1):
                has = n[short] > k
                own[has] += words.key[words.first[short[has]] + k] * np.uint64(pow(_MULT, k + 1, 1 << 64))
            keys = np.concatenate((keys, mix(own ^ mix(n[short].astype(np.uint64)))))
            texts, index = np.concatenate((texts, short)), np.concatenate((index, words.first[short]))
    return keys, texts, index


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``limit`` bytes of text and ``rows`` rows; a longer text comes alone."""
    texts = batch.column(column)
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    i, n = 0, batch.num_rows
    while i < n:
        j = int(np.searchsorted(ends, ends[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), i + rows, n)
        yield batch.slice(i, j - i)
        i = j
