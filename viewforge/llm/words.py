"""Words and rolling hashes of Arrow text columns, by numpy on the raw UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time, so that the eight times larger arrays stay in cache. A longer document is taken whole.
BLOCK_BYTES = 1 << 18
#: Documents that are hashed at a time, for arrays with a row per document.
BLOCK_ROWS = 1 << 12
#: An odd multiplier of the rolling hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_RANDOM = np.random.Generator(np.random.PCG64(20_240))
_BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """A boolean for each byte: whether it lies in one of the ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of words that end at ASCII white space.
NOT_BLANK = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words of ASCII letters and digits and of everything beyond ASCII.
ALPHANUMERIC = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class _Powers:
    def __init__(self, base: int) -> None:
        self.base, self.known = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            steps = np.full(max(n, 2 * len(self.known)), self.base)
            steps[0] = 1
            self.known = np.multiply.accumulate(steps)
        return self.known[:n]


_UP, _DOWN = _Powers(BASE), _Powers(INVERSE)


def mixed(h: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rabin-Karp hash of ``values[start:end]`` for each pair, from one prefix sum."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _UP.upto(len(values)), out=total[1:])
    return mixed((total[ends] - total[starts]) * _DOWN.upto(len(values) + 1)[starts])


@dataclass
class Words:
    """Words of some documents: document ``i`` has those from ``first[i]`` to ``first[i + 1]``."""

    rows: slice
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words inside a document, the word they start at, and each document's first run.

        With ``short`` a document of fewer words, but not none, is one run.
        """
        counts = self.counts
        runs = np.maximum(counts - n + 1, 0)
        if short:
            runs = np.where((counts > 0) & (counts < n), 1, runs)
        first = np.concatenate(([0], np.cumsum(runs)))
        starts = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], runs)
        ends = np.minimum(starts + n, np.repeat(self.first[1:], runs)) if short else starts + n
        return rolled(self.hashes, starts, ends), starts, first


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8), offsets.astype(np.int64)


def word_blocks(column: pa.Array, inside: np.ndarray = NOT_BLANK, change: np.ndarray | None = None) -> Iterator[Words]:
    """Hashed words of the documents, some documents at a time."""
    data, offsets = buffers(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1)
        end = min(end, row + BLOCK_ROWS)
        text = data[offsets[row] : offsets[end]]
        bounds = offsets[row : end + 1] - offsets[row]
        yield _hashed(slice(row, end), text if change is None else change[text], bounds, inside)
        row = end


def _hashed(rows: slice, text: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> Words:
    part = np.zeros(len(text) + 2, bool)
    part[1:-1] = inside[text]
    opens, closes = part[1:-1] & ~part[:-2], part[1:-1] & ~part[2:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(text))]
    opens[cuts] |= part[1:-1][cuts]
    closes[cuts - 1] |= part[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(rows, rolled(_BYTE_VALUES[text], starts, ends), np.searchsorted(starts, bounds))
