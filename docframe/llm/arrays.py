"""Vectorised word splitting and rolling hashes over Arrow batches of texts.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09``-``\\x0D``; texts are hashed as UTF-8.
Batches are cut into slices of about ``SLICE_BYTES`` so that the arrays of one slice stay small however
large a batch is; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000
SLICE_TEXTS = 20_000
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASES = (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i in 0..n-1."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 4096)
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            tables.append(np.cumprod(p, dtype=np.uint64))
        have = tables[0], tables[1]
        if size <= 2 * SLICE_BYTES:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hashes of ``values[starts:ends]``: prefix sums of ``value * base**i`` shifted back to 0."""
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _powers(base, len(values) + 1)
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], dtype=np.uint64, out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


@dataclass
class Texts:
    """A slice of texts: all bytes, the offset of every text, and its words once asked for."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Texts:
        return Texts(_LOWER[self.data], self.offsets)

    def pieces(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of ``inside`` that do not cross texts: starts, ends, first run of every text."""
        if len(inside) == 0:
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(len(self.offsets), dtype=np.int64)
        before = np.zeros(len(inside), dtype=bool)
        before[1:] = inside[:-1]
        edges = self.offsets[:-1][self.offsets[:-1] < len(inside)]
        before[edges] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), dtype=bool)
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.pieces(~SPACE[self.data])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges."""
        return rolling(self.data.astype(np.uint64) + np.uint64(1), starts, ends, _BYTE_BASE)


def text_slices(column: pa.Array | pa.ChunkedArray, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """``(first row, row after the last, Texts)`` of consecutive slices; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return
    _, offsets_at, data_at = column.buffers()
    offsets = np.frombuffer(offsets_at, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_at, dtype=np.uint8) if data_at is not None and data_at.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + slice_bytes, side="right")) - 1)
        j = min(j, n, i + SLICE_TEXTS)
        yield i, j, Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def windows(values: np.ndarray, first: np.ndarray, size: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` values inside one text.

    ``first`` holds the first value of every text. Returns the start (index into ``values``) and hash of
    each window, and the first window of every text.
    """
    starts, offsets = window_starts(first, size)
    return starts, rolling(values, starts, starts + size, base), offsets


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every run of ``size`` values inside one text, and the first window of every text."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    return np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], counts), offsets


def owners(offsets: np.ndarray) -> np.ndarray:
    """Index of the text that every element belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
