"""Words of whole texts as numpy arrays, taken from the buffers of Arrow batches.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. Word hashes are 64-bit
polynomials of the word's own bytes, so they do not depend on where a word stands, on the batch or
on the process. Work is done in slices of whole texts of about ``SLICE_BYTES``, which bounds memory
by the slice or by one text, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space and ASCII punctuation, for operators that look at words without their punctuation.
SPACE_AND_MARKS = _SPACE.copy()
SPACE_AND_MARKS[[b for b in range(128) if not chr(b).isalnum()]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_EXACT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
_BYTES = _EXACT.copy()
_BYTES[65:91] = _BYTES[97:123]


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of consecutive texts; those of text ``i`` are ``offsets[i]:offsets[i + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its texts; a null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text stands alone."""
    limit = limit or SLICE_BYTES
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def slices_of(batch: pa.RecordBatch, column: str, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch cut into row slices by the bytes of one text column."""
    if batch.num_rows:
        _, offsets = text_buffer(batch.column(column))
        for low, high in row_slices(offsets, limit):
            yield batch.slice(low, high - low)


def word_table(column: pa.Array, space: np.ndarray = _SPACE, folded: bool = True) -> Words:
    """Words of the texts of a column; without ``folded``, upper and lower case differ."""
    data, text_offsets = text_buffer(column)
    n = len(data)
    inside = np.zeros(n + 2, bool)
    np.logical_not(space[data], out=inside[1 : n + 1])
    # Starts and ends of words, with every border between texts taken as a space as well.
    edge = np.zeros(n + 1, bool)
    edge[text_offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    up, down = _power_table(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTES if folded else _EXACT)[data] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(data, starts, ends, np.searchsorted(starts, text_offsets), hashes)


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive words, across texts as well."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.uint64)
    up, down = _power_table(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mix((sums[length:] - sums[: n - length + 1]) * down[: n - length + 1] + np.uint64(length))


def runs(values: np.ndarray) -> np.ndarray:
    """Start of each run of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def sum_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups, empty ones included."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
