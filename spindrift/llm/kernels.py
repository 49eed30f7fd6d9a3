"""Vectorised text kernels over Arrow string columns.

All of them work on whole Arrow batches with numpy: no Python loop runs over words, and only slices of about
``SLICE_BYTES`` are expanded at once, so that memory does not depend on the batch (one document is never cut).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U = np.uint64


def _mask(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)], dtype=bool)


#: Word bytes of the two tokenisations; bytes over 0x7F are parts of UTF-8 sequences and belong to words in both.
SPACED = _mask(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
ALNUM = _mask(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)

_M1, _M2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BYTE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(1 << 16, 1 << (max(n, 2) - 1).bit_length()), base, dtype=np.uint64)
        x[0] = 1
        have = _powers[base] = np.multiply.accumulate(x)
    return have[:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about SLICE_BYTES."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE_BYTES, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


class Words:
    """Words of some texts: starts and ends (bytes), row_at (index of each row's first word, and the total), 64-bit hashes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, table: np.ndarray = SPACED, lower: bool = False, hashes: bool = True):
        inside = table[data]
        before = np.empty_like(inside)
        if len(inside):
            before[0] = False
            before[1:] = inside[:-1]
            before[offs[:-1][offs[:-1] < len(inside)]] = False
        after = np.empty_like(inside)
        if len(inside):
            after[-1] = False
            after[:-1] = inside[1:]
            ends = offs[1:] - 1
            after[ends[ends >= 0]] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.row_at = np.searchsorted(self.starts, offs)
        self.hash = None
        if hashes:
            raw = data[inside]
            if lower:
                raw = LOWER[raw]
            lens = self.ends - self.starts
            at = np.cumsum(lens) - lens
            rel = np.arange(len(raw)) - np.repeat(at, lens)
            value = _BYTE[raw]
            if len(raw):
                value *= powers(_M1, int(lens.max()))[rel]
                self.hash = mix(np.add.reduceat(value, at) + lens.astype(np.uint64))
            else:
                self.hash = np.zeros(0, dtype=np.uint64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.row_at)


def window_hashes(hashes: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """Hash of each run of `size` words of the flat array (also of runs that cross rows: see in_row)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    base = _M2 if second else _M1
    back = pow(base, -1, 1 << 64)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(base, len(hashes)), out=total[1:])
    out = total[size:] - total[:-size]
    out *= powers(back, n)
    return mix(out + U(size))


def in_row(row_at: np.ndarray, size: int) -> np.ndarray:
    """Starts (in the flat array) of the windows that lie in one row."""
    n = int(row_at[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    ok = np.ones(n, dtype=bool)
    # A window that starts less than `size` before a row's end runs into the next row.
    for back in range(1, size):
        x = row_at[1:] - back
        ok[x[(x >= 0) & (x < n) & (x >= row_at[:-1])]] = False
    return np.flatnonzero(ok)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def lists(values: pa.Array, at: np.ndarray) -> pa.Array:
    """A list column whose row i holds values[at[i]:at[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(at, type=pa.int32()), values)
