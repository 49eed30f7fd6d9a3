"""Bit tables of fixed width over 64-bit hashes, built by Spark and small enough to broadcast at any input size.

A table of 2 ** bits cells takes 2 ** bits / 8 bytes, whatever is put into it: this is the proven bound of everything that
the operators broadcast. A full table lets more rows pass; the exact step after it removes them, so results never depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import mix

U = np.uint64


def cell(column: Column, bits: int) -> Column:
    """The cell of a hash: its highest bits."""
    return F.shiftrightunsigned(column, 64 - bits)


def cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> U(64 - bits)).astype(np.int64)


def broadcast_cells(marked: DataFrame, column: str, bits: int) -> Broadcast:
    """Broadcasts the table in which the cells of `column` (longs from 0) are set. 2 ** bits / 8 bytes pass the driver at most."""
    at = F.col(column) + F.lit(1)
    rows = (
        marked.groupBy(F.bitmap_bucket_number(at).alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
        .toArrow()
    )
    table = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for block, raw in zip(rows["block"].to_pylist(), rows["bits"].to_pylist(), strict=True):
        part = np.frombuffer(raw, dtype=np.uint8)
        room = table[(block - 1) * 4096 : block * 4096]
        room[:] = part[: len(room)]
    return marked.sparkSession.sparkContext.broadcast(table.tobytes())


def probe(table: bytes, at: np.ndarray) -> np.ndarray:
    """Which of the cells are set."""
    return (np.frombuffer(table, dtype=np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class PartSketch:
    """A task's count-min sketch of two rows of 2 ** bits cells, kept sparse; counts stop at 2, all that is asked of them.

    It is written in blocks of 2 ** 16 cells: a row holds the places of one block's cells as sorted 16-bit numbers, a cell of two or more twice.
    Spark adds the tasks' sketches up block by block (see broadcast_seen_twice).
    """

    SCHEMA = "block int, places binary"

    def __init__(self, bits: int, most: int = 2_000_000):
        self.bits, self.most, self.held, self.n = bits, most, [], 0

    def add(self, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.extend(two_cells(hashes, self.bits))
        self.n += 2 * len(hashes)
        if self.n > self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            cell = np.concatenate(self.held).astype(np.uint32)
            cell.sort()
            third = np.zeros(len(cell), dtype=bool)
            third[2:] = cell[2:] == cell[:-2]
            cell = cell[~third]
            block = cell >> np.uint32(16)
            at = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            ends = 2 * np.append(at, len(cell)).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer((cell & np.uint32(0xFFFF)).astype("<u2"))])
            yield pa.RecordBatch.from_arrays([pa.array(block[at].astype(np.int32)), packed], names=["block", "places"])
        self.held, self.n = [], 0


def two_cells(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return cells(hashes, bits), cells(mix(hashes ^ U(0x5851F42D4C957F2D)), bits) + (1 << bits)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by block: one row a block, with a bit for each cell that counts two or more. Only one block's cells are held at a time."""

    def made(block: int, counts: np.ndarray) -> pa.RecordBatch:
        bits = np.packbits(counts >= 2, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([block], type=pa.int32()), pa.array([bits], type=pa.binary())], names=["block", "bits"])

    now, counts = None, np.zeros(1 << 16, dtype=np.uint8)
    for batch in batches:
        for block, places in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if block != now:
                if now is not None:
                    yield made(now, counts)
                now = block
                counts[:] = 0
            at = np.frombuffer(places.as_buffer(), dtype="<u2")
            again = at[1:][at[1:] == at[:-1]]
            counts[at] = np.minimum(counts[at] + 1, 2)
            counts[again] = 2
    if now is not None:
        yield made(now, counts)


def broadcast_seen_twice(sketches: DataFrame, bits: int) -> Broadcast:
    """Merges the tasks' sketches and broadcasts which cells count two or more: 2 * 2 ** bits / 8 bytes, which is all that passes the driver."""
    rows = sketches.repartition("block").sortWithinPartitions("block").mapInArrow(_added, "block int, bits binary").toArrow()
    table = np.zeros((2 << bits) // 8, dtype=np.uint8)
    for block, raw in zip(rows["block"].to_pylist(), rows["bits"], strict=True):
        room = table[block * 8192 : (block + 1) * 8192]
        room[:] = np.frombuffer(raw.as_buffer(), dtype=np.uint8)[: len(room)]
    return sketches.sparkSession.sparkContext.broadcast(table.tobytes())


def seen_twice(table: bytes, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes may have been added twice or more: all that were, and few others while the cells are sparse."""
    first, second = two_cells(hashes, bits)
    at = probe(table, first)
    at[at] = probe(table, second[at])
    return at
