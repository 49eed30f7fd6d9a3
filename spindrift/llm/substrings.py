"""Exact removal of word sequences that repeat within or across documents.

Pass 1 counts anchors in a count-min sketch. A window's anchor is its smallest `ANCHOR`-word hash, so that equal windows
have equal anchors, and the sketch's estimate for the anchor never falls below the window's count; there are far fewer anchors than windows. Each task sums a sparse
sketch of its part of the documents, packed in blocks of cells, and Spark merges these block by block. Pass 2 groups exactly (by 96 bits of two
independent hashes) only the windows whose estimate says repeated, so no repeated window is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps
from .joins import skew_join
from .kernels import SPACED, Words, as_long, flat, in_row, slices, window_hashes

#: Words of an anchor.
ANCHOR = 16
#: Each of the sketch's two rows has 2 ** BITS cells, of which one bit (repeated or not) is broadcast: 2 * 2 ** 28 / 8 = 64 MB.
#: With many more than 2 ** BITS anchors (some billion words of text) ever more windows pass on to the exact step, which is a
#: plain shuffle; results stay the same.
BITS = 28
U = np.uint64


def _sliding(x: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """pick over each run of `size` values, in about log2(size) steps."""
    out, have = x, 1
    while have < size:
        step = min(have, size - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def _anchors(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, each window's anchor hash, and the anchors (a hash for each place that is some window's anchor)."""
    starts = in_row(words.row_at, size)
    k = min(ANCHOR, size)
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    grams = window_hashes(words.hash, k)
    span = size - k + 1
    least = _sliding(grams, span, np.minimum)
    inside = np.zeros(len(least), dtype=np.uint64)
    inside[starts] = least[starts]
    # A place is an anchor if its hash is the least of some window that holds it.
    most = _sliding(np.concatenate([np.zeros(span - 1, dtype=np.uint64), inside, np.zeros(span - 1, dtype=np.uint64)]), span, np.maximum)
    return starts, least[starts], grams[grams == most[: len(grams)]]


def _sketch(docs: DataFrame, text_col: str, size: int) -> Broadcast:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = bitmaps.PartSketch(BITS)
        for batch in batches:
            for _, _, data, offs in slices(*flat(batch.column(0))):
                yield from sketch.add(_anchors(Words(data, offs, SPACED), size)[2])
        yield from sketch.rest()

    return bitmaps.broadcast_seen_twice(docs.select(text_col).mapInArrow(run, bitmaps.PartSketch.SCHEMA), BITS)


def _suspects(words: Words, size: int, table: bytes) -> np.ndarray:
    """Starts of the windows that the sketch takes for repeated."""
    starts, least, _ = _anchors(words, size)
    return starts[bitmaps.seen_twice(table, least, BITS)]


def _keys(words: Words, size: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h1 = window_hashes(words.hash, size)[starts]
    h2 = window_hashes(words.hash, size, second=True)[starts]
    return h1, (h2 >> U(32)).astype(np.uint32).view(np.int32)


def _counted(docs: DataFrame, text_col: str, size: int, sketch: Broadcast) -> DataFrame:
    """Suspected windows with the number of their occurrences, summed by task before Spark sums them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def summed() -> pa.RecordBatch:
            h1, h2 = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((h2, h1))
            h1, h2 = h1[order], h2[order]
            new = np.ones(len(h1), dtype=bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(h1)))
            return pa.RecordBatch.from_arrays([as_long(h1[at]), pa.array(h2[at]), pa.array(np.minimum(count, 2).astype(np.int32))], names=["h1", "h2", "n"])

        for batch in batches:
            for _, _, data, offs in slices(*flat(batch.column(0))):
                words = Words(data, offs, SPACED)
                held.append(_keys(words, size, _suspects(words, size, sketch.value)))
                n += len(held[-1][0])
                if n > 500_000:
                    yield summed()
                    held, n = [], 0
        if n:
            yield summed()

    return docs.select(text_col).mapInArrow(run, "h1 bigint, h2 int, n int").groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def _places(docs: DataFrame, text_col: str, size: int, sketch: Broadcast) -> DataFrame:
    """Each suspected window with its document's key and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, offs in slices(*flat(batch.column(1))):
                words = Words(data, offs, SPACED)
                starts = _suspects(words, size, sketch.value)
                h1, h2 = _keys(words, size, starts)
                row = np.searchsorted(words.row_at, starts, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [as_long(h1), pa.array(h2), pa.array(keys[i + row]), pa.array((starts - words.row_at[row]).astype(np.int32))], names=["h1", "h2", "row_key", "pos"]
                )

    return docs.select("row_key", text_col).mapInArrow(run, "h1 bigint, h2 int, row_key bigint, pos int")


def _left(ids: pa.Array, part: np.ndarray, offs: np.ndarray, words: Words, starts: np.ndarray, size: int, rows: np.ndarray) -> pa.RecordBatch:
    """What is left of the given rows of a slice when the windows at `starts` (flat) go."""
    edge = np.zeros(len(words.starts) + size + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    gone = np.cumsum(edge)[: len(words.starts)] > 0
    raw = part.tobytes()
    total, removed, texts = [], [], []
    for k in rows.tolist():
        lo, hi = words.row_at[k], words.row_at[k + 1]
        own = gone[lo:hi]
        split = raw[offs[k] : offs[k + 1]].split()
        if own.any():
            split = [w for w, g in zip(split, own.tolist(), strict=True) if not g]
        texts.append(b" ".join(split).decode())
        total.append(hi - lo)
        removed.append(int(own.sum()))
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(rows)), pa.array(total, type=pa.int64()), pa.array(removed, type=pa.int64()), pa.array(texts, type=pa.string())], names=["doc_id", "n_words", "n_removed", "kept"]
    )


def _suspected(docs: DataFrame, id_col: str, text_col: str, size: int, sketch: Broadcast) -> DataFrame:
    """The documents with a suspected window: doc_id, row_key, and the text packed, as it is going to be shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in slices(*flat(batch.column(2))):
                words = Words(data, offs, SPACED)
                some = np.zeros(j - i, dtype=bool)
                some[np.searchsorted(words.row_at, _suspects(words, size, sketch.value), "right") - 1] = True
                raw, rows = data.tobytes(), np.flatnonzero(some)
                packed = [zlib.compress(raw[offs[k] : offs[k + 1]], 1) for k in rows.tolist()]
                chosen = pa.array(i + rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen), pa.array(packed, type=pa.binary())], names=["doc_id", "row_key", "packed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), "row_key", F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, row_key bigint, packed binary")


def _unsuspected(docs: DataFrame, id_col: str, text_col: str, size: int, sketch: Broadcast) -> DataFrame:
    """All other documents, which lose nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for i, j, data, offs in slices(*flat(batch.column(1))):
                words = Words(data, offs, SPACED)
                some = np.zeros(j - i, dtype=bool)
                some[np.searchsorted(words.row_at, _suspects(words, size, sketch.value), "right") - 1] = True
                yield _left(batch.column(0).slice(i, j - i), data, offs, words, none, size, np.flatnonzero(~some))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def _kept(joined: DataFrame, size: int, kind: str) -> DataFrame:
    """doc_id, packed text and (null or) starts of repeated windows -> what is left."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                yield batch.slice(i, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            data, offs = flat(pa.array([zlib.decompress(x) for x in batch.column(1).to_pylist()], type=pa.large_binary()))
            marks = batch.column(2)
            mark_at = np.concatenate([[0], np.cumsum(marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            places = marks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j, part, part_offs in slices(data, offs):
                words = Words(part, part_offs, SPACED, hashes=False)
                row = np.repeat(np.arange(j - i), np.diff(mark_at[i : j + 1]))
                starts = places[mark_at[i] : mark_at[j]] + words.row_at[row]
                yield _left(batch.column(0).slice(i, j - i), part, part_offs, words, starts, size, np.arange(j - i))

    return joined.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def remove_repeats(docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes the words of every window of `size` words whose word sequence also starts anywhere else.

    Words are runs of characters that aren't ASCII white space, unchanged; windows lie in one document and are judged on the
    input. Returns one row per document: doc_id, n_words, n_removed, kept (the other words, joined by one space).

    Null or empty texts and texts of fewer than `size` words lose nothing (kept is their words, or empty). Repeated rows
    repeat each other and so lose all their windows. An empty table gives an empty result. Other columns aren't read.
    Ties don't occur: no copy is preferred, all lose the window.
    """
    # Repeated rows share a key, and so a set of places, which is as long as their text at most.
    docs = docs.select(id_col, text_col).withColumn("row_key", F.xxhash64(id_col, text_col))
    kind = docs.schema[id_col].dataType.simpleString()
    sketch = _sketch(docs, text_col, size)
    repeated = _counted(docs, text_col, size, sketch).where("n >= 2").select("h1", "h2")
    marks = skew_join(_places(docs, text_col, size, sketch), repeated, ["h1", "h2"], "left_semi").groupBy("row_key").agg(F.collect_set("pos").alias("starts"))
    suspected = _suspected(docs, id_col, text_col, size, sketch).join(marks, "row_key", "left").select("doc_id", "packed", "starts")
    return _kept(suspected, size, kind).unionByName(_unsuspected(docs, id_col, text_col, size, sketch))
