"""Benchmark decontamination as a prefix-filtered set join.

A window of `window` item words occurs in a document only if all of its word shingles do. Shingles are ordered by how
often they occur in the documents, and only the rarest one of each window, its necessary prefix, names candidates. Where a
document holds a prefix, the prefix's offset and the window's length bound where a window can lie, and the document's own
words there are joined with the windows, so that windows are compared word by word and nothing rests on hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bitmaps
from .arrays import own_prefix
from .checkpoints import cut
from .joins import skew_join
from .kernels import ALNUM, LOWER, Words, as_long, flat, in_row, lists, slices, window_hashes

#: Cells of the bit tables of benchmark shingles: 2 ** 24 / 8 = 2 MB are broadcast, however large the benchmark is.
BITS = 24


def text_key(*columns: str) -> F.Column:
    return F.xxhash64(*columns)


def _joined(raw: bytes, words: Words, lo: int, hi: int) -> str:
    """The words from lo to hi of a slice whose bytes are lower-cased, joined by spaces."""
    return b" ".join(raw[a:b] for a, b in zip(words.starts[lo:hi].tolist(), words.ends[lo:hi].tolist(), strict=True)).decode()


def _windows(benchmark: DataFrame, window: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows of each item: item, words (joined by spaces), size, and the shingles as structs of hash, offset and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, offs in slices(*flat(batch.column(1))):
                words, raw = Words(data, offs, ALNUM, lower=True), LOWER[data].tobytes()
                items, rows = [], []
                for k, (lo, hi) in enumerate(zip(words.row_at[:-1].tolist(), words.row_at[1:].tolist(), strict=True)):
                    size = min(window, hi - lo)
                    step = min(shingle, size)
                    if not size:
                        continue
                    sh = window_hashes(words.hash[lo:hi], step).view(np.int64).tolist()
                    for s in range(hi - lo - size + 1):
                        items.append(i + k)
                        rows.append((_joined(raw, words, lo + s, lo + s + size), size, [{"sh": sh[s + o], "off": o, "n": step} for o in range(size - step + 1)]))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(items)),
                            pa.array([r[0] for r in rows], type=pa.string()),
                            pa.array([r[1] for r in rows], type=pa.int32()),
                            pa.array([r[2] for r in rows], type=pa.list_(pa.struct([("sh", pa.int64()), ("off", pa.int32()), ("n", pa.int32())]))),
                        ],
                        names=["item_id", "words", "size", "tokens"],
                    )

    kind = benchmark.schema[id_col].dataType.simpleString()
    schema = f"item_id {kind}, words string, size int, tokens array<struct<sh:bigint,off:int,n:int>>"
    return benchmark.select(id_col, text_col).mapInArrow(run, schema).distinct()


def _shingle_counts(docs: DataFrame, tokens: DataFrame, lengths: list[int], text_col: str) -> DataFrame:
    """How often each benchmark shingle occurs in the documents (about: one table cell may hold two shingles)."""
    table = bitmaps.broadcast_cells(tokens.select(bitmaps.cell(F.col("sh"), BITS).alias("c")), "c", BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in slices(*flat(batch.column(0))):
                words = Words(data, offs, ALNUM, lower=True)
                for n in lengths:
                    h = window_hashes(words.hash, n)[in_row(words.row_at, n)]
                    h, count = np.unique(h[bitmaps.probe(table.value, bitmaps.cells(h, BITS))], return_counts=True)
                    if len(h):
                        yield pa.RecordBatch.from_arrays([as_long(h), pa.array(count)], names=["sh", "n_docs"])

    return docs.select(text_col).mapInArrow(run, "sh bigint, n_docs bigint").groupBy("sh").agg(F.sum("n_docs").alias("n_docs"))


def _prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """One row for each distinct window: its words and size, and its rarest shingle with offset and length."""
    by_window = Window.partitionBy("words").orderBy(F.coalesce("n_docs", F.lit(0)), "sh", "off")
    distinct = windows.groupBy("words", "size").agg(F.first("tokens").alias("tokens"))
    each = distinct.select("words", "size", F.explode("tokens").alias("t")).select("words", "size", "t.*")
    return each.join(counts, "sh", "left").withColumn("k", F.row_number().over(by_window)).where("k = 1").select("words", "size", "sh", "off", "n")


def _candidates(docs: DataFrame, prefixes: DataFrame, shapes: list[tuple[int, int, int]], id_col: str, text_col: str) -> DataFrame:
    """One row per document: its number of words, and what windows would be there: (words, start, size) around each prefix it may hold."""
    table = bitmaps.broadcast_cells(prefixes.select(bitmaps.cell(F.col("sh"), BITS).alias("c")), "c", BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in slices(*flat(batch.column(2))):
                words, raw = Words(data, offs, ALNUM, lower=True), None
                found: set[tuple[int, int]] = set()
                for n in sorted({n for n, _, _ in shapes}):
                    at = in_row(words.row_at, n)
                    at = at[bitmaps.probe(table.value, bitmaps.cells(window_hashes(words.hash, n)[at], BITS))]
                    row = np.searchsorted(words.row_at, at, "right") - 1
                    for _, off, size in (x for x in shapes if x[0] == n):
                        start = at - off
                        fits = (start >= words.row_at[row]) & (start + size <= words.row_at[row + 1])
                        found.update((s, size) for s in start[fits].tolist())
                spots = sorted(found)
                raw = LOWER[data].tobytes() if spots else b""
                starts = np.array([s for s, _ in spots], dtype=np.int64)
                row = np.searchsorted(words.row_at, starts, "right") - 1
                held = pa.StructArray.from_arrays(
                    [pa.array([_joined(raw, words, s, s + size) for s, size in spots], type=pa.string()), pa.array(starts - words.row_at[row], type=pa.int64()), pa.array([size for _, size in spots], type=pa.int32())],
                    names=["words", "start", "size"],
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(words.counts), lists(held, np.searchsorted(row, np.arange(j - i + 1)))], names=["doc_id", "text_key", "n_words", "spots"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, text_key bigint, n_words bigint, spots array<struct<words:string,start:bigint,size:int>>"
    return docs.select(id_col, text_key(text_col).alias("text_key"), text_col).mapInArrow(run, schema)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Occurrences of benchmark windows in documents.

    Words are runs of a-z, 0-9 and characters over U+007F after lower-casing A-Z. Each `window` consecutive words of an
    item are a window; an item of fewer words, but not none, is one window. Returns one row per document: doc_id,
    text_key (hash of the text), n_words, spans (array of start and end in words, sorted, may overlap), n_hit (words
    inside any span), items (ids of the items of which a window occurs).

    Null or wordless texts have no words and no hits; wordless items match nothing; a null item id stands for itself but
    can't be listed in `items`. Repeated rows give a row each. An empty benchmark gives rows without hits. Other columns
    of either table aren't read, so their names don't matter.
    """
    windows = cut(_windows(benchmark, window, shingle, item_col, item_text_col))
    tokens = windows.select(F.explode("tokens").alias("t")).select("t.*").distinct()
    lengths = sorted(r[0] for r in tokens.select("n").distinct().collect())  # at most `shingle` values
    counts = _shingle_counts(docs, tokens, lengths, text_col) if lengths else docs.sparkSession.createDataFrame([], "sh bigint, n_docs bigint")
    prefixes = cut(_prefixes(windows, counts))
    shapes = sorted(tuple(r) for r in prefixes.select("n", "off", "size").distinct().collect())  # at most window * window values
    found = cut(_candidates(docs, prefixes, shapes, id_col, text_col))
    spots = found.where("size(spots) > 0").select("doc_id", "text_key", F.explode("spots").alias("spot")).select("doc_id", "text_key", "spot.*").distinct()
    # A window that half of the documents hold is one key; neither that nor the number of its items makes a task of its own.
    index = windows.groupBy("words").agg(F.collect_set("item_id").alias("items"))
    hits = skew_join(spots, index, ["words"], "inner")
    marked = hits.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    # Spans in order of their starts: each adds the words after the furthest end so far.
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("to")),
        lambda acc, s: F.struct((acc["hit"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], acc["to"]))).alias("hit"), F.greatest(acc["to"], s["end"]).alias("to")),
    )["hit"]
    marked = marked.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), covered.alias("n_hit"), "spans", "items")
    own = found.select("doc_id", "text_key", "n_words")
    kind = dict(marked.dtypes)
    joined = own.join(marked, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left")
    return joined.select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", F.array().cast(kind["spans"])).alias("spans"), F.coalesce("items", F.array().cast(kind["items"])).alias("items")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no benchmark window occurs, all their columns unchanged. Options as in find_contamination."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    p = own_prefix(docs.columns)
    bad = cut(find_contamination(docs, benchmark, **options).where("n_hit > 0").select(F.col("doc_id").alias(f"{p}id"), F.col("text_key").alias(f"{p}key")).distinct())
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(f"{p}id")) & (text_key(text_col) == F.col(f"{p}key")), "left_anti")
