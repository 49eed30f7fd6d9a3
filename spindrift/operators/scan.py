"""Keyword retrieval without an index, for queries that are asked once: a task counts the queries' terms in its own chunks and keeps the best of them.

Texts are cut into tokens once and no term is shuffled, only how many chunks have each alternative and the best hits of each task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.text import index_tokens
from ..sources.stored import shared_folder
from .dense import HITS, Filters, Kept
from .sparse import B, CELLS, K1, QUERIES, Asked, query_filters, weights_of_terms

#: Columns of chunks that filters of queries are about, and tokens that are looked up at once.
FILTERED, TOKENS = ("source_type", "mtime", "ctime", "filepath"), 1 << 20


class _Terms:
    """The alternatives of some queries, as terms are looked up: whole, by their first characters, or one after another."""

    def __init__(self, keys: dict[tuple, int]):
        self.n = len(keys)
        single: dict[int | None, list[tuple[str, int]]] = {}
        for (tokens, prefix), no in keys.items():
            if len(tokens) == 1:
                single.setdefault(len(tokens[0]) if prefix else None, []).append((tokens[0], no))
        self.single = [(length, pa.array([t for t, _ in pairs], type=pa.string()), np.array([*(no for _, no in pairs), -1])) for length, pairs in single.items()]
        self.phrases = [(no, tokens, prefix) for (tokens, prefix), no in keys.items() if len(tokens) > 1]

    def counted(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cells (a list's place times the number of alternatives, and an alternative) and how often it occurs there."""
        sizes = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        own = np.repeat(np.arange(len(sizes)), sizes)
        words = tokens.flatten().dictionary_encode()
        code, known = words.indices.to_numpy(zero_copy_only=False), words.dictionary.cast(pa.string())
        cells = [np.zeros(0, dtype=np.int64)]
        for length, asked, nos in self.single:
            cut = known if length is None else pc.utf8_slice_codeunits(known, 0, length)
            no = nos[pc.fill_null(pc.index_in(cut, value_set=asked), -1).to_numpy(zero_copy_only=False)][code]
            hit = np.flatnonzero(no >= 0)
            cells.append(own[hit] * self.n + no[hit])
        if self.phrases and len(code):
            cells += self._phrases(own, code, known)
        return np.unique(np.concatenate(cells), return_counts=True)

    def _phrases(self, own: np.ndarray, code: np.ndarray, known: pa.Array) -> Iterator[np.ndarray]:
        order = np.argsort(code, kind="stable")
        bounds = np.searchsorted(code[order], np.arange(len(known) + 1))
        whole = {t for _, tokens, prefix in self.phrases if not prefix for t in tokens}
        value_set = pa.array(sorted(whole), type=pa.string())
        places = {t: [i] for t, i in zip(value_set.to_pylist(), pc.index_in(value_set, value_set=known).to_pylist(), strict=True) if i is not None}
        for no, tokens, prefix in self.phrases:
            codes = [np.flatnonzero(pc.starts_with(known, t).to_numpy(zero_copy_only=False)) if prefix else places.get(t, []) for t in tokens]
            if all(len(c) for c in codes):
                at = np.concatenate([order[bounds[c] : bounds[c + 1]] for c in codes[0]])
                for i, some in enumerate(codes[1:], 1):
                    at = at[at + i < len(code)]
                    at = at[(own[at + i] == own[at]) & np.isin(code[at + i], some)]
                yield own[at] * self.n + no


def _counts(chunks: DataFrame, fields: dict[str, str], weights: dict[str, float], asked: Asked, kept: list[str]) -> DataFrame:
    """(chunk_id, the kept columns, length, kinds, f): all tokens of each chunk, and the weighted occurrences of the alternatives that it has.

    Kinds from the number of alternatives on are those in file names only; they are counted if a query is about these only.
    """
    names, terms, by_name = list(fields), _Terms(asked.keys), bool(asked.only.any())
    n_kinds = terms.n * (1 + by_name)
    cut = chunks.select("chunk_id", *kept, *(index_tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"__{i}") for i, c in enumerate(fields.values())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[1 + len(kept) :]
            ends = np.cumsum(sum(c.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
            low = 0
            while low < batch.num_rows:
                # Chunks of about so many tokens, one at least.
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + TOKENS, "right")))
                yield counted(batch.slice(low, high - low))
                low = high

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells, sums = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
        length = np.zeros(batch.num_rows, dtype=np.int64)
        for name, tokens in zip(names, batch.columns[1 + len(kept) :], strict=True):
            length += tokens.value_lengths().to_numpy(zero_copy_only=False)
            if name not in weights:
                continue
            cell, n = terms.counted(tokens)
            cell = cell // terms.n * n_kinds + cell % terms.n
            for shift in (0, terms.n) if by_name and name == "filename" else (0,):
                cells.append(cell + shift)
                sums.append(n * weights[name])
        cell, place = np.unique(np.concatenate(cells), return_inverse=True)
        f = np.bincount(place, weights=np.concatenate(sums), minlength=len(cell))
        edges = pa.array(np.searchsorted(cell, np.arange(batch.num_rows + 1) * n_kinds), type=pa.int32())
        lists = [pa.ListArray.from_arrays(edges, pa.array(x, type=kind)) for x, kind in ((cell % n_kinds, pa.int32()), (f, pa.float64()))]
        return pa.RecordBatch.from_arrays([*batch.columns[: 1 + len(kept)], pa.array(length), *lists], names=["chunk_id", *kept, "length", "kinds", "f"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.select("chunk_id", *kept).schema.fields)
    return cut.mapInArrow(run, f"{own}, length bigint, kinds array<int>, f array<double>")


def bm25(plans: DataFrame, chunks: DataFrame, fields: dict[str, str], k: int, weights: tuple[tuple[str, float], ...] = SETTINGS.field_weights, digits: int = 6) -> DataFrame:
    """(query_id, chunk_id, score) of chunks that match all clauses, the best k of each query and task; ranked in sparse.top, they are those of an index.

    Scores have `digits` places. Filters of the queries (see sparse.FILTERS) work before the best are chosen; statistics are those of all chunks.
    The counts are stored once, in the folder of spark.checkpoint.dir.
    """
    blocks = max(1, -(-plans.count() // max(1, min(QUERIES, HITS // max(1, k)))))
    out = None
    for b in range(blocks):
        part = _scored(plans.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else plans, chunks, fields, k, dict(weights), digits)
        out = part if out is None else out.unionByName(part)
    return out


def _stored(spark: SparkSession, counts: DataFrame) -> DataFrame:
    path = f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}"
    counts.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _scored(plans: DataFrame, chunks: DataFrame, fields: dict[str, str], k: int, weights: dict[str, float], digits: int) -> DataFrame:
    spark, asked = plans.sparkSession, Asked(plans)
    types = {c: df.schema[c].dataType.simpleString() for df, c in ((plans, "query_id"), (chunks, "chunk_id"))}
    schema = f"query_id {types['query_id']}, chunk_id {types['chunk_id']}, score double"
    if not any(key for key, _ in asked.keys):
        return spark.createDataFrame([], schema)
    filters = query_filters(plans)
    held = None if filters is None else filters.toArrow().combine_chunks()
    if held is not None:  # in the order of the queries
        held = held.take(pc.index_in(asked.ids, value_set=held["query_id"].combine_chunks()))
        held = {c: held[c].combine_chunks() for c in held.column_names}
    kept = list(FILTERED) if held is not None else []
    counts = _stored(spark, _counts(chunks, fields, weights, asked, kept))
    totals = counts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
    n_chunks, mean = totals["n"], totals["tokens"] / max(1, totals["n"])
    n_kinds = len(asked.keys) * (1 + bool(asked.only.any()))
    n_p = np.zeros(n_kinds)
    for r in counts.select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each alternative of the queries
        n_p[r.kind] = r.n
    idf = weights_of_terms(n_p, n_chunks)
    kind_of, query = asked.key + len(asked.keys) * asked.only, asked.query[asked.queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Kept(len(asked.ids), k, digits)
        tests = None if held is None else Filters(held)
        step = max(1, CELLS // max(n_kinds, len(kind_of)))
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                some = batch.slice(low, step)
                columns = dict(zip(some.schema.names, some.columns, strict=True))
                own = np.repeat(np.arange(some.num_rows), columns["kinds"].value_lengths().to_numpy(zero_copy_only=False))
                kind, f = (columns[c].flatten().to_numpy(zero_copy_only=False) for c in ("kinds", "f"))
                norm = K1 * (1 - B + B * columns["length"].to_numpy() / (mean or 1.0))
                there = np.zeros((n_kinds, some.num_rows), dtype=bool)
                there[kind, own] = True
                met = np.add.reduceat(np.maximum.reduceat(there[kind_of], asked.clauses, axis=0), asked.first_clauses, axis=0, dtype=np.int64)
                take = met == asked.needed[:, None]
                if not take.any():
                    continue
                part = np.zeros((n_kinds, some.num_rows))
                part[kind, own] = idf[kind] * f * (K1 + 1) / (f + norm[own])
                score = np.add.reduceat(part[kind_of], asked.queries, axis=0)
                take &= score >= best.bounds()[query][:, None]
                if tests is not None:
                    take &= tests.passing(query, columns)
                q, c = np.nonzero(take)
                best.add(query[q], score[q, c], columns["chunk_id"].take(pa.array(c)))
        out = best.choose()
        if out is not None:
            yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(out[0])), out[2], pa.array(out[1])], names=["query_id", "chunk_id", "score"])

    return counts.mapInArrow(run, schema)
