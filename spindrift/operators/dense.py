"""Vector retrieval: exact nearest neighbours by cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sparse import FILTERS, query_filters, top

#: Bytes of query vectors that are sent to the executors at once, and hits that a task keeps for them; more queries go in several blocks.
BLOCK_BYTES, HITS = 32 << 20, 1 << 20
#: Most scores (queries times vectors) that a task holds at once: 8 MB. Half as many hits are gathered before the best are chosen anew.
SCORES = 1 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6, files: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k most similar vectors of each query, score = max(0, cosine).

    queries has query_id and embedding, vectors has chunk_id and embedding, all of one length and not null. Blocks of queries
    visit all vectors; each task keeps the best k of its own rows, so k rows per query and task are shuffled. Scores are rounded
    to `digits` places, equal ones go by chunk_id. A zero vector is similar to nothing.

    With `files` (chunk_id, source_type, mtime, ctime, filepath), only chunks that pass a query's own filters (see sparse.FILTERS) are
    ranked: the filters work before the best k are chosen.
    """
    ids = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (vectors, "chunk_id"))}
    filters = query_filters(queries) if files is not None else None
    if filters is not None:
        vectors = vectors.join(files.select("chunk_id", "source_type", F.col("mtime").cast("double"), F.col("ctime").cast("double"), "filepath"), "chunk_id")
    asked = queries if filters is None else queries.select("query_id", "embedding").join(filters, "query_id")
    return best_of_blocks(asked, vectors, k, digits, ids, filters is not None)


def best_of_blocks(asked: DataFrame, vectors: DataFrame, k: int, digits: int, ids: dict[str, str], filtered: bool, lists: int | None = None) -> DataFrame:
    """Blocks of queries of bounded size visit all vectors. With a number of `lists`, a query (which has an array of its own, lists) meets only vectors of these (which have list)."""
    kept = ["query_id", "embedding", *(FILTERS if filtered else []), *(["lists"] if lists else [])]
    size = asked.selectExpr("count(*) AS n", "max(size(embedding)) AS d").first()
    per_block = max(1, min(BLOCK_BYTES // (8 * (size["d"] or 1)), HITS // max(1, k)))
    blocks = max(1, -(-size["n"] // per_block))
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select(*kept).toArrow().combine_chunks()
        if part.num_rows:
            held = {c: part[c].combine_chunks() for c in kept if c not in ("embedding", "lists")}
            probed = _members(part["lists"].combine_chunks(), lists) if lists else None
            sent = vectors.sparkSession.sparkContext.broadcast((held, _unit(_matrix(part["embedding"].combine_chunks())), probed))
            own = _visit(vectors, sent, k, digits, ids, filtered, lists is not None)
            found = own if found is None else found.unionByName(own)
    if found is None:
        found = asked.sparkSession.createDataFrame([], f"query_id {ids['query_id']}, chunk_id {ids['chunk_id']}, score double")
    return top(found, k, digits=digits)


def _members(column: pa.Array, n: int) -> np.ndarray:
    """For each of n lists which queries have it."""
    out = np.zeros((n, len(column)), dtype=bool)
    out[column.flatten().to_numpy(), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())] = True
    return out


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)


class Filters:
    """The filters of a block's queries, turned into numbers once."""

    def __init__(self, asked: dict[str, pa.Array]):
        self.sources, self.source = np.unique(np.array([s or "all" for s in asked["source"].to_pylist()], dtype=str), return_inverse=True)
        self.by_ctime = np.array([f == "ctime" for f in asked["date_field"].to_pylist()])
        self.bounds = {bound: _numbers(asked[bound]) for bound in ("date_from", "date_to")}
        self.paths, self.path = np.unique(np.array([(p or "").lower() for p in asked["path_filter"].to_pylist()], dtype=str), return_inverse=True)

    def passing(self, own: np.ndarray | slice, files: dict[str, pa.Array]) -> np.ndarray:
        """Which chunks pass the filters of which of some queries; a missing time passes no bound."""
        kind = np.array([k or "" for k in files["source_type"].to_pylist()], dtype=str)
        ok = np.stack([(kind == s) | (s == "all") for s in self.sources])[self.source[own]]
        for bound, test in (("date_from", np.greater_equal), ("date_to", np.less_equal)):
            limit = self.bounds[bound][own]
            some = np.flatnonzero(~np.isnan(limit))
            if len(some):
                time = np.where(self.by_ctime[own][some][:, None], _numbers(files["ctime"])[None, :], _numbers(files["mtime"])[None, :])
                ok[some] &= test(time, limit[some][:, None])
        if self.paths.any():
            lower = pc.utf8_lower(files["filepath"].cast(pa.string()))
            holds = [pc.fill_null(pc.match_substring(lower, str(p)), not p).to_numpy(zero_copy_only=False) for p in self.paths]
            ok &= np.stack(holds)[self.path[own]]
        return ok


def _best(query: np.ndarray, score: np.ndarray, chunk: pa.Array, k: int) -> np.ndarray:
    """Places of the best k of each query: by score, then by id."""
    rank = pc.rank(chunk, sort_keys="ascending", tiebreaker="dense").to_numpy()
    order = np.lexsort((rank, -score, query))
    first = np.searchsorted(query[order], query[order], "left")
    return order[np.arange(len(order)) - first < k]


class Kept:
    """The best k hits of each query so far. New ones are gathered until they are many, so that a task chooses seldom."""

    def __init__(self, queries: int, k: int, digits: int):
        self.k, self.digits, self.n, self.parts = k, digits, 0, []
        self.least = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, raw: np.ndarray, chunk: pa.Array) -> None:
        """Hits with cosines as they are; those below a query's last hit go."""
        score = np.round(np.maximum(0.0, raw), self.digits)
        ok = np.flatnonzero(score >= self.least[query])
        if len(ok):
            self.parts.append((query[ok].astype(np.int32), score[ok], chunk.take(pa.array(ok))))
            self.n += len(ok)
            if self.n > SCORES // 2:
                self.choose()

    def choose(self) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
        if not self.parts:
            return None
        query, score = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        chunk = pa.concat_arrays([p[2] for p in self.parts])
        best = _best(query, score, chunk, self.k)
        query, score, chunk = query[best], score[best], chunk.take(pa.array(best))
        self.n, self.parts = 0, [(query, score, chunk)]
        lowest = np.full(len(self.least), np.inf)
        np.minimum.at(lowest, query, score)
        self.least = np.where(np.bincount(query, minlength=len(lowest)) >= self.k, lowest, -np.inf)
        return self.parts[0]

    def bounds(self) -> np.ndarray:
        """Cosines under which a query takes nothing more, before rounding."""
        return np.where(self.least > 0, self.least - 10.0**-self.digits, -np.inf)


def _visit(vectors: DataFrame, queries: Broadcast, k: int, digits: int, ids: dict[str, str], filtered: bool, listed: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, matrix, probed = queries.value
        kept = Kept(len(matrix), k, digits)
        filters = Filters(asked) if filtered else None

        def meet(part: pa.RecordBatch, own: np.ndarray | None) -> None:
            """Some rows and the queries (all if None) that they are for."""
            left = matrix if own is None else matrix[own]
            step = max(1, SCORES // max(1, len(left)))
            for at in range(0, part.num_rows, step):
                some = part.slice(at, step)
                raw = left @ _unit(_matrix(some.column(1))).T
                bound = kept.bounds() if own is None else kept.bounds()[own]
                take = raw >= bound[:, None]
                if filters is not None:
                    take &= filters.passing(slice(None) if own is None else own, dict(zip(some.schema.names, some.columns, strict=True)))
                q, c = np.nonzero(take)
                if len(q):
                    kept.add(q if own is None else own[q], raw[q, c], some.column(0).take(pa.array(c)))

        for batch in batches:
            if not listed:
                meet(batch, None)
                continue
            lists = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            order = np.argsort(lists, kind="stable")
            batch, lists = batch.take(pa.array(order)), lists[order]
            edges = np.flatnonzero(np.diff(lists, prepend=-1))
            for low, high in zip(edges, [*edges[1:], len(lists)], strict=True):
                own = np.flatnonzero(probed[lists[low]])
                if len(own):
                    meet(batch.slice(low, high - low), own)
        out = kept.choose()
        if out is not None:
            yield pa.RecordBatch.from_arrays([asked["query_id"].take(pa.array(out[0])), out[2], pa.array(out[1])], names=["query_id", "chunk_id", "score"])

    columns = ["chunk_id", "embedding", *(["source_type", "mtime", "ctime", "filepath"] if filtered else []), *(["list"] if listed else [])]
    return vectors.select(*columns).mapInArrow(run, f"query_id {ids['query_id']}, chunk_id {ids['chunk_id']}, score double")
