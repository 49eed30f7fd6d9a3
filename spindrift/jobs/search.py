"""The whole search: plans, both branches, filters, fusion, reranking, files, results. Any number of queries is one Spark plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import QUERY_TYPES, SETTINGS, Settings
from ..operators import aggregate, dense, fusion, index, planner, rerank, scan, sparse
from ..sources.stored import cut, small

FIELDS = {"filename": "filename", "path": "filepath", "heading": "heading", "content": "content"}


def search(
    queries: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
    scorer: rerank.Scorer | None = rerank.overlap_scorer,
    settings: Settings = SETTINGS,
    stored: index.Index | None = None,
    fields: dict[str, str] | None = None,
) -> DataFrame:
    """Results of all queries over chunks (chunk_id, file_id, filepath, filename, source_type, chunk_type, heading, title_path, content, mtime, ctime).

    Queries may carry filters of their own (source, date_field, date_from, date_to, path_filter; see sparse.FILTERS), which narrow both
    branches before their best hits are taken and never change the statistics. The vector branch is left out without vectors, and for queries
    of high exactness. With `stored`, a stored index of the chunks, no text is cut into tokens; without it, each text is cut once, where it is.
    `fields` names the fields that are searched.
    """
    plans = planner.plan(queries, settings)
    fields = FIELDS if fields is None else fields
    if stored is None:
        scored = scan.bm25(plans, chunks, fields, max(k for k, _, _, _ in QUERY_TYPES.values()), settings.field_weights)
    else:
        scored = sparse.filtered_by_query(sparse.bm25(plans, stored.of(list(fields)), settings.field_weights), plans, chunks)
    words = sparse.top(scored.join(plans.select("query_id", "sparse_k"), "query_id"), "sparse_k").select("query_id", "chunk_id", "score", "rank")
    if vectors is None or query_vectors is None:
        near = words.limit(0)
    else:
        own = [c for c in sparse.FILTERS if c in plans.columns]
        asked = query_vectors.select("query_id", "embedding").join(plans.where("exactness <> 'high'").select("query_id", *own), "query_id")
        found = dense.nearest(asked, vectors, max(k for _, k, _, _ in QUERY_TYPES.values()), files=chunks if own else None)
        near = found.join(plans.select("query_id", "dense_k"), "query_id").where("rank <= dense_k").select("query_id", "chunk_id", "score", "rank")
    # Few rows a query are left: they go to the chunks, whose texts aren't shuffled.
    fused = small(cut(fusion.fuse(words, near, plans, settings))).join(chunks.select("chunk_id", "file_id", "filepath", "filename", "chunk_type", "title_path", "content", "mtime"), "chunk_id")
    judged = rerank.rerank(fused, plans, scorer, settings)
    return aggregate.results(aggregate.file_scores(judged, plans, settings), plans, settings)
