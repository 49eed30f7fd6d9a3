"""Keyword retrieval: all clauses must match in any field; ranked by BM25 with weighted fields."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..sources.stored import cut, small
from .index import Index

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Queries that one pass over the index answers, tokens of the chunks that meet in one group, and numbers that a task holds at once: 32 MB.
QUERIES, GROUP_TOKENS, CELLS = 4000, 2_000_000, 4 << 20
#: Query tokens that are written into the scans as a filter; more of them only join.
PUSHED_TOKENS = 200


def match_terms(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Terms of the vocabulary for each query token: equal, or beginning with it. An equi-join, not a scan of all pairs:
    each term is cut to the few lengths that the prefixes have."""
    lengths = sorted(r[0] for r in terms.where("is_prefix").select(F.length("token")).distinct().collect())  # bounded by the longest word
    whole = vocabulary.select("term", F.col("term").alias("token"), F.lit(False).alias("is_prefix"))
    cut = vocabulary.select("term", F.explode(F.array(*(F.lit(n) for n in lengths))).alias("n")) if lengths else None
    if cut is not None:
        whole = whole.unionByName(cut.where(F.length("term") >= F.col("n")).select("term", F.expr("left(term, n)").alias("token"), F.lit(True).alias("is_prefix")))
    return small(terms).join(whole, ["token", "is_prefix"])


def _of_tokens(asked: DataFrame, index: Index) -> Index:
    """The part of the index that may match, where the queries have few different tokens: equality and prefixes skip row groups of sorted tables."""
    tokens = asked.select("token", "is_prefix").distinct().limit(PUSHED_TOKENS + 1).collect()
    if not tokens or len(tokens) > PUSHED_TOKENS:
        return index
    whole = [t.token for t in tokens if not t.is_prefix]
    prefixes = sorted(t.token for t in tokens if t.is_prefix)
    # A prefix of a prefix covers it.
    least = [p for k, p in enumerate(prefixes) if not any(p.startswith(q) for q in prefixes[:k])]
    test = F.col("term").isin(whole) if whole else F.lit(False)
    for p in least:
        test = test | F.startswith("term", F.lit(p))
    return index.where_terms(test)


class Asked:
    """The clauses of some queries: different alternatives (tokens, is_prefix) by number, and which queries have them in which clause."""

    def __init__(self, plans: DataFrame):
        rows = plans.select("query_id", "filename_only", "clauses").toArrow()
        self.ids = rows["query_id"].combine_chunks()
        self.keys: dict[tuple, int] = {}
        uses = []
        for q, (only, clauses) in enumerate(zip(rows["filename_only"].to_pylist(), rows["clauses"].to_pylist(), strict=True)):
            for c, alternatives in enumerate(clauses):
                uses += [(q, c, self.keys.setdefault((tuple(a["tokens"]), a["is_prefix"]), len(self.keys)), only) for a in alternatives]
        # In the order of queries and clauses.
        self.query, self.clause, self.key, self.only = (np.array([u[i] for u in uses], dtype=kind) for i, kind in enumerate((np.int64, np.int64, np.int64, bool)))
        new_query = np.diff(self.query, prepend=-1) != 0
        new_clause = new_query | (np.diff(self.clause, prepend=-1) != 0)
        self.queries, self.clauses = np.flatnonzero(new_query), np.flatnonzero(new_clause)
        self.first_clauses = np.flatnonzero(new_query[self.clauses])
        self.needed = np.array([len(c) for c in rows["clauses"].to_pylist()], dtype=np.int64)[self.query[self.queries]]

    def take(self, kinds: list[list[int]]) -> None:
        """Which kinds of terms count for which alternative (see occurrences)."""
        pairs = sorted((no, kind) for kind, own in enumerate(kinds) for no in own)
        self.n_kinds = len(kinds)
        no, self.kind = (np.array([p[i] for p in pairs], dtype=np.int64) for i in range(2))
        self.found, self.first_kinds = np.unique(no, return_index=True)

    def cells(self, chunk: np.ndarray, kind: np.ndarray, f: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Some chunks at a time, and the sums of f (or the numbers of rows) of all alternatives (rows) in them (columns)."""
        order = np.argsort(chunk, kind="stable")
        hit, start = np.unique(chunk[order], return_index=True)
        start = np.append(start, len(order))
        step = max(1, CELLS // max(len(self.key), len(self.kind), 1))
        for low in range(0, len(hit), step):
            own = hit[low : low + step]
            rows = order[start[low] : start[low + len(own)]]
            cell = kind[rows].astype(np.int64) * len(own) + np.searchsorted(own, chunk[rows])
            each = np.bincount(cell, weights=None if f is None else f[rows], minlength=self.n_kinds * len(own)).reshape(self.n_kinds, -1)
            out = np.zeros((len(self.keys), len(own)))
            if len(self.kind):
                out[self.found] = np.add.reduceat(each[self.kind], self.first_kinds, axis=0)
            yield own, out

    def tokens(self, plans: DataFrame) -> DataFrame:
        rows = [(no, len(key), i, token, prefix) for (key, prefix), no in self.keys.items() for i, token in enumerate(key)]
        return plans.sparkSession.createDataFrame(rows, "no int, n_tokens int, token_no int, token string, is_prefix boolean")


def occurrences(tokens: DataFrame, index: Index, weights: tuple[tuple[str, float], ...]) -> tuple[DataFrame, list[list[int]]]:
    """(chunk_id, kind, by_name, f): the weighted occurrences of the queries' terms, and the alternatives that each kind counts for.

    Terms are of one kind if the same alternatives ask for them, so an occurrence is one row, however many nested prefixes it has. Prefixes
    are nested or apart: there are about as many kinds as alternatives.
    """
    index = _of_tokens(tokens, index)
    spark = tokens.sparkSession
    weight = F.element_at(F.create_map(*(F.lit(x) for pair in weights for x in pair)), F.col("field"))
    own = ["chunk_id", "kind", (F.col("field") == "filename").alias("by_name")]
    matched = match_terms(tokens, index.vocabulary.select("term"))
    alone = cut(matched.where("n_tokens = 1").groupBy("term").agg(F.sort_array(F.collect_set("no")).alias("nos")))
    kinds = [r["nos"] for r in alone.select("nos").distinct().collect()]
    numbered = spark.createDataFrame(list(enumerate(kinds)), "kind int, nos array<int>")
    single = index.terms.join(small(cut(alone.join(F.broadcast(numbered), "nos").select("term", "kind"))), "term").select(*own, (F.col("tf") * weight).alias("f"))
    phrases = sorted(r.no for r in tokens.where("n_tokens > 1").select("no").distinct().collect())
    if not phrases:
        return single.where("f IS NOT NULL"), kinds
    # A phrase occurs where all its tokens stand one after another; it's a kind of its own.
    numbers = spark.createDataFrame([(no, len(kinds) + i) for i, no in enumerate(phrases)], "no int, kind int")
    terms = small(cut(matched.where("n_tokens > 1").join(F.broadcast(numbers), "no").select("term", "kind", "token_no", "n_tokens")))
    same = ["kind", "chunk_id", "field", "n_tokens"]
    places = index.positions.join(terms, "term").select(*same, (F.col("pos") - F.col("token_no")).alias("at"))
    phrase = places.groupBy(*same, "at").count().where("count = n_tokens").groupBy(*same).agg(F.count(F.lit(1)).alias("hits"))
    return single.unionByName(phrase.select(*own, (F.col("hits") * weight).alias("f"))).where("f IS NOT NULL"), [*kinds, *([no] for no in phrases)]


def bm25(plans: DataFrame, index: Index, weights: tuple[tuple[str, float], ...] = SETTINGS.field_weights) -> DataFrame:
    """(query_id, chunk_id, score) of the chunks that match all clauses. Statistics are those of the whole corpus.

    What the queries' terms have in a group of chunks meets in one task, once for all queries that ask for them; only whole matches leave it.
    The first pass counts in how many chunks each alternative occurs, the second scores.
    """
    blocks = max(1, -(-plans.count() // QUERIES))
    parts = [_scored(plans.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else plans, index, weights) for b in range(blocks)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _scored(plans: DataFrame, index: Index, weights: tuple[tuple[str, float], ...]) -> DataFrame:
    asked = Asked(plans)
    lengths = index.document_lengths()
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((plans, "query_id"), (lengths, "chunk_id"))}
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double"
    tokens = asked.tokens(plans)
    if not any(key for key, _ in asked.keys):
        return plans.sparkSession.createDataFrame([], schema)
    totals = index.totals.first()
    n_tokens = sum(totals[f"n_{f}"] for f in index.fields)
    n_chunks, mean = totals["n_chunks"], n_tokens / max(1, totals["n_chunks"])
    groups = max(16, -(-n_tokens // GROUP_TOKENS))
    grouped = lambda df: df.withColumn("group", F.pmod(F.xxhash64("chunk_id"), F.lit(groups)).cast("int")).groupBy("group")
    rows, kinds_of = occurrences(tokens, index, weights)
    asked.take(kinds_of)

    def count(found: pa.Table) -> pa.Table:
        chunk = found["chunk_id"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        n = np.zeros((2, len(asked.keys)), dtype=np.int64)
        for i, some in enumerate((np.ones(len(chunk), dtype=bool), found["by_name"].to_numpy())):
            for own, there in asked.cells(chunk[some], found["kind"].to_numpy()[some], None):
                n[i] += (there > 0).sum(axis=1)
        return pa.table({"no": pa.array(range(len(asked.keys)), type=pa.int32()), "n": pa.array(n[0]), "n_name": pa.array(n[1])})

    counted = grouped(rows.select("chunk_id", "kind", "by_name")).applyInArrow(count, "no int, n bigint, n_name bigint").groupBy("no").agg(F.sum("n").alias("n"), F.sum("n_name").alias("n_name"))
    n_p = np.zeros((2, len(asked.keys)))
    for r in counted.collect():  # a row for each alternative of the queries
        n_p[:, r.no] = r.n, r.n_name
    held = n_p[asked.only.astype(int), asked.key]
    idf = weights_of_terms(held, n_chunks)

    def score(found: pa.Table, sizes: pa.Table) -> pa.Table:
        return _complete(asked, idf, mean, found, sizes)

    return grouped(rows).cogroup(grouped(lengths)).applyInArrow(score, schema)


def weights_of_terms(held: np.ndarray, n_chunks: int) -> np.ndarray:
    """Weights (IDF) of terms that so many chunks have. A term in all chunks has the least weight, whatever the logarithm."""
    raw = np.log(np.maximum(n_chunks - held + 0.5, 1e-300) / (held + 0.5))
    return np.where(raw <= 0, LEAST_IDF, raw)


def _complete(asked: Asked, idf: np.ndarray, mean: float, found: pa.Table, sizes: pa.Table) -> pa.Table:
    """Scores of the chunks of a group that match all clauses of a query, some chunks at a time."""
    chunks = sizes["chunk_id"].combine_chunks()
    place = pc.index_in(found["chunk_id"].combine_chunks(), value_set=chunks)
    found = found.filter(pc.is_valid(place))
    chunk = place.drop_null().to_numpy().astype(np.int64)
    kind, by_name, f = (found[c].to_numpy() for c in ("kind", "by_name", "f"))
    norm = K1 * (1 - B + B * sizes["length"].to_numpy() / (mean or 1.0))
    queries, places, scores = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    named = zip(asked.cells(chunk, kind, f * by_name), asked.cells(chunk, kind, by_name.astype(float)), strict=True) if asked.only.any() else None
    for (own, sums), (_, rows) in zip(asked.cells(chunk, kind, f), asked.cells(chunk, kind, None), strict=True):
        has, there = sums[asked.key], rows[asked.key]
        if named is not None:
            (_, sums), (_, rows) = next(named)
            has[asked.only], there[asked.only] = sums[asked.key[asked.only]], rows[asked.key[asked.only]]
        s = np.add.reduceat(idf[:, None] * has * (K1 + 1) / (has + norm[own]), asked.queries, axis=0)
        met = np.add.reduceat(np.maximum.reduceat(there > 0, asked.clauses, axis=0).astype(np.int64), asked.first_clauses, axis=0)
        q, c = np.nonzero(met == asked.needed[:, None])
        queries.append(asked.query[asked.queries[q]])
        places.append(own[c])
        scores.append(s[q, c])
    columns = [asked.ids.take(pa.array(np.concatenate(queries))), chunks.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(scores))]
    return pa.Table.from_arrays(columns, names=["query_id", "chunk_id", "score"])


def top(scored: DataFrame, k: Column | str | int, by: str = "score", digits: int = 6, out: str = "rank") -> DataFrame:
    """The best k of each query with their ranks; equal scores (rounded) go by chunk_id."""
    order = Window.partitionBy("query_id").orderBy(F.round(F.col(by), digits).desc(), "chunk_id")
    limit = F.lit(k) if isinstance(k, int) else F.col(k) if isinstance(k, str) else k
    return scored.withColumn(out, F.row_number().over(order)).where(F.col(out) <= limit)


def filtered(scored: DataFrame, chunks: DataFrame, source_type: str | None = None, date_field: str = "mtime", date_from: float | None = None, date_to: float | None = None, path_contains: str | None = None) -> DataFrame:
    """Scored chunks whose file passes the filters (bounds inclusive, paths whatever their case). The filters reach the scan of chunks."""
    test = F.lit(True)
    if source_type not in (None, "all"):
        test = test & (F.col("source_type") == source_type)
    if date_from is not None:
        test = test & (F.col(date_field) >= date_from)
    if date_to is not None:
        test = test & (F.col(date_field) <= date_to)
    if path_contains:
        test = test & F.contains(F.lower("filepath"), F.lit(path_contains.lower()))
    return scored.join(chunks.where(test).select("chunk_id"), "chunk_id", "left_semi")


#: Filters that queries may carry, each in a column of its own; null is no filter.
FILTERS = {"source": "string", "date_field": "string", "date_from": "double", "date_to": "double", "path_filter": "string"}


def query_filters(plans: DataFrame) -> DataFrame | None:
    """(query_id and all FILTERS) of the queries, or None if they have no such column."""
    have = [c for c in FILTERS if c in plans.columns]
    if not have:
        return None
    return plans.select("query_id", *((F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in FILTERS.items()))


def filtered_by_query(scored: DataFrame, plans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Scored chunks whose file passes the filters of their own query."""
    filters = query_filters(plans)
    if filters is None:
        return scored
    time = F.when(F.col("date_field") == "ctime", F.col("ctime")).otherwise(F.col("mtime"))
    test = (
        (F.coalesce("source", F.lit("all")).isin("all") | (F.col("source_type") == F.col("source")))
        & (F.col("date_from").isNull() | (time >= F.col("date_from")))
        & (F.col("date_to").isNull() | (time <= F.col("date_to")))
        & (F.col("path_filter").isNull() | F.contains(F.lower("filepath"), F.lower("path_filter")))
    )
    own = chunks.select("chunk_id", "source_type", "mtime", "ctime", "filepath")
    return scored.join(filters, "query_id").join(own, "chunk_id").where(F.coalesce(test, F.lit(False))).select(*scored.columns)
