"""Reranking with a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions.text import words
from .fusion import distinct_content

Scorer = Callable[[Column, Column], Column]


def document_text(title_path: Column, content: Column, most: int) -> Column:
    """What the scorer reads: the headings above the chunk, then its content."""
    heads = F.when(F.size(F.coalesce(title_path, F.array().cast("array<string>"))) > 0, F.concat(F.lit("["), F.array_join(title_path, " > "), F.lit("]\n"))).otherwise(F.lit(""))
    return F.substring(F.concat(heads, F.coalesce(content, F.lit(""))), 1, most)


def overlap_scorer(query: Column, document: Column) -> Column:
    """The part of the query's different words that the document has: a stand-in for a model, the same everywhere."""
    q, d = F.array_distinct(words(query)), F.array_distinct(words(document))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, d)) / F.size(q))


def rerank(candidates: DataFrame, plans: DataFrame, scorer: Scorer | None = overlap_scorer, settings: Settings = SETTINGS) -> DataFrame:
    """Adds rerank_score and rerank_rank to the first rerank_top_n candidates without repeated content.

    candidates has query_id, chunk_id, file_id, content, title_path, fused_rank. Without a scorer, or where it gives null, the fused order
    stays and the score is null. Only the candidates that are left reach the scorer.
    """
    by_query = Window.partitionBy("query_id")
    kept = distinct_content(candidates).withColumn("__n", F.row_number().over(by_query.orderBy("fused_rank"))).where(F.col("__n") <= settings.rerank_top_n).drop("__n")
    if scorer is None:
        scored = kept.withColumn("rerank_score", F.lit(None).cast("double"))
    else:
        text = document_text(F.col("title_path"), F.col("content"), settings.rerank_max_chars)
        scored = kept.join(plans.select("query_id", "query"), "query_id").withColumn("rerank_score", scorer(F.col("query"), text).cast("double")).drop("query")
    return scored.withColumn("rerank_rank", F.row_number().over(by_query.orderBy(F.round("rerank_score", 9).desc_nulls_last(), "fused_rank")))
