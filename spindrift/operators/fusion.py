"""Reciprocal-rank fusion of keyword and vector hits, and removal of repeated content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings


def fuse(sparse: DataFrame, dense: DataFrame, plans: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(query_id, chunk_id, sparse_rank, dense_rank, sparse_score, dense_score, fusion_score, fused_rank), the best fusion_k of each query.

    A hit that one side lacks counts there with a rank of settings.missing_rank only if that side has no rank at all for it: it adds
    nothing. Equal scores go by sparse rank, then dense rank, then chunk_id.
    """
    both = sparse.select("query_id", "chunk_id", F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_score")).join(
        dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score")), ["query_id", "chunk_id"], "full_outer"
    )
    part = lambda weight, rank: F.when(F.col(rank).isNull(), 0.0).otherwise(F.col(weight) / (settings.rrf_k + F.coalesce(F.col(rank), F.lit(settings.missing_rank))))
    scored = both.join(plans.select("query_id", "sparse_weight", "dense_weight", "fusion_k"), "query_id").withColumn("fusion_score", part("sparse_weight", "sparse_rank") + part("dense_weight", "dense_rank"))
    order = Window.partitionBy("query_id").orderBy(F.round("fusion_score", 12).desc(), F.col("sparse_rank").asc_nulls_last(), F.col("dense_rank").asc_nulls_last(), "chunk_id")
    return scored.withColumn("fused_rank", F.row_number().over(order)).where("fused_rank <= fusion_k").drop("sparse_weight", "dense_weight", "fusion_k")


def distinct_content(candidates: DataFrame, chars: int = 50) -> DataFrame:
    """The first candidate, in fused order, of each file and beginning of content."""
    same = Window.partitionBy("query_id", "file_id", F.substring("content", 1, chars)).orderBy("fused_rank")
    return candidates.withColumn("__k", F.row_number().over(same)).where("__k = 1").drop("__k")
