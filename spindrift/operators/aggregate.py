"""From chunks to files: scores, highlights, thresholds, and the presented record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings


def file_scores(candidates: DataFrame, plans: DataFrame, settings: Settings = SETTINGS, max_highlights: int = 3) -> DataFrame:
    """One row for each query and file: score, n_hits, best_chunk_type, mtime, highlights, has_rerank.

    candidates has query_id, chunk_id, file_id, filepath, filename, chunk_type, content, mtime, fusion_score and perhaps rerank_score. The three best
    chunks count in part; a filename or heading hit, the query's own words in a chunk, further hits and a recent time add to it.
    """
    score = F.coalesce("rerank_score", "fusion_score") if "rerank_score" in candidates.columns else F.col("fusion_score")
    key = F.coalesce(F.nullif("file_id", F.lit("")), "filepath")
    rows = candidates.join(plans.select("query_id", "query"), "query_id").withColumns({"s": score, "file_key": key})
    order = Window.partitionBy("query_id", "file_key").orderBy(F.round("s", 12).desc(), "chunk_id")
    rows = rows.withColumn("k", F.row_number().over(order))
    text = F.trim("content")
    exact = (F.length("query") >= 2) & F.contains(F.lower("content"), F.lower("query"))
    ordered = F.transform(F.array_sort(F.collect_list(F.when(text != "", F.struct("k", text.alias("text"))))), lambda x: x["text"])
    best = lambda c: F.max(F.when(F.col("k") == 1, F.col(c)))
    grouped = rows.groupBy("query_id", "file_key").agg(
        *(F.coalesce(F.sum(F.when(F.col("k") == i + 1, F.col("s"))), F.lit(0.0)).alias(f"s{i}") for i in range(3)),
        F.max(F.col("chunk_type") == "filename").alias("by_name"),
        F.max(F.col("chunk_type") == "heading").alias("by_heading"),
        F.coalesce(F.max(exact), F.lit(False)).alias("exact"),
        F.count(F.lit(1)).alias("n_hits"),
        best("chunk_type").alias("best_chunk_type"),
        best("mtime").alias("mtime"),
        best("filename").alias("filename"),
        best("filepath").alias("filepath"),
        ordered.alias("texts"),
        F.max(F.col("rerank_score").isNotNull()).alias("has_rerank") if "rerank_score" in candidates.columns else F.lit(False).alias("has_rerank"),
    )
    total = sum((settings.ranks[i] * F.col(f"s{i}") for i in range(3)), F.lit(0.0))
    total += F.when(F.col("by_name"), settings.filename_bonus).otherwise(0.0) + F.when(F.col("by_heading"), settings.heading_bonus).otherwise(0.0) + F.when(F.col("exact"), settings.exact_bonus).otherwise(0.0)
    total += F.when(F.col("n_hits") > 3, settings.multi_hit_bonus * F.least(F.col("n_hits") - 3, F.lit(5))).otherwise(0.0)
    age = F.greatest(F.lit(0.0), settings.now_ts - F.col("mtime")) / 86400.0 / settings.half_life_days
    total += F.when(F.coalesce("mtime", F.lit(0.0)) > 0, settings.recency_bonus * F.pow(F.lit(0.5), age)).otherwise(0.0)
    shown = F.slice(F.array_distinct("texts"), 1, max_highlights)
    fallback = F.array(F.concat(F.lit("文件命中: "), F.col("filename")))
    return grouped.select(
        "query_id", "file_key", "filepath", "filename", "mtime", "n_hits", "best_chunk_type", "has_rerank", total.alias("score"), F.when(F.size(shown) > 0, shown).otherwise(fallback).alias("highlights")
    )


def relevance_label(score: Column, exactness: Column) -> Column:
    """A percentage, rounded half to even (of nine digits) and at most 100; a fixed label for exact searches."""
    return F.when(exactness == "high", F.lit("关键词命中")).otherwise(F.concat(F.least(F.lit(100), F.bround(F.round(score, 9) * 100)).cast("int").cast("string"), F.lit("%")))


def results(files: DataFrame, plans: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """The presented record of each result: files over the threshold (where a scorer has judged any chunk of the query), ranked and limited."""
    by_query = Window.partitionBy("query_id")
    judged = files.withColumn("judged", F.max("has_rerank").over(by_query)).where(~F.col("judged") | (F.col("score") >= settings.score_threshold))
    ranked = judged.join(plans.select("query_id", "exactness", "limit"), "query_id").withColumn("rank", F.row_number().over(by_query.orderBy(F.round("score", 9).desc(), "file_key"))).where("rank <= limit")
    return ranked.select(
        "query_id", "rank", "file_key", "filepath", "filename", "mtime", "score", "n_hits", "best_chunk_type", relevance_label(F.col("score"), F.col("exactness")).alias("relevance"), F.array_join("highlights", "\n... ").alias("preview")
    )


def resort(results: DataFrame, by: str = "relevance", page: int = 1, per_page: int = 25) -> DataFrame:
    """One page of each query's results by relevance, mtime_desc or mtime_asc; a missing time counts as 0. Pages out of range are the nearest."""
    time = F.coalesce("mtime", F.lit(0.0))
    order = {"relevance": [F.col("rank")], "mtime_desc": [time.desc(), F.col("rank")], "mtime_asc": [time.asc(), F.col("rank")]}[by]
    placed = results.withColumns({"place": F.row_number().over(Window.partitionBy("query_id").orderBy(*order)), "n": F.count(F.lit(1)).over(Window.partitionBy("query_id"))})
    last = F.greatest(F.lit(1), F.ceil(F.col("n") / per_page).cast("int"))
    shown = F.greatest(F.lit(1), F.least(F.lit(page), last))
    return placed.withColumns({"page": shown, "pages": last}).where((F.col("place") > (shown - 1) * per_page) & (F.col("place") <= shown * per_page)).drop("n")


def listing(results: DataFrame) -> DataFrame:
    """The short record of each result: query_id, rank, filepath, score, snippet (always empty, kept for its readers) and mtime."""
    return results.select("query_id", "rank", F.coalesce("filepath", F.lit("")).alias("filepath"), F.coalesce("score", F.lit(0.0)).alias("score"), F.lit("").alias("snippet"), F.coalesce("mtime", F.lit(0.0)).alias("mtime"))


def interpretable(results: DataFrame, most: int = 10, preview_chars: int = 200) -> DataFrame:
    """What a reader of results is shown: each query's first results, counted from 0, with a short preview."""
    placed = results.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("place") <= most)
    return placed.select("query_id", (F.col("place") - 1).alias("index"), F.coalesce("filename", F.lit("")).alias("filename"), F.coalesce("relevance", F.lit("0")).alias("relevance"), F.substring(F.coalesce("preview", F.lit("")), 1, preview_chars).alias("preview"))
