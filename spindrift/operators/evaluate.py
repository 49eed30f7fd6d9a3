"""Measuring rankings: top-1, recall, reciprocal rank, discounted gain, latency percentiles; and estimating costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions.text import tokens_estimate


def distinct_paths(results: DataFrame) -> DataFrame:
    """Each path's first place, ranks closed up again."""
    first = results.groupBy("query_id", "filepath").agg(F.min("rank").alias("__rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("__rank", "filepath"))).drop("__rank")


def case_metrics(cases: DataFrame, results: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row for each case (query_id): top1, recall_10, recall_50, mrr_10, ndcg_10.

    results has query_id, rank, filepath (paths once), qrels has query_id, filepath, grade. Cases without relevant files or without results have zeros.
    """
    graded = results.join(qrels, ["query_id", "filepath"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    hit = F.col("grade") > 0
    got = graded.groupBy("query_id").agg(
        F.max(((F.col("rank") == 1) & hit).cast("double")).alias("top1"),
        F.count_if(hit & (F.col("rank") <= 10)).alias("hits_10"),
        F.count_if(hit & (F.col("rank") <= 50)).alias("hits_50"),
        F.min(F.when(hit & (F.col("rank") <= 10), F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= 10, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    best = qrels.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "filepath")))
    ideal = best.groupBy("query_id").agg(F.count_if(hit).alias("relevant"), F.sum(F.when(F.col("place") <= 10, gain / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("idcg"))
    rows = cases.select("query_id").join(got, "query_id", "left").join(ideal, "query_id", "left")
    part = lambda x, y: F.when(F.coalesce(F.col(y), F.lit(0)) > 0, F.coalesce(F.col(x), F.lit(0)) / F.col(y)).otherwise(0.0)
    return rows.select(
        "query_id", F.coalesce("top1", F.lit(0.0)).alias("top1"), part("hits_10", "relevant").alias("recall_10"), part("hits_50", "relevant").alias("recall_50"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr_10"), part("dcg", "idcg").alias("ndcg_10")
    )


def summary(metrics: DataFrame) -> DataFrame:
    """Means over all cases; zeros without cases."""
    return metrics.agg(F.count(F.lit(1)).alias("n_cases"), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("top1", "recall_10", "recall_50", "mrr_10", "ndcg_10")))


def latency(times: DataFrame, column: str, by: list[str]) -> DataFrame:
    """p50 (interpolated), p95 (nearest rank) and n of each group; nulls count in n only.

    Equal values are counted before they are shuffled, and a sorted running total finds the places, so no group is held in memory.
    """
    counts = times.groupBy(*by, F.col(column).alias("__value")).agg(F.count(F.lit(1)).alias("__m"))
    group, present = Window.partitionBy(*by), F.when(F.col("__value").isNotNull(), F.col("__m")).otherwise(0)
    placed = counts.withColumns({"__through": F.sum(present).over(group.orderBy("__value").rowsBetween(Window.unboundedPreceding, 0)), "__n": F.sum(present).over(group)})
    middle = (F.col("__n") - 1) / 2
    at = lambda least: F.min(F.when(F.col("__value").isNotNull() & (F.col("__through") >= least), F.col("__value")))
    found = placed.groupBy(*by).agg(at(F.floor(middle) + 1).alias("__low"), at(F.ceil(middle) + 1).alias("__high"), at(F.ceil(F.col("__n") * 0.95)).alias("p95"), F.sum("__m").alias("n"))
    return found.select(*by, ((F.col("__low") + F.col("__high")) / 2).alias("p50"), "p95", "n")


def benchmark(cases: DataFrame, results: DataFrame, qrels: DataFrame, runs: DataFrame) -> DataFrame:
    """One row for a benchmark: the means of all cases' metrics, p50_ms and p95_ms, and the part of cases whose reranker fell back.

    results (query_id, rank, filepath) may name a path twice, the first place counts. runs has one row for each case: query_id, latency_ms,
    fallback, failed; a failed case keeps its place with zeros. Nulls of fallback and failed count as false.
    """
    failed = runs.where(F.coalesce("failed", F.lit(False))).select("query_id")
    metrics = case_metrics(cases, distinct_paths(results.join(failed, "query_id", "left_anti")), qrels)
    times = latency(runs.withColumn("__all", F.lit(1)), "latency_ms", ["__all"]).select(F.col("p50").alias("p50_ms"), F.col("p95").alias("p95_ms"))
    rates = runs.agg(F.coalesce(F.avg(F.coalesce("fallback", F.lit(False)).cast("double")), F.lit(0.0)).alias("rerank_fallback_rate"))
    one = lambda df: df.withColumn("__one", F.lit(1))  # noqa: E731  each of the three has a single row
    return one(summary(metrics)).join(one(rates), "__one").join(one(times), "__one", "left").drop("__one")


def batch_sizes(texts: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Average characters of each group's texts, the batch that embeds them, and the batch that dense rows are written in (1 to 50). Null is an empty text."""
    average = F.avg(F.coalesce(F.length(column), F.lit(0)))
    grouped = texts.groupBy(*by).agg(average.alias("avg_chars"))
    size = F.when(F.col("avg_chars").isNull(), 50).when(F.col("avg_chars") > 400, 25).when(F.col("avg_chars") > 200, 40).otherwise(55)
    return grouped.withColumn("batch_size", size).withColumn("dense_batch_size", F.greatest(F.lit(1), F.least(F.col("batch_size"), F.lit(50))))


def estimate(files: DataFrame, chunks_per_file: float | None = None, seconds_per_file: float | None = None, settings: Settings = SETTINGS) -> DataFrame:
    """What indexing some files will cost: n_files, n_chunks, n_tokens, seconds."""
    per_file, seconds = chunks_per_file or settings.chunks_per_file, seconds_per_file or settings.seconds_per_file
    tokens = settings.embed_max / settings.chars_per_token
    n = F.count(F.lit(1))
    return files.agg(n.alias("n_files"), F.ceil(n * F.lit(float(per_file))).alias("n_chunks"), F.ceil(n * F.lit(float(per_file)) * tokens).alias("n_tokens"), (n * F.lit(float(seconds))).alias("seconds"))


def chunk_tokens(chunks: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """n_chunks, n_tokens of chunks (text), and chunks per file (file_id)."""
    return chunks.agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.coalesce(F.sum(tokens_estimate(F.col("text"), settings.embed_max, settings.chars_per_token)), F.lit(0)).alias("n_tokens"),
        F.try_divide(F.count(F.lit(1)).cast("double"), F.count_distinct("file_id")).alias("chunks_per_file"),
    )
