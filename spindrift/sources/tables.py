"""The tables of a data folder as the engine's inputs: files, notes, vectors, queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_TIME = 1_700_000_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    mtime = F.lit(FIRST_TIME) + 3600.0 * F.col("doc_id")
    return docs.select(
        "doc_id",
        F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), name).alias("filepath"),
        name.alias("filename"),
        F.lit("file").alias("source_type"),
        mtime.alias("mtime"),
        (mtime - 86400.0).alias("ctime"),
        F.col("text").alias("content"),
        "source",
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown note for each conversation: a heading and a text for each turn."""
    turns = table(spark, sf_dir, "conversations")
    part = F.concat(F.lit("## "), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x["part"]), "\n")
    return turns.groupBy("conv_id").agg(body.alias("content")).select("conv_id", F.concat(F.lit("/notes/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("filepath"), F.lit("mweb").alias("source_type"), "content")


def passage_queries(spark: SparkSession, sf_dir: str, words: int = 3) -> DataFrame:
    """The first words of each benchmark passage as a query."""
    from ..functions import text

    q = F.array_join(F.slice(text.words(F.col("text")), 1, words), " ")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), q.alias("query"))
