"""Keeping an index up to date: inventory, changes, caches, and applying changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension

#: Seconds by which two times of one file may differ.
TOLERANCE = 0.01


def indexable(files: DataFrame, extensions: list[str], keywords: list[str] | None = None, most_bytes: int = 100 << 20) -> DataFrame:
    """Files (filepath, filename and perhaps length) that an index takes: not hidden, of a known extension, with any of the keywords in the path, not too large."""
    path = F.col("filepath")
    test = ~F.startswith("filename", F.lit(".")) & ~F.contains(path, F.lit("/.")) & extension(F.col("filename")).isin(extensions)
    if keywords:
        any_of = F.lit(False)
        for k in keywords:
            any_of = any_of | F.contains(path, F.lit(k))
        test = test & any_of
    if "length" in files.columns:
        test = test & (F.col("length") <= most_bytes)
    return files.where(test)


def union_inventories(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both inventories; on the same path the right one counts."""
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    return both.groupBy("filepath").agg(F.max_by(F.struct("mtime", "source_type"), "side").alias("x")).select("filepath", "x.mtime", "x.source_type")


def changes(inventory: DataFrame, state: DataFrame) -> DataFrame:
    """(filepath, mtime, source_type, change): new, modified, deleted or unchanged, by path and time."""
    old = state.select("filepath", F.col("mtime").alias("old_mtime"), F.col("source_type").alias("old_type"))
    both = inventory.select("filepath", "mtime", "source_type").join(old, "filepath", "full_outer")
    change = (
        F.when(F.col("old_mtime").isNull(), "new").when(F.col("mtime").isNull(), "deleted").when(F.abs(F.col("mtime") - F.col("old_mtime")) > TOLERANCE, "modified").otherwise("unchanged")
    )
    return both.select("filepath", F.coalesce("mtime", "old_mtime").alias("mtime"), F.coalesce("source_type", "old_type").alias("source_type"), change.alias("change"))


def change_counts(changed: DataFrame) -> DataFrame:
    return changed.agg(*(F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("new", "modified", "deleted", "unchanged")))


def apply(index: DataFrame, fresh: DataFrame, changed: DataFrame) -> DataFrame:
    """The index after the changes: without rows of deleted and modified files, with the fresh rows of new and modified ones.

    Both tables have filepath. Applying the same changes again gives the same index.
    """
    gone = changed.where("change <> 'unchanged'").select("filepath")
    come = changed.where("change IN ('new', 'modified')").select("filepath")
    return index.join(gone, "filepath", "left_anti").unionByName(fresh.join(come, "filepath", "left_semi"))


def cache_lookup(inventory: DataFrame, cache: DataFrame) -> DataFrame:
    """The inventory with `chunks` from the parse cache where path and time agree, and hit."""
    held = cache.select("filepath", F.col("mtime").alias("cached_mtime"), "chunks")
    fits = (F.abs(F.col("mtime") - F.col("cached_mtime")) <= TOLERANCE) & F.col("chunks").isNotNull()
    return inventory.join(held, "filepath", "left").withColumn("hit", F.coalesce(fits, F.lit(False))).withColumn("chunks", F.when(F.col("hit"), F.col("chunks"))).drop("cached_mtime")


def prune(cache: DataFrame, inventory: DataFrame) -> DataFrame:
    """Cached rows whose file is still there."""
    return cache.join(inventory.select("filepath").distinct(), "filepath", "left_semi")


def embedding_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(model), F.lit("::"), text), 256)


def embedding_lookup(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Texts with their key, the cached vector (or null) and hit. Equal texts are embedded once: misses can be reduced by text_hash."""
    keyed = texts.withColumn("text_hash", embedding_key(model, F.col("text")))
    return keyed.join(cache.select("text_hash", "vector"), "text_hash", "left").withColumn("hit", F.col("vector").isNotNull())


def put(cache: DataFrame, fresh: DataFrame, key: str, time: str) -> DataFrame:
    """The cache with fresh rows; of the same key the latest stays."""
    both = cache.unionByName(fresh)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(time).isNotNull(), F.col(time))).alias("x")).select(key, "x.*").select(*both.columns)


def expire(cache: DataFrame, now_ts: float, days: float = 30.0, time: str = "created_at") -> DataFrame:
    """Rows not older than so many days; rows without a time stay."""
    return cache.where(F.col(time).isNull() | (F.col(time) >= now_ts - days * 86400.0))
