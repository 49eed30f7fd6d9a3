"""An index that follows a stream of inventories.

A stream brings the rows of inventories in any batches: several inventories in one, or one in several. Each row says which inventory it
belongs to (a number that grows) and how many files that has, so an inventory is known to be whole. A batch stores what has arrived
and then takes the latest whole inventory that is newer than the one applied: older ones are passed over, a partial one waits.

The index is dealt into buckets by a hash of the path, and so is its state. A version rewrites the buckets that its changes touch and takes
all others from earlier versions; a small table of (kind, bucket, version) says which. Nothing is written twice: a version is
published by that table, which Spark commits last, so readers see the version before or the whole new one. Old versions, and rows of
inventories that were applied or passed over, are kept until `sweep` removes them.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import incremental
from ..sources.stored import age, chosen, cut, exists, finished, numbered, open_files, parts, remove

Build = Callable[[DataFrame], DataFrame]
#: Gets the changes, the changed files and the version, before it is published; it must be repeatable.
Sink = Callable[[DataFrame, DataFrame, int], None]
#: What a row says about its inventory: its number, and how many files it has. A row without a path only says that.
MARKS = "inventory long, n_files long"
#: Folders of inventories that a task keeps files open for at most when arrivals are stored.
MOST_OPEN = 16


def bucket_of(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def current(spark: SparkSession, base: str) -> int | None:
    """The latest published version, or None before the first."""
    return max(finished(spark, f"{base}/versions"), default=None)


def _held(spark: SparkSession, base: str, version: int | None, kind: str) -> dict[int, int]:
    """Which version holds each bucket; a bucket without rows is missing. There is one row for each bucket at most."""
    if version is None:
        return {}
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{base}/versions/{version}").where((F.col("bucket") >= 0) & (F.col("kind") == kind)).collect()}


def applied(spark: SparkSession, base: str) -> int | None:
    """The number of the inventory that the latest version has."""
    version = current(spark, base)
    return None if version is None else spark.read.parquet(f"{base}/versions/{version}").where("bucket = -1").first()["inventory"]


def _read(spark: SparkSession, base: str, version: int | None, kind: str, buckets: list[int] | None = None) -> DataFrame | None:
    held = _held(spark, base, current(spark, base) if version is None else version, kind)
    paths = [f"{base}/{kind}/{v}/bucket={b}" for b, v in sorted(held.items()) if buckets is None or b in buckets]
    return spark.read.parquet(*paths) if paths else None


def read_index(spark: SparkSession, base: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The rows of a version (the latest one by default), of some buckets or all; None if there are none yet."""
    return _read(spark, base, version, "index", buckets)


def read_state(spark: SparkSession, base: str, version: int | None = None) -> DataFrame | None:
    """filepath, mtime and source_type of the files that a version's index has."""
    return _read(spark, base, version, "state")


def latest_rows(inventory: DataFrame) -> DataFrame:
    """Of rows of one path the one with the latest time. Only paths are shuffled, and the rows of paths that come more than once."""
    named = inventory.where("filepath IS NOT NULL")
    counts = cut(named.groupBy("filepath").agg((F.count(F.lit(1)) > 1).alias("repeated")))
    if counts.where("repeated").isEmpty():
        return named
    rest = [c for c in inventory.columns if c != "filepath"]
    several = chosen(named, counts.withColumnRenamed("repeated", "wanted"), "filepath")
    latest = several.groupBy("filepath").agg(F.max_by(F.struct(*rest), F.col("mtime")).alias("x")).select("filepath", "x.*")
    return chosen(named, counts.select("filepath", (~F.col("repeated")).alias("wanted")), "filepath").unionByName(latest)


def apply_inventory(
    spark: SparkSession, base: str, inventory: DataFrame, build: Build, version: int, buckets: int = 64, number: int | None = None, sinks: tuple[Sink, ...] = ()
) -> DataFrame:
    """Brings index and state to a full inventory (filepath, mtime, source_type, content) and returns the counts of changes.

    Of rows of one path the one with the latest time counts. Only changed files are built, and only buckets with changes are read and
    written. Neither texts nor rows of the index are shuffled: each task writes what it has of each bucket, as it comes. The number of buckets
    has to stay the same for an index. A batch that is repeated after a failure writes the same version
    again; if it was published already, nothing is written. Sinks, such as segments of the keyword index, get the same changes.
    """
    before = max((v for v in finished(spark, f"{base}/versions") if v < version), default=None)
    files = latest_rows(inventory)
    state = files.select("filepath", "mtime", "source_type")
    old_state = _read(spark, base, before, "state") if before is not None else None
    changed = cut(incremental.changes(state, state.limit(0) if old_state is None else old_state))
    if exists(spark, f"{base}/versions/{version}/_SUCCESS"):
        return incremental.change_counts(changed)
    own = bucket_of(F.col("filepath"), buckets)
    touched = [r[0] for r in changed.where("change <> 'unchanged'").select(own).distinct().collect()]  # at most `buckets` numbers
    fresh = chosen(files, changed.where("change <> 'deleted'").select("filepath", (F.col("change") != "unchanged").alias("wanted")), "filepath")
    for sink in sinks:
        sink(changed, fresh, version)
    rows = [("", -1, version, number)]
    built = build(fresh)
    old = read_index(spark, base, before, touched) if before is not None else None
    if old is not None:
        built = chosen(old, changed.where("change <> 'new'").select("filepath", (F.col("change") == "unchanged").alias("wanted")), "filepath").unionByName(built)
    new_state = changed.where(F.col("change") != "deleted").where(own.isin(touched)).select("filepath", "mtime", "source_type")
    for kind, made in (("index", built), ("state", new_state.repartition(own))):
        dealt = made.withColumn("bucket", own)
        with open_files(spark, buckets):
            dealt.write.partitionBy("bucket").mode("overwrite").parquet(f"{base}/{kind}/{version}")
        # A version without rows has no file to tell its schema.
        written = spark.read.schema(dealt.schema).parquet(f"{base}/{kind}/{version}").select("bucket").distinct().collect()
        held = {b: v for b, v in _held(spark, base, before, kind).items() if b not in touched} | {r["bucket"]: version for r in written}
        rows += [(kind, b, v, None) for b, v in sorted(held.items())]
    spark.createDataFrame(rows, "kind string, bucket int, version bigint, inventory bigint").coalesce(1).write.mode("overwrite").parquet(f"{base}/versions/{version}")
    return incremental.change_counts(changed)


def arrive(rows: DataFrame, base: str, batch: int) -> None:
    """Stores the rows of a batch by inventory, as they come. A repeated batch is stored again in the same place."""
    with open_files(rows.sparkSession, MOST_OPEN):
        rows.write.partitionBy("inventory").mode("overwrite").option("compression", "zstd").parquet(f"{base}/arrived/{batch}")


def arrived(spark: SparkSession, base: str, schema, after: int | None) -> DataFrame | None:
    """The stored rows of inventories after the given one; None if there are none. Only names of folders are read to find them."""
    paths = [f"{base}/arrived/{b}" for b in finished(spark, f"{base}/arrived")]
    out = None
    paths = [p for p in paths if any(after is None or n > after for n in parts(spark, p, "inventory"))]
    for path in paths:
        rows = spark.read.schema(schema).parquet(path)
        out = rows if out is None else out.unionByName(rows)
    return out if out is None or after is None else out.where(F.col("inventory") > after)


def latest_whole(rows: DataFrame) -> int | None:
    """The number of the latest inventory of which all files are there."""
    counts = rows.groupBy("inventory").agg(F.count_distinct("filepath").alias("n"), F.max("n_files").alias("n_files"))
    return counts.where("n >= n_files").agg(F.max("inventory")).first()[0]


def maintain(
    inventories: DataFrame, base: str, build: Build, checkpoint: str, every: str | None = "30 minutes", buckets: int = 64, sinks: tuple[Sink, ...] = (), grace: float = 7 * 86400.0
) -> StreamingQuery:
    """Follows a stream of inventories (filepath, mtime, source_type, content, inventory, n_files). Without `every`, it takes what is there and ends.

    The index always has one whole inventory: the latest of which all rows have arrived. What no version needs goes after `grace` seconds.
    """
    schema = inventories.schema

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if rows.isEmpty():
            return
        arrive(rows, base, number)
        version = number + 1
        held = None if exists(spark, f"{base}/versions/{version}/_SUCCESS") else arrived(spark, base, schema, applied(spark, base))
        latest = None if held is None else latest_whole(held)
        if latest is not None:
            whole = held.where(F.col("inventory") == latest).drop("inventory", "n_files")
            apply_inventory(spark, base, whole, build, version, buckets, latest, sinks)
        sweep(spark, base, grace)

    writer = inventories.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def sweep(spark: SparkSession, base: str, grace: float, keep: int = 1, now: float | None = None) -> list[str]:
    """Removes what the last `keep` versions don't need and what is older than `grace` seconds; returns the removed folders.

    Marked are the tables of the kept versions and of all younger than the grace time, so that a reader who holds a version still finds its
    files until then. Stored arrivals go when all their inventories are older than the one applied.
    """
    now = time.time() if now is None else now
    old = lambda path: now - age(spark, path) >= grace
    versions = finished(spark, f"{base}/versions")
    kept = {*versions[-keep:], *(v for v in versions if not old(f"{base}/versions/{v}"))}
    needed = {(kind, v, b) for version in kept for kind in ("index", "state") for b, v in _held(spark, base, version, kind).items()}
    gone = [f"{base}/versions/{v}" for v in versions if v not in kept]
    for kind in ("index", "state"):
        for v in numbered(spark, f"{base}/{kind}"):
            if v in kept or v > max(versions, default=-1):
                continue
            folders = [f"{base}/{kind}/{v}/bucket={b}" for b in {b for k, w, b in needed if (k, w) == (kind, v)}]
            if not folders and old(f"{base}/{kind}/{v}"):
                gone.append(f"{base}/{kind}/{v}")
    last = applied(spark, base)
    for b in finished(spark, f"{base}/arrived"):
        path = f"{base}/arrived/{b}"
        if last is not None and old(path) and max(parts(spark, path, "inventory"), default=last) <= last:
            gone.append(path)
    # The table that names a version goes first, so that no version is left without its files.
    for path in gone:
        remove(spark, path)
    return gone
