"""The stored keyword index under change: log-structured segments, tombstones, compaction by size tier.

A change set becomes one new segment: the index of the chunks of new and modified files, so only these are cut into tokens. What
it replaces or deletes in older segments is written as tombstones: (segment, chunk_id) with the chunk's lengths. A manifest, written
last by Spark, names the live segments of a version and has its totals (those of its segments without those of their tombstones);
readers see one version or the other. Tombstones name the segment they hide rows of, so segments can be merged in any order:
when several are of one size tier, their live rows are written as one segment, without reading a text again.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import cut, exists, finished, small
from . import index
from .index import Index

#: Segments of a size tier are merged when there are so many; a tier spans this factor of chunks.
FAN = 4
TABLES = ("terms", "positions", "vocabulary", "lengths")


def current(spark: SparkSession, base: str) -> int | None:
    """The latest version, or None before the first."""
    return max(finished(spark, f"{base}/manifests"), default=None)


def manifest(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """(segment, tombstones, n_chunks, totals): the live segments of a version, a row each, and whether and which tables of tombstones hide rows of each."""
    return spark.read.parquet(f"{base}/manifests/{current(spark, base) if version is None else version}")


def _live(spark: SparkSession, base: str, version: int | None) -> list:
    """The live segments. There are about FAN for each tier, so their number grows with the logarithm of the chunks."""
    return [] if version is None else manifest(spark, base, version).where("segment <> -1").collect()


def _tombstones(spark: SparkSession, base: str, segment, columns: list[str]) -> DataFrame:
    paths = [f"{base}/tombstones/{v}" for v in segment.tombstones]
    return spark.read.parquet(*paths).where(F.col("segment") == segment.segment).select(*columns)


def _table(spark: SparkSession, base: str, segments: list, name: str, hide: bool = True) -> DataFrame:
    out = None
    for s in segments:
        rows = spark.read.parquet(f"{base}/segments/{s.segment}/{name}")
        if hide and s.tombstones and name != "vocabulary":
            rows = rows.join(small(_tombstones(spark, base, s, ["chunk_id"])), "chunk_id", "left_anti")
        out = rows if out is None else out.unionByName(rows)
    return out


def read(spark: SparkSession, base: str, version: int | None = None) -> Index:
    """The index of a version (the latest by default): its segments' rows that no tombstone hides.

    The vocabulary may also hold terms that only hidden chunks had; they find nothing.
    """
    version = current(spark, base) if version is None else version
    segments = _live(spark, base, version)
    tables = {name: _table(spark, base, segments, name) for name in TABLES}
    tables["positions"] = index.occurring(tables["positions"])
    if len(segments) > 1:
        tables["vocabulary"] = index.words(tables["vocabulary"].select("term", F.explode("fields").alias("field")))
    fields = tuple(c.removeprefix("n_") for c in tables["lengths"].columns if c.startswith("n_"))
    sums = [F.coalesce(F.sum(F.col("totals")[f]), F.lit(0)).alias(f"n_{f}") for f in fields]
    totals = manifest(spark, base, version).agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n_chunks"), *sums)
    return Index(**tables, totals=totals.select(*(f"n_{f}" for f in fields), "n_chunks"), fields=fields)


def _counts(spark: SparkSession, base: str, segment: int, fields: list[str]) -> dict:
    row = spark.read.parquet(f"{base}/segments/{segment}/totals").first().asDict()
    return {"n_chunks": row["n_chunks"], "totals": {f: row[f"n_{f}"] for f in fields}}


def _publish(spark: SparkSession, base: str, version: int, rows: list[dict]) -> None:
    kind = "segment bigint, tombstones array<bigint>, n_chunks bigint, totals map<string, bigint>"
    # The row of segment -1 makes a table of an empty index.
    empty = {"segment": -1, "tombstones": [], "n_chunks": 0, "totals": {}}
    spark.createDataFrame([empty, *rows], kind).coalesce(1).write.mode("overwrite").parquet(f"{base}/manifests/{version}")


def apply(spark: SparkSession, base: str, changed: DataFrame, chunks: DataFrame, fields: dict[str, str], version: int, fan: int = FAN) -> None:
    """Publishes the version that follows from a change set, and merges segments where a tier is full.

    changed has filepath and change (see incremental.changes), chunks the chunks of new and modified files (chunk_id, filepath and the columns that
    `fields` names); others are left out. Versions must grow. A change set that is repeated after a failure writes the same version
    again; if that version is published, nothing is written. Repeated paths in the change set count once.
    """
    if exists(spark, f"{base}/manifests/{version}/_SUCCESS"):
        return
    before = max((v for v in finished(spark, f"{base}/manifests") if v < version), default=None)
    gone = cut(changed.where("change <> 'unchanged'").select("filepath").distinct())
    come = changed.where("change IN ('new', 'modified')").select("filepath").distinct()
    fresh = cut(chunks.select("chunk_id", "filepath", *(c for c in dict.fromkeys(fields.values()) if c != "filepath")).join(come, "filepath", "left_semi"))
    segments = _live(spark, base, before)

    # Live chunks of changed files, in all older segments.
    dead = None
    for s in segments:
        own = _table(spark, base, [s], "files").join(gone, "filepath", "left_semi").select("chunk_id")
        hit = _table(spark, base, [s], "lengths").join(own, "chunk_id").select(F.lit(s.segment).cast("long").alias("segment"), "chunk_id", *(f"n_{f}" for f in fields))
        none = own.join(_table(spark, base, [s], "lengths").select("chunk_id"), "chunk_id", "left_anti")
        hit = hit.unionByName(none.select(F.lit(s.segment).cast("long").alias("segment"), "chunk_id", *(F.lit(0).cast("long").alias(f"n_{f}") for f in fields)))
        dead = hit if dead is None else dead.unionByName(hit)
    lost: dict[int, dict] = {}
    if dead is not None:
        dead.write.mode("overwrite").parquet(f"{base}/tombstones/{version}")
        sums = [F.sum(f"n_{f}").alias(f"n_{f}") for f in fields]
        lost = {r["segment"]: r.asDict() for r in spark.read.parquet(f"{base}/tombstones/{version}").groupBy("segment").agg(F.count(F.lit(1)).alias("n_chunks"), *sums).collect()}

    rows = []
    for s in segments:
        x = lost.get(s.segment)
        left = s.n_chunks - (x["n_chunks"] if x else 0)
        if left:
            totals = {f: s.totals[f] - (x[f"n_{f}"] if x else 0) for f in fields}
            rows.append({"segment": s.segment, "tombstones": [*s.tombstones, *([version] if x else [])], "n_chunks": left, "totals": totals})
    if not fresh.isEmpty():
        path = f"{base}/segments/{version}"
        fresh.select("filepath", "chunk_id").write.mode("overwrite").parquet(f"{path}/files")
        index.write(fresh, fields, path)
        rows.append({"segment": version, "tombstones": [], **_counts(spark, base, version, list(fields))})
    _publish(spark, base, version, compact(spark, base, rows, fields, version, fan))


def compact(spark: SparkSession, base: str, rows: list[dict], fields: dict[str, str], version: int, fan: int = FAN) -> list[dict]:
    """The live segments after merging those of each size tier that has `fan` or more, from the smallest tier on.

    Only stored rows are read and sorted by term again. A merged segment has the number -(version * 64 + k) - 2, which no change set has.
    """
    tier = lambda r: int(math.log(max(r["n_chunks"], 1), fan))
    k = 0
    while True:
        full = sorted({t for t in map(tier, rows) if sum(tier(r) == t for r in rows) >= fan})
        if not full:
            return rows
        merged = [r for r in rows if tier(r) == full[0]]
        number = -(version * 64 + k) - 2
        k += 1
        path = f"{base}/segments/{number}"
        some = [spark.createDataFrame([r], "segment bigint, tombstones array<bigint>, n_chunks bigint, totals map<string, bigint>").first() for r in merged]
        # A term has five characters or so.
        dealt = index.pieces(spark, 6 * sum(n for r in merged for n in r["totals"].values()), sum(r["n_chunks"] for r in merged))
        _table(spark, base, some, "positions").repartition(dealt, "chunk_id").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{path}/positions")
        spark.read.parquet(f"{path}/positions").drop("at").write.mode("overwrite").parquet(f"{path}/terms")
        for name in ("lengths", "files"):
            _table(spark, base, some, name).write.mode("overwrite").parquet(f"{path}/{name}")
        # The fields of live rows only, so that terms of hidden chunks go.
        index.words(spark.read.parquet(f"{path}/terms")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/vocabulary")
        totals = {f: sum(r["totals"][f] for r in merged) for f in fields}
        one = {"segment": number, "tombstones": [], "n_chunks": sum(r["n_chunks"] for r in merged), "totals": totals}
        rows = [r for r in rows if r not in merged] + [one]
