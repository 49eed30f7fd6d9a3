"""An approximate vector index: a coarse quantiser, inverted lists as a partitioned table, probes by partition pruning.

Centroids are fitted by spherical k-means on a bounded sample; every vector goes to the list of its nearest centroid. A search finds
each query's nearest centroids, reads only the lists that some query probes, and ranks what they hold exactly. The lists are dealt
into versions by file: an upsert writes new rows and a table of replaced files, which readers leave out; nothing is rewritten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import cut, exists, finished
from .dense import _matrix, _unit, best_of_blocks, nearest
from .sparse import query_filters

#: Vectors that the quantiser is fitted on at most, and its rounds. The bound keeps the sample small enough for the driver.
SAMPLE, ROUNDS = 20_000, 12
#: Lists, and how many of them a query probes unless `calibrate` tells another number.
LISTS, PROBES = 64, 40


def fit(vectors: DataFrame, lists: int = LISTS, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of a sample of vectors: those with the least hashes of their ids, so that reruns agree."""
    rows = vectors.where("embedding IS NOT NULL").select("chunk_id", "embedding").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample)
    x = _unit(_matrix(rows.select("embedding").toArrow()["embedding"].combine_chunks()))
    x = x[np.linalg.norm(x, axis=1) > 0]
    if not len(x):
        return np.zeros((1, 1))
    # The next start is the vector that is furthest from those taken.
    taken, near = [0], x @ x[0]
    while len(taken) < min(lists, len(x)):
        taken.append(int(near.argmin()))
        near = np.maximum(near, x @ x[taken[-1]])
    centroids = x[taken]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        empty = np.linalg.norm(sums, axis=1) == 0
        centroids = np.where(empty[:, None], centroids, _unit(sums))
    return centroids


def _nearest_lists(rows: DataFrame, centroids: np.ndarray, n: int, column: str) -> DataFrame:
    """The rows with an array of their n nearest lists."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)  # LISTS unit vectors
    at = rows.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _unit(_matrix(batch.column(at))) @ sent.value.T if batch.num_rows else np.zeros((0, len(sent.value)))
            best = np.argsort(-score, axis=1, kind="stable")[:, :n].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(best) + 1, dtype=np.int32) * best.shape[1]), pa.array(best.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{column}` array<int>")


def current(spark: SparkSession, base: str) -> int | None:
    return max(finished(spark, f"{base}/versions"), default=None)


def write(vectors: DataFrame, base: str, lists: int = LISTS, sample: int = SAMPLE) -> None:
    """A new index (version 0) of vectors (chunk_id, filepath, embedding and any columns of filters). Rows without a vector are left out."""
    spark = vectors.sparkSession
    centroids = fit(vectors, lists, sample)
    rows = [(k, [float(v) for v in c]) for k, c in enumerate(centroids)]
    spark.createDataFrame(rows, "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{base}/centroids")
    _store(vectors, base, 0, centroids)
    spark.createDataFrame([(0,)], "version bigint").coalesce(1).write.mode("overwrite").parquet(f"{base}/versions/0")


def _centroids(spark: SparkSession, base: str) -> np.ndarray:
    return np.array([r.centroid for r in spark.read.parquet(f"{base}/centroids").orderBy("list").collect()])


def _store(vectors: DataFrame, base: str, version: int, centroids: np.ndarray) -> None:
    dealt = _nearest_lists(vectors.where("embedding IS NOT NULL"), centroids, 1, "__list").withColumn("list", F.get("__list", F.lit(0))).drop("__list")
    # A list may hold a third of all vectors: its rows are dealt over several tasks.
    dealt.repartition("list", F.pmod(F.xxhash64("chunk_id"), F.lit(16))).write.partitionBy("list").mode("overwrite").parquet(f"{base}/lists/{version}")


def apply(spark: SparkSession, base: str, changed: DataFrame, vectors: DataFrame, version: int) -> None:
    """Publishes the version after a change set (filepath, change), with the vectors of new and modified files. A repeated change set changes nothing."""
    if exists(spark, f"{base}/versions/{version}/_SUCCESS"):
        return
    gone = cut(changed.where("change <> 'unchanged'").select("filepath").distinct())
    gone.write.mode("overwrite").parquet(f"{base}/gone/{version}")
    come = changed.where("change IN ('new', 'modified')").select("filepath").distinct()
    _store(vectors.join(come, "filepath", "left_semi"), base, version, _centroids(spark, base))
    spark.createDataFrame([(version,)], "version bigint").coalesce(1).write.mode("overwrite").parquet(f"{base}/versions/{version}")


def read(spark: SparkSession, base: str, version: int | None = None, lists: list[int] | None = None) -> DataFrame:
    """The live rows of a version, of some lists or all: those of each older version whose file no later one replaced."""
    latest = current(spark, base) if version is None else version
    out, schema = None, spark.read.parquet(f"{base}/lists/0").schema
    gone = None
    for v in reversed([v for v in finished(spark, f"{base}/versions") if v <= latest]):
        rows = spark.read.schema(schema).parquet(f"{base}/lists/{v}")
        if lists is not None:
            rows = rows.where(F.col("list").isin(lists))  # prunes partitions
        if gone is not None:
            rows = rows.join(gone, "filepath", "left_anti")
        out = rows if out is None else out.unionByName(rows)
        if v:
            own = spark.read.parquet(f"{base}/gone/{v}")
            gone = own if gone is None else gone.unionByName(own).distinct()
    return out


def search(queries: DataFrame, base: str, k: int, probes: int = PROBES, digits: int = 6, version: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): as dense.nearest, but of the vectors in each query's `probes` nearest lists.

    queries has query_id, embedding and perhaps filters (see sparse.FILTERS), which narrow the rows before the best k are taken; the
    indexed rows then have source_type, mtime, ctime and filepath. Blocks of queries of bounded size are sent to the rows of the lists that any
    query probes; a row meets only the queries that probe its list, and each task keeps k rows a query.
    """
    spark = queries.sparkSession
    centroids = _centroids(spark, base)
    asked = cut(_nearest_lists(queries.select("query_id", "embedding"), centroids, probes, "lists"))
    wanted = sorted(r[0] for r in asked.select(F.explode("lists")).distinct().collect())  # at most as many as there are lists
    rows = read(spark, base, version, wanted)
    filters = query_filters(queries)
    if filters is not None:
        asked = asked.join(filters, "query_id")
        rows = rows.withColumns({c: F.col(c).cast("double") for c in ("mtime", "ctime")})
    ids = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (rows, "chunk_id"))}
    return best_of_blocks(asked, rows, k, digits, ids, filters is not None, len(centroids))


def calibrate(vectors: DataFrame, base: str, k: int, target: float = 0.95, sample: int = 200) -> int:
    """How many lists to probe so that so large a part of the exact neighbours lies in them, by a sample of the vectors as queries.

    How well lists separate depends on the data: vectors without clusters need more than half of them.
    """
    spark = vectors.sparkSession
    asked = cut(vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select(F.col("chunk_id").alias("query_id"), "embedding"))
    exact = nearest(asked, vectors.select("chunk_id", "embedding"), k).select("query_id", "chunk_id")
    centroids = _centroids(spark, base)
    order = _nearest_lists(asked, centroids, len(centroids), "__lists").select("query_id", "__lists")
    place = exact.join(read(spark, base).select("chunk_id", "list"), "chunk_id").join(order, "query_id").select(F.array_position("__lists", F.col("list")).alias("place"))
    counts = {r["place"]: r["count"] for r in place.groupBy("place").count().collect()}  # a row for each list at most
    total, n = sum(counts.values()), 0
    for probes in range(1, len(centroids) + 1):
        n += counts.get(probes, 0)
        if n >= target * total:
            return probes
    return len(centroids)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: n_queries, and the mean part of each query's exact neighbours that were found."""
    hits = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id").withColumn("hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    each = hits.groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("part"))
    return each.agg(F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.avg("part"), F.lit(1.0)).alias("recall"))
