"""Tables that jobs keep: where they lie, whether they are still right, and cutting lineage."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table is sent to all tasks; a larger one is shuffled.
SENT_ROWS = 1_000_000
#: Most words of 64 bits in the table of `chosen`, whatever the number of keys.
WORDS = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors share.

    Where that isn't set, a session on one machine (local[n], as in tests) gets a temporary folder; on a cluster the setting is required.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame) -> DataFrame:
    """The same rows, sent to all tasks in a join if they are few, so that the other side isn't shuffled. They should be cheap to count."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def chosen(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows whose key is wanted. `known` (key, wanted) has every key of the rows, once; keys are not null.

    Rows aren't shuffled: a table of bits of a bounded size is sent to all tasks. A row whose bit no wanted key has goes, one whose bit no other key
    has stays. Wanted keys that share a bit with others are joined; so many of them that they can't be sent need a shuffle of the rows with such bits.
    """
    hashed = F.xxhash64(key)
    word, bit = F.pmod(hashed, F.lit(WORDS)).cast("int"), F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64(`{key}`), 40), 64) AS int))")
    marked = known.select(key, "wanted", word.alias("__word"), bit.alias("__bit"))
    own, others = (F.bit_or(F.when(test, F.col("__bit")).otherwise(0)) for test in (F.col("wanted"), ~F.col("wanted")))
    words = cut(marked.groupBy("__word").agg(own.alias("__own"), others.alias("__others")))
    shared = (F.col("__others").bitwiseAND(F.col("__bit"))) != 0
    doubtful = cut(marked.where("wanted").join(F.broadcast(words), "__word").where(shared).select(key))
    columns = rows.columns
    found = rows.withColumns({"__word": word, "__bit": bit}).join(F.broadcast(words), "__word").where(F.col("__own").bitwiseAND(F.col("__bit")) != 0)
    if doubtful.count() <= SENT_ROWS:
        held = doubtful.withColumn("__held", F.lit(True))
        return found.join(F.broadcast(held), key, "left").where(~shared | F.col("__held")).select(columns)
    return found.where(~shared).select(columns).unionByName(found.where(shared).join(doubtful, key, "left_semi").select(columns))


@contextmanager
def open_files(spark: SparkSession, n: int) -> Iterator[None]:
    """Within it, a task that writes a partitioned table keeps a file open for each of up to n folders, in place of sorting its rows by folder."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n + 1))  # Spark begins to sort when it has opened as many as it may
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, system = _path(spark, path)
    return bool(system.exists(found))


def fingerprint(spark: SparkSession, path: str) -> str:
    """Changes when the files of a table do: a hash of its path, bytes and time."""
    found, system = _path(spark, path)
    status, content = system.getFileStatus(found), system.getContentSummary(found)
    return hashlib.md5(f"{path} {content.getLength()} {content.getFileCount()} {status.getModificationTime()}".encode()).hexdigest()


def finished(spark: SparkSession, folder: str) -> list[int]:
    """The numbers that name finished tables in a folder, in order."""
    found, system = _path(spark, folder)
    if not system.exists(found):
        return []
    names = [status.getPath().getName() for status in system.listStatus(found)]
    return sorted(int(n) for n in names if n.isdigit() and exists(spark, f"{folder}/{n}/_SUCCESS"))


def numbered(spark: SparkSession, folder: str) -> list[int]:
    """The numbers that name tables in a folder, finished or not, in order."""
    found, system = _path(spark, folder)
    if not system.exists(found):
        return []
    names = [status.getPath().getName() for status in system.listStatus(found)]
    return sorted(int(n) for n in names if n.lstrip("-").isdigit())


def parts(spark: SparkSession, path: str, column: str) -> list[int]:
    """The values of a partitioned table's first column, a number, from the names of its folders."""
    found, system = _path(spark, path)
    if not system.exists(found):
        return []
    names = [status.getPath().getName() for status in system.listStatus(found)]
    return sorted(int(n.removeprefix(f"{column}=")) for n in names if n.startswith(f"{column}=") and n.removeprefix(f"{column}=").lstrip("-").isdigit())


def age(spark: SparkSession, path: str) -> float:
    """When a folder was last written to, in seconds since 1970."""
    found, system = _path(spark, path)
    return system.getFileStatus(found).getModificationTime() / 1000


def remove(spark: SparkSession, path: str) -> None:
    """Removes a table with its files."""
    found, system = _path(spark, path)
    system.delete(found, True)
