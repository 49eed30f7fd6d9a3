"""The inverted-list index against exact search."""

import random

import pytest
from pyspark.sql import functions as F

from spindrift.operators import dense, vector_index

ROWS = "chunk_id long, filepath string, embedding array<double>, source_type string, mtime double, ctime double"


def rows(seed, n=240):
    pick = random.Random(seed)
    centres = [[pick.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    out = []
    for i in range(n):
        c = pick.choice(centres)
        e = None if i == 17 else [0.0] * 8 if i == 18 else [x + pick.gauss(0, 0.4) for x in c]
        out.append((i, f"/f{i // 3}", e, pick.choice(["file", "mweb"]), float(i), float(i)))
    return out


def told(df):
    return sorted((r.query_id, r.chunk_id, r.score, r.rank) for r in df.collect())


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("vectors"))
    first, second = rows(1), rows(2)
    df = spark.createDataFrame(first, ROWS)
    vector_index.write(df, base, lists=8)
    changed = spark.createDataFrame([("/f1", "modified"), ("/f2", "deleted"), ("/f3", "unchanged"), ("/new", "new"), ("/f1", "modified")], "filepath string, change string")
    given = [r for r in second if r[1] in ("/f1", "/f3")] + [(1000, "/new", second[0][2], "file", 1.0, 1.0)]
    for _ in range(2):
        vector_index.apply(spark, base, changed, spark.createDataFrame(given, ROWS), 1)
    now = [r for r in first if r[1] not in ("/f1", "/f2")] + [r for r in given if r[1] != "/f3"]
    return base, df, spark.createDataFrame([r for r in now if r[2] is not None], ROWS)


def asked(df):
    return df.where("chunk_id % 20 = 0 AND embedding IS NOT NULL").select(F.col("chunk_id").alias("query_id"), "embedding")


def test_all_lists_give_the_exact_neighbours(spark, index):
    base, before, now = index
    assert told(vector_index.search(asked(now), base, 7, probes=8)) == told(dense.nearest(asked(now), now, 7))
    assert sorted(r.chunk_id for r in vector_index.read(spark, base).collect()) == sorted(r.chunk_id for r in now.collect())
    assert told(vector_index.search(asked(now), base, 7, probes=8, version=0)) == told(dense.nearest(asked(now), before.where("embedding IS NOT NULL"), 7))


def test_filters_work_before_the_best_are_taken(index):
    base, _, now = index
    queries = asked(now).withColumns({"source": F.lit("mweb"), "date_from": F.lit(50.0), "path_filter": F.lit("/F")})
    assert told(vector_index.search(queries, base, 5, probes=8)) == told(dense.nearest(queries, now.select("chunk_id", "embedding"), 5, files=now))


def test_few_probes_find_most(index):
    base, _, now = index
    probes = vector_index.calibrate(now, base, 10, target=0.95)
    assert probes < 8
    found = vector_index.recall(vector_index.search(asked(now), base, 10, probes), dense.nearest(asked(now), now, 10)).first()
    assert found.n_queries == asked(now).count() and found.recall >= 0.9


def test_only_probed_lists_are_read(spark, index):
    base, _, _ = index
    plan = vector_index.read(spark, base, lists=[2, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1][:60]


def shuffled(spark):
    """Bytes that the session's stages have shuffled so far."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_queries_are_not_copied_for_each_list_and_part(spark, index):
    base, _, now = index
    queries = now.where("embedding IS NOT NULL").select(F.col("chunk_id").alias("query_id"), "embedding")
    before = shuffled(spark)
    assert vector_index.search(queries, base, 3, probes=8).count() == 3 * queries.count()
    # 238 queries of 8 numbers; copies for 8 lists of 16 parts each are 30,000 rows.
    assert shuffled(spark) - before < 300_000
