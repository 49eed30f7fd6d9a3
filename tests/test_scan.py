"""Keyword retrieval without an index, against that with one."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spindrift.functions.text import index_tokens
from spindrift.jobs import search as job
from spindrift.operators import index, planner, scan, sparse

WEIGHTS = (("filename", 8.0), ("path", 3.0), ("heading", 4.0), ("content", 1.0))
CHUNKS = "chunk_id string, filename string, filepath string, heading string, content string, source_type string, mtime double, ctime double"
FILTERS = "source string, date_field string, date_from double, date_to double, path_filter string"


@pytest.fixture(scope="module")
def chunks(spark):
    pick = random.Random(5)
    words = "the then theory of alpha alphabet café learning-rate net_13 网络神经 ﬁn 12 été".split()
    rows = []
    for i in range(120):
        text = " ".join(pick.choice(words) for _ in range(pick.choice((0, 1, 7, 40)))) if i % 9 else None
        # Each text thrice: equal scores are told apart by the ids alone.
        rows += [(f"c{i:03d}{copy}", f"{pick.choice(words)}_{i}.md", f"/Docs/{pick.choice(words)}/{i}", pick.choice(words) if i % 3 else "", text, "mweb" if i % 4 else "file", float(i), 200.0 - i) for copy in "bca"]
    rows += [("none", "", "", "", "", "file", 1.0, 1.0), ("signs", "-", "/", None, " ... ", None, None, None)]
    return spark.createDataFrame(rows, CHUNKS).repartition(3)


def asked(spark, filters=False):
    queries = ["the", "th the alp", "café", '"net_13"', "learning-rate the", "神经", "网络神经", "docs of", "nowhere", "the nowhere", "!!", "the-the", "12 md", "été", "net_13.md"]
    rows = [(i, q, i % 4 == 3, *((["all", "mweb", "file", None][i % 4], ["mtime", "ctime", None][i % 3], 20.0 if i % 2 else None, 150.0 if i % 5 else None, "/DOCS/t" if i % 6 == 0 else None) if filters else ())) for i, q in enumerate(queries)]
    return planner.plan(spark.createDataFrame(rows, "query_id long, query string, filename_only boolean" + f", {FILTERS}" * filters))


def told(scored, k):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in sparse.top(scored, k).collect())


@pytest.mark.parametrize("filters", [False, True])
@pytest.mark.parametrize("k", [4, 1000])
def test_a_scan_equals_the_index(spark, chunks, monkeypatch, filters, k):
    plans = asked(spark, filters)
    want = told(sparse.filtered_by_query(sparse.bm25(plans, index.made(chunks, job.FIELDS), WEIGHTS), plans, chunks), k)
    assert len({q for q, *_ in want}) >= 9 and want == told(scan.bm25(plans, chunks, job.FIELDS, k, WEIGHTS), k)
    # In small steps, and several blocks of queries.
    for module, name, value in ((scan, "TOKENS", 30), (scan, "CELLS", 200), (scan, "QUERIES", 4)):
        monkeypatch.setattr(module, name, value)
    assert want == told(scan.bm25(plans, chunks, job.FIELDS, k, WEIGHTS), k)


def test_a_scan_of_some_fields_and_none(spark, chunks):
    plans = asked(spark).drop("filename_only").withColumn("filename_only", F.lit(False))
    fields, weights = {"content": "content", "path": "filepath"}, (("content", 1.0), ("filename", 2.0))  # a field without weight counts in lengths only
    want = told(sparse.bm25(plans, index.made(chunks, fields), weights), 50)
    assert want and want == told(scan.bm25(plans, chunks, fields, 50, weights), 50)
    assert scan.bm25(plans, chunks.limit(0), fields, 50, weights).count() == 0
    assert scan.bm25(plans.limit(0), chunks, fields, 50, weights).count() == 0


def test_search_without_an_index_shuffles_neither_texts_nor_terms(spark):
    """Texts of 6 MB. Shuffled are the hits of each task and the few texts that are fused, 0.2 MB; it was 9.5 MB when terms were shuffled."""
    heads = F.array(*(F.lit(x) for x in ("the", "of", "and", "to", "in", "is")))
    words = F.array(*(F.concat(F.element_at(heads, (F.rand(i) * 6).cast("int") + 1), F.lpad((F.rand(60 + i) * 900).cast("int").cast("string"), 3, "0")) for i in range(60)))
    name = F.concat(F.md5(F.col("id").cast("string")), F.lit(".txt"))
    chunks = spark.range(0, 16_000, 1, 4).select(
        F.concat(F.md5(F.col("id").cast("string")), F.lit("_c0")).alias("chunk_id"), F.md5(F.col("id").cast("string")).alias("file_id"), F.concat(F.lit("/a/"), name).alias("filepath"), name.alias("filename"),
        F.lit("file").alias("source_type"), F.lit("content").alias("chunk_type"), F.lit("").alias("heading"), F.array().cast("array<string>").alias("title_path"),
        F.array_join(words, " ").alias("content"), F.lit(1.0).alias("mtime"), F.lit(1.0).alias("ctime"),
    )
    queries = spark.createDataFrame([(1, "the1 of"), (2, "and to in")], "query_id long, query string")
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        time.sleep(0.5)
        spark.range(1).collect()  # the store follows with the next task
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return store.executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    assert job.search(queries, chunks, scorer=None).count() > 0
    moved = shuffled() - before
    assert moved < 1 << 20, moved


def test_tokens_of_sliced_lists(spark):
    """Lists that are a part of a longer one are counted from their own beginning."""
    rows = spark.createDataFrame([("a b a",), ("b c",), ("",), ("b-c b",)], "t string").select(index_tokens(F.col("t")).alias("t")).toArrow()["t"].combine_chunks()
    terms = scan._Terms({(("a",), False): 0, (("b",), True): 1, (("b", "c"), False): 2})
    cells, n = terms.counted(rows.slice(1, 3))
    assert dict(zip(cells.tolist(), n.tolist(), strict=True)) == {1: 1, 2: 1, 2 * 3 + 1: 2, 2 * 3 + 2: 1}
