import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from spindrift.functions import text
from spindrift.operators import aggregate, chunking, dense, evaluate, fusion, index, planner, rerank, sparse
from spindrift.sources import stored as tables

CHUNKS = "chunk_id string, filename string, filepath string, heading string, content string"
FIELDS = {"filename": "filename", "path": "filepath", "heading": "heading", "content": "content"}


def bm25(spark, rows, queries, weights=(("filename", 8.0), ("path", 3.0), ("heading", 4.0), ("content", 1.0)), path=None):
    chunks = spark.createDataFrame(rows, CHUNKS)
    plans = planner.plan(spark.createDataFrame(queries, "query_id long, query string"))
    scored = sparse.bm25(plans, index.made(chunks, FIELDS) if path is None else stored(spark, chunks, path), weights)
    return {(r.query_id, r.chunk_id): r.score for r in scored.collect()}


def stored(spark, chunks, path):
    index.write(chunks, FIELDS, path, 3)
    return index.read(spark, path)


@pytest.fixture(scope="module")
def corpus():
    words = "neural network deep model forest river stone café learning net nets graph".split()
    rows = []
    for i in range(60):
        pick = [words[(i * k + k * k) % len(words)] for k in range(3, 3 + i % 17)]
        rows.append((f"c{i:02d}", f"{words[i % 12]}_{i}.md", f"/docs/{words[(i * 5) % 12]}/{i}", words[(i * 7) % 12] if i % 3 else "", " ".join(pick)))
    return rows


def test_bm25_equals_fts5(spark, corpus):
    """Prefix clauses and phrases over four weighted fields, against SQLite's own index."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(chunk_id UNINDEXED, filename, path, heading, content, tokenize='unicode61')")
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", corpus)
    cases = {1: ("neural", "neural*"), 2: ("net mod", "net* mod*"), 3: ("cafe", "cafe*"), 4: ("network_13.md", '"network_13.md"'), 5: ("docs stone", "docs* stone*")}
    got = bm25(spark, corpus, [(k, q) for k, (q, _) in cases.items()])
    for k, (_, match) in cases.items():
        want = {r[0]: -r[1] for r in db.execute("SELECT chunk_id, bm25(t, 0, 8, 3, 4, 1) FROM t WHERE t MATCH ?", (match,))}
        own = {c: s for (q, c), s in got.items() if q == k}
        assert own.keys() == want.keys() and len(want) > 0
        assert all(own[c] == pytest.approx(want[c], abs=1e-6) for c in want)


def test_stored_index_equals_the_plan(spark, corpus, tmp_path):
    queries = [(1, "neural"), (2, "net mod"), (3, "network_13.md"), (4, "nowhere")]
    assert bm25(spark, corpus, queries, path=str(tmp_path / "index")) == pytest.approx(bm25(spark, corpus, queries))
    held = index.read(spark, str(tmp_path / "index"))
    plans = planner.plan(spark.createDataFrame([(1, "neural")], "query_id long, query string"))
    assert "StringStartsWith(term,neural)" in sparse.bm25(plans, held)._jdf.queryExecution().toString()


def test_filters_by_query(spark):
    files = spark.createDataFrame([("c1", "file", 1.0, 9.0, "/A/x"), ("c2", "mweb", 2.0, 1.0, "/b/x"), ("c3", "file", None, 3.0, "/a/y")], "chunk_id string, source_type string, mtime double, ctime double, filepath string")
    asked = spark.createDataFrame(
        [(1, "all", None, None, None, None), (2, "mweb", "mtime", None, None, None), (3, None, "mtime", 1.5, None, None), (4, "file", "ctime", None, 3.0, None), (5, "all", "mtime", None, None, "/a/"), (6, "all", "mtime", 1.0, 1.0, None)],
        "query_id long, source string, date_field string, date_from double, date_to double, path_filter string",
    )
    want = {1: {"c1", "c2", "c3"}, 2: {"c2"}, 3: {"c2"}, 4: {"c3"}, 5: {"c1", "c3"}, 6: {"c1"}}
    scored = asked.select("query_id").crossJoin(files.select("chunk_id")).withColumn("score", F.lit(1.0))
    kept = sparse.filtered_by_query(scored, asked, files).collect()
    vectors = files.select("chunk_id", F.array(F.lit(1.0), F.lit(0.5)).alias("embedding"))
    near = dense.nearest(asked.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.5))), vectors, 3, files=files).collect()
    for rows in (kept, near):
        assert {k: {r.chunk_id for r in rows if r.query_id == k} for k in want} == want


def test_nearest_by_brute_force_in_small_steps(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(dense, "SCORES", 100)
    got = dense.nearest(df.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), df, 7).collect()
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in rows}
    for q in range(0, 400, 20):
        want = sorted(((-round(max(0.0, float(unit[q] @ unit[i])), 6), i) for i in unit))[:7]
        assert [(r.chunk_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, pytest.approx(-s)) for s, i in want]


def test_filename_outranks_content_and_cjk_recall(spark):
    rows = [
        ("c1", "architecture.md", "/a", "System Overview", "This document describes the neural network architecture."),
        ("c2", "neural_network.py", "/b", "", "class NeuralNetwork: pass"),
        ("cn1", "2026-04-29 跟罗毅沟通算法团队职能缺失问题和规划方向.md", "/n", "", "文件名"),
        ("cn2", "other.md", "/n", "", "这是一段不相关的文本。"),
        ("cn3", "2026-05-06 AI应用研发工程师范洪铭.md", "/n", "", "笔记"),
    ]
    got = bm25(spark, rows, [(1, "neural network"), (2, "罗毅"), (3, "范洪铭"), (4, "nothing here")])
    assert {c for q, c in got if q == 1} == {"c1", "c2"} and got[1, "c2"] > got[1, "c1"]
    assert "cn1" in {c for q, c in got if q == 2} and "cn3" in {c for q, c in got if q == 3}
    assert not [c for q, c in got if q == 4]


def test_query_types_and_budgets(spark):
    want = {
        '"神经网络"': "exact", "'machine learning'": "exact", "architecture.md": "filename", "data.csv": "filename", "def forward(self, x):": "code",
        "RuntimeError": "code", "how to train a neural network from scratch": "semantic", "search": "hybrid", "a b c d e f g h": "hybrid", "神经网络": "hybrid",
    }
    rows = planner.plan(spark.createDataFrame([(i, q, i == 0, 30) for i, q in enumerate(want)], "query_id long, query string, exact_focus boolean, limit int")).collect()
    assert {r.query: r.query_type for r in rows} == want
    assert all(r.rerank_k >= 30 and r.fusion_k >= 2 * r.rerank_k for r in rows)
    assert {r.exactness for r in rows if r.query_id == 0} == {"high"} and {r.exactness for r in rows if r.query_id} == {"medium"}
    alternatives = spark.createDataFrame([("范洪铭",)], "q string").select(planner.clauses(F.col("q")).alias("c")).first().c
    assert [a.tokens[0] for a in alternatives[0]] == ["范洪铭", "范洪", "洪铭"]
    assert planner.plan(spark.createDataFrame([(1, "  ")], "query_id long, query string")).count() == 0


def plans(spark, kind="hybrid", query="budget plan"):
    from spindrift.config import QUERY_TYPES

    s, d, ws, wd = QUERY_TYPES[kind]
    return spark.createDataFrame([(1, query, "medium", 50, ws, wd, 200)], "query_id long, query string, exactness string, limit int, sparse_weight double, dense_weight double, fusion_k int")


def ranked(spark, rows):
    return spark.createDataFrame([(1, c, 1.0, r) for c, r in rows], "query_id long, chunk_id string, score double, rank int")


def test_fusion(spark):
    rows = fusion.fuse(ranked(spark, [("c3", 1), ("c1", 2)]), ranked(spark, [("c2", 1), ("c3", 2)]), plans(spark)).orderBy("fused_rank").collect()
    assert [(r.chunk_id, round(r.fusion_score, 9)) for r in rows] == [("c3", round(1 / 61 + 1 / 62, 9)), ("c2", round(1 / 61, 9)), ("c1", round(1 / 62, 9))]
    rows = fusion.fuse(ranked(spark, [("c1", 1)]), ranked(spark, [("c2", 1)]), plans(spark, "exact")).orderBy("fused_rank").collect()
    assert [round(r.fusion_score, 9) for r in rows] == [round(1.4 / 61, 9), round(0.7 / 61, 9)]


FILES = "query_id long, chunk_id string, file_id string, filepath string, filename string, chunk_type string, title_path array<string>, content string, mtime double, fusion_score double, fused_rank int"


def candidate(file, chunk, score, content, mtime=0.0, kind="content", rank=1):
    return (1, chunk, file, f"/{file}", f"{file}.md", kind, [], content, mtime, score, rank)


def test_file_scores(spark):
    rows = [candidate("f1", "a", 0.9, "f1 content 1"), candidate("f1", "b", 0.7, "f1 content 2"), candidate("f1", "c", 0.6, "f1 content 1"), candidate("f1", "d", 0.5, "f1 content 3"), candidate("f2", "e", 0.8, "x")]
    got = {r.file_key: r for r in aggregate.file_scores(spark.createDataFrame(rows, FILES), plans(spark), max_highlights=2).collect()}
    assert got["f1"].score == pytest.approx(0.815) and got["f2"].score == pytest.approx(0.56)
    assert got["f1"].highlights == ["f1 content 1", "f1 content 2"] and got["f1"].n_hits == 4
    now = 1_735_689_600.0
    rows = [candidate("new", "a", 0.8, "", now - 3600), candidate("old", "b", 0.8, "", now - 30 * 86400), candidate("", "c", 0.8, "the Budget Plan"), (1, "d", None, "/none", "none.md", "content", None, None, None, 0.8, 1)]
    got = {r.file_key: r for r in aggregate.file_scores(spark.createDataFrame(rows, FILES), plans(spark)).collect()}
    assert got["new"].score > got["old"].score and got["/"].score == pytest.approx(0.66) and got["/none"].score == pytest.approx(0.56)
    assert got["new"].highlights == ["文件命中: new.md"]
    short = {r.file_key: r.score for r in aggregate.file_scores(spark.createDataFrame(rows[2:3], FILES), plans(spark, query="b")).collect()}
    assert short["/"] == pytest.approx(0.56)


def test_rerank_and_threshold(spark):
    rows = spark.createDataFrame([candidate("f1", "c1", 0.5, "bad content", rank=1), candidate("f2", "c2", 0.5, "excellent budget plan", rank=2), candidate("f2", "c3", 0.4, "excellent budget plan", rank=3)], FILES)
    judged = rerank.rerank(rows, plans(spark))
    assert [(r.chunk_id, r.rerank_rank) for r in judged.orderBy("rerank_rank").collect()] == [("c2", 1), ("c1", 2)]
    kept = aggregate.results(aggregate.file_scores(judged, plans(spark)), plans(spark)).collect()
    assert [r.file_key for r in kept] == ["f2"] and kept[0].relevance == "80%"
    plain = rerank.rerank(rows, plans(spark), None).orderBy("rerank_rank").collect()
    assert [(r.chunk_id, r.rerank_score) for r in plain] == [("c1", None), ("c2", None)]


def test_labels(spark):
    scores = [0.0, 0.1, 0.35, 0.5, 0.73, 0.99, 1.0, 1.5, 10.0]
    rows = spark.createDataFrame([(s,) for s in scores], "s double").select(aggregate.relevance_label(F.col("s"), F.lit("medium")).alias("l"), aggregate.relevance_label(F.col("s"), F.lit("high")).alias("h")).collect()
    assert [r.l for r in rows] == ["0%", "10%", "35%", "50%", "73%", "99%", "100%", "100%", "100%"] and {r.h for r in rows} == {"关键词命中"}


def test_metrics(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    results = spark.createDataFrame([(1, 1, "other"), (1, 2, "budget"), (1, 3, "notes"), (2, 1, "budget"), (2, 2, "other")], "query_id long, rank int, filepath string")
    qrels = spark.createDataFrame([(1, "budget", 3), (1, "notes", 1), (2, "budget", 3)], "query_id long, filepath string, grade int")
    got = {r.query_id: r for r in evaluate.case_metrics(cases, results, qrels).collect()}
    assert (got[1].top1, got[1].recall_10, got[1].mrr_10) == (0, 1, 0.5) and 0 < got[1].ndcg_10 < 1
    assert (got[2].top1, got[2].recall_10, got[2].mrr_10, got[2].ndcg_10) == (1, 1, 1, 1)
    assert tuple(got[3])[1:] == (0, 0, 0, 0, 0)
    assert evaluate.summary(evaluate.case_metrics(cases, results, qrels).limit(0)).first().top1 == 0
    times = evaluate.latency(spark.createDataFrame([("a", 30.0), ("a", 10.0)], "k string, t double"), "t", ["k"]).first()
    assert (times.p50, times.p95) == (20, 30)
    cost = evaluate.estimate(cases.limit(0)).first()
    assert cost.n_files == 0 and cost.seconds == 0
    tokens = evaluate.chunk_tokens(spark.createDataFrame([("abc", 1), ("defg", 1)], "text string, file_id long")).first()
    assert tokens.n_tokens == 5 and tokens.chunks_per_file == 2


def test_text_functions(spark):
    row = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c.alias("o")).first().o
    assert row(text.headings(F.col("v")), "# One\n####### no\n###### Six \nx # no") == ["One", "Six "]
    assert [row(text.truncate(F.col("v"), 600), v) for v in ("short", "x" * 700, "", "   ", None)] == ["short", "x" * 600, " ", " ", " "]
    assert row(text.index_tokens(F.col("v")), "AI应用 Café_x") == ["ai", "应用", "cafe", "x", "应用"]
    assert row(text.relative_path(F.col("v"), ["/a", "/a/b"]), "/a/b/c.md") == "c.md"
    assert row(text.mark_terms(F.col("v"), ["a.b", "x"]), "A.B acb X") == "<mark>A.B</mark> acb <mark>X</mark>"
    assert row(text.safe_filename(F.col("v")), ' a/b:c?  d ') == "a_b_c_ d"


def test_folding_takes_all_diacritics(spark):
    """As DuckDB's strip_accents does, for each character of the basic plane."""
    import duckdb
    import pandas as pd

    letters = pd.DataFrame({"x": [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]})
    both = spark.createDataFrame(duckdb.query("SELECT x, strip_accents(x) AS y FROM letters").df())
    got = {r.x: (r.a, r.b) for r in both.select("x", text.fold(F.col("x")).alias("a"), F.lower("y").alias("b")).collect()}
    assert {x for x, (a, b) in got.items() if a != b} == set()
    got = {x: a for x, (a, _) in got.items()}
    assert got["ế"] == "e" and got["ǖ"] == "u" and got["\u0301"] == "" and got["が"] == "か" and got["한"] == "한"


def test_an_index_grows_by_tasks_and_shuffles_no_terms(spark, tmp_path, monkeypatch):
    rows = [(k, f"{k}.txt", f"/a/{k}.txt", "", f"alpha beta alpha w{k}") for k in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, filename string, filepath string, heading string, content string")
    monkeypatch.setattr(index, "TASK_CHARS", 100, raising=False)
    index.write(chunks, {"content": "content"}, str(tmp_path))
    assert len(list((tmp_path / "positions").glob("*.parquet"))) > 4  # more than shuffle partitions
    held = index.read(spark, str(tmp_path))
    assert held.terms.where("term = 'alpha' AND tf = 2").count() == 40
    assert sorted(r.pos for r in held.positions.where("term = 'alpha' AND chunk_id = 7").collect()) == [0, 2]
    assert "Exchange" not in index.made(chunks, {"content": "content"}).terms._jdf.queryExecution().executedPlan().toString()


def test_scores_are_added_up_where_the_chunks_are(spark):
    rows = [(k, f"{k}.txt", f"/a/{k}.txt", "", "the then theory of alpha" if k % 2 else "the alphabet") for k in range(50)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, filename string, filepath string, heading string, content string")
    asked = planner.plan(spark.createDataFrame([(1, "t th the alpha"), (2, "the nothing"), (3, "theo")], "query_id bigint, query string"))
    scored = sparse.bm25(asked, index.made(chunks, {"content": "content"}), (("content", 1.0),))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2, plan  # the terms found, and the lengths
    assert "SortMergeJoin" not in plan
    found = {(r.query_id, r.chunk_id) for r in scored.collect()}
    assert found == {(1, k) for k in range(50)} | {(3, k) for k in range(1, 50, 2)}


def test_few_rows_go_to_the_texts(spark):
    texts = spark.range(100).withColumn("content", F.lit("x"))
    few = spark.range(1000).groupBy((F.col("id") % 10).alias("id")).count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = tables.small(few).join(texts, "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_content_chunks_keep_their_files_without_a_shuffle(spark):
    rows = [("/a/1.txt", "1.txt", "file", 1.0, 0.0, "one two " * 200), ("/a/2.txt", "2.txt", "file", 2.0, 0.0, None), ("/a/3.md", "3.md", "file", 3.0, 0.0, "# Head\ntext")]
    files = spark.createDataFrame(rows, "filepath string, filename string, source_type string, mtime double, ctime double, content string")
    made = chunking.chunk_records(files)
    content = made.where("chunk_type = 'content'")
    plan = content._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert {(r.filename, r.mtime) for r in content.collect()} == {("1.txt", 1.0), ("3.md", 3.0)}
    assert sorted(r.chunk_id.split("_")[1] for r in made.where("filepath = '/a/1.txt'").collect()) == sorted(["fn", *(f"c{k}" for k in range(4))])
    assert [r.chunk_id.split("_")[1] for r in made.where("chunk_type = 'heading'").collect()] == ["h0"]


def test_many_queries_are_met_in_bounded_memory(spark, monkeypatch):
    """What a task holds at once for 3000 queries and 10,000 vectors."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    pick = np.random.default_rng(4)
    x = pick.normal(size=(10_000, 8))
    queries = spark.createDataFrame([(i, row) for i, row in enumerate(x[:3000].tolist())], "query_id long, embedding array<double>")
    vectors = spark.createDataFrame([(0, [1.0] * 8)], "chunk_id long, embedding array<double>")
    runs = []
    as_it_was = type(vectors).mapInArrow
    monkeypatch.setattr(type(vectors), "mapInArrow", lambda self, f, *rest, **more: (runs.append(f), as_it_was(self, f, *rest, **more))[1])
    dense.nearest(queries, vectors, 36)
    batch = pa.record_batch([pa.array(range(10_000)), pa.array(x.tolist())], names=["chunk_id", "embedding"])
    tracemalloc.start()
    try:
        out = [b for f in runs for b in f(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(b.num_rows for b in out) == 3000 * 36 and peak < 120 << 20
    best = {}
    for b in out:
        for q, c, s in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            best.setdefault(q, []).append((-s, c))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 3000, 300):
        score = np.round(np.maximum(0.0, unit @ unit[q]), 6)
        assert sorted(best[q]) == sorted((-v, c) for c, v in enumerate(score.tolist()))[:36]


def test_queries_go_in_blocks_of_bounded_hits(spark, monkeypatch):
    pick = random.Random(6)
    df = spark.createDataFrame([(i, [pick.gauss(0, 1) for _ in range(4)]) for i in range(60)], "chunk_id long, embedding array<double>")
    asked = df.withColumnRenamed("chunk_id", "query_id")
    told = lambda found: sorted(map(tuple, found.select("query_id", "chunk_id", "score", "rank").collect()))
    want = told(dense.nearest(asked, df, 5))
    monkeypatch.setattr(dense, "HITS", 100)
    got = dense.nearest(asked, df, 5)
    assert got._jdf.queryExecution().analyzed().toString().count("MapInArrow") >= 3 and told(got) == want
