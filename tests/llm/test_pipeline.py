"""The pipeline on the smallest tables, stage by stage, against brute force where the stage has no model."""

import os

import pytest
from pyspark.sql import functions as F
from test_operators import alnum, bag, spaced

import corpus_pipeline
from spindrift.llm import chat, secrets

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    benchmark = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows, old = docs.collect(), {r.doc_id: r for r in before.collect()}
        kept[name] = {r.doc_id: r for r in rows}
        assert len(kept[name]) == len(rows) and kept[name].keys() <= old.keys()
        assert name == "mix_sources" or docs.columns == columns
        gone = old.keys() - kept[name].keys()
        if name == "quality_classifier":
            judged = [labels[i] for i in gone if i in labels]
            assert gone and sum(x.quality == 0 for x in judged) >= 0.9 * len(judged)
        elif name == "near_duplicates":
            bags = {i: bag(r.text) for i, r in old.items()}

            def similar(a, b):
                shared = sum((bags[a] & bags[b]).values())
                return shared >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - shared)

            assert all(any(similar(i, j) for j in old if j != i) for i in gone)
            assert not any(similar(i, j) for i in kept[name] for j in kept[name] if i < j)
        elif name == "decontamination":
            windows = {tuple(w[s : s + min(10, len(w))]) for w in map(alnum, benchmark) for s in range(len(w) - min(10, len(w)) + 1)}
            sizes = {len(x) for x in windows}
            leaks = {i for i, r in old.items() if any(tuple(w[s : s + n]) in windows for w in [alnum(r.text)] for n in sizes for s in range(len(w) - n + 1))}
            assert gone == leaks
        elif name == "secret_scan":
            assert not gone and all("[REDACTED]" in r.text or r.text == old[i].text for i, r in kept[name].items())
        else:
            total = sum(len(spaced(r.text)) for r in old.values())
            assert sum(len(spaced(r.text)) * r.passes for r in rows) <= total and all(1 <= r.passes <= 3 for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_plans_stay_small(spark):
    """The driver describes a plan anew for each of its updates. The largest description had 73,554 characters here, of the query of all thresholds."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    corpus_pipeline.run(spark, DATA).write.format("noop").mode("overwrite").save()
    ran = store.executionsList(before, 1000)
    sizes = [len(ran.apply(i).physicalPlanDescription()) for i in range(ran.size())]
    assert len(sizes) > 20 and max(sizes) < 60_000, sorted(sizes)[-5:]


def test_no_long_sql_is_parsed(spark, monkeypatch):
    """What Spark's parser caches for a long text stays with the driver."""
    parsed = []
    expr = F.expr
    monkeypatch.setattr(F, "expr", lambda text: (parsed.append(len(text)), expr(text))[1])
    secrets.redact(spark.createDataFrame([(1, "token=abcdefgh")], "doc_id long, text string"))
    chat.with_masked(spark.createDataFrame([("abc", [(0, 1)])], "formatted string, mask array<struct<start:int,length:int>>"))
    assert max(parsed, default=0) < 200
