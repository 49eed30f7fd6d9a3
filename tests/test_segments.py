"""The segmented keyword index against an index made from nothing."""

import random

from pyspark.sql import functions as F

from spindrift.operators import index, segments

FIELDS = {"filename": "filename", "content": "content"}
CHUNKS = "chunk_id string, filepath string, filename string, content string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta 数据 é".split()


def contents(found):
    tables = {"terms": ("term", "chunk_id", "field", "tf"), "positions": ("term", "chunk_id", "field", "pos")}
    out = {name: sorted(map(tuple, getattr(found, name).select(*columns).collect())) for name, columns in tables.items()}
    out["lengths"] = sorted(tuple(r[c] for c in ("chunk_id", "n_filename", "n_content")) for r in found.lengths.collect() if r.n_filename or r.n_content)
    out["totals"] = {c: found.totals.first()[c] for c in ("n_chunks", "n_filename", "n_content")}
    return out


def chunks_of(pick, path):
    return [(f"{path}-{k}", path, f"{path[1:]}.txt", " ".join(pick.choices(WORDS, k=pick.choice([0, 3, 20])))) for k in range(pick.randint(1, 3))]


def test_change_sets_give_the_index_of_the_new_state(spark, tmp_path):
    fan = 2
    pick, base = random.Random(fan), str(tmp_path)
    state, seen = {}, []
    for version in range(1, 5):
        changes = {}
        for path in pick.sample([f"/f{k}" for k in range(12)], 5 if version > 1 else 10):
            changes[path] = "new" if path not in state else pick.choice(["modified", "deleted"])
            state.pop(path, None)
            if changes[path] != "deleted":
                state[path] = chunks_of(pick, path)
        changed = spark.createDataFrame([*changes.items(), ("/unknown", "unchanged"), next(iter(changes.items()))], "filepath string, change string")
        given = [c for p in changes for c in state.get(p, [])] + chunks_of(pick, "/unasked")
        chunks = spark.createDataFrame(given, CHUNKS)
        segments.apply(spark, base, changed, chunks, FIELDS, version, fan)
        segments.apply(spark, base, changed, chunks.limit(0), FIELDS, version, fan)  # a repeated change set
        now = spark.createDataFrame([c for own in state.values() for c in own], CHUNKS)
        seen.append(contents(segments.read(spark, base)))
        assert seen[-1] == contents(index.made(now, FIELDS))
        assert segments.manifest(spark, base).where("segment <> -1").count() <= 2 * fan
    assert contents(segments.read(spark, base, 2)) == seen[1]
    assert segments.manifest(spark, base).where("segment < -1").count() > 0


def test_only_changed_chunks_are_cut_into_tokens(spark, tmp_path):
    """The new segment has the changed file's chunks only, even if others are given; the old segment's files stay as they are."""
    base = str(tmp_path)
    first = spark.createDataFrame([("a", "/a", "a", "one"), ("b", "/b", "b", "two")], CHUNKS)
    segments.apply(spark, base, first.select("filepath", F.lit("new").alias("change")), first, FIELDS, 1)
    old = sorted(p.name for p in (tmp_path / "segments" / "1" / "terms").iterdir())
    second = spark.createDataFrame([("a", "/a", "a", "changed without a change"), ("b2", "/b", "b", "three")], CHUNKS)
    segments.apply(spark, base, spark.createDataFrame([("/b", "modified"), ("/a", "unchanged")], "filepath string, change string"), second, FIELDS, 2)
    assert {r.chunk_id for r in spark.read.parquet(f"{base}/segments/2/positions").collect()} == {"b2"}
    assert sorted(p.name for p in (tmp_path / "segments" / "1" / "terms").iterdir()) == old
    assert sorted(r.term for r in segments.read(spark, base).of(["content"]).terms.collect()) == ["one", "three"]


def test_everything_deleted_and_back(spark, tmp_path):
    base = str(tmp_path)
    first = spark.createDataFrame([("a", "/a", "a", "one")], CHUNKS)
    for version, change in ((1, "new"), (2, "deleted"), (3, "new")):
        segments.apply(spark, base, first.select("filepath", F.lit(change).alias("change")), first, FIELDS, version)
        if version != 2:
            assert contents(segments.read(spark, base)) == contents(index.made(first, FIELDS))
    assert segments.manifest(spark, base, 2).where("segment <> -1").count() == 0
