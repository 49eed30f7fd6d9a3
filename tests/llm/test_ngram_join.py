"""The n-gram join against all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import kernels, ngram_join, queries

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=5):
    words = SPACE.findall((text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def plain(rows, percent=80):
    """(doc_id, n_shingles, component_id) by comparing all sets that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, len(s), least.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def family(pick, n, length, edits, words):
    """Near copies of one text and of each other: chains and stars, with edits of their own and shared ones."""
    texts = [pick.choices(words, k=length)]
    for _ in range(n - 1):
        own = list(pick.choice(texts))
        for _ in range(pick.randint(0, edits)):
            at = pick.randrange(len(own))
            own[at : at + pick.choice([0, 1, 1, 2])] = [pick.choice(words)] * pick.choice([0, 1, 1])
        texts.append(own)
    return [" ".join(x) for x in texts]


def corpus(seed):
    pick = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    common = " ".join(pick.choices(words, k=30))
    texts = []
    for n, length, edits in ((40, 60, 2), (40, 60, 5), (30, 25, 1), (30, 12, 2), (60, 200, 8), (20, 7, 1)):
        texts += family(pick, n, length, edits, words)
    texts += [f"{' '.join(pick.choices(words, k=k % 9))} {common}" for k in range(60)]
    texts += [None, "", " \n\t", "one", "ONE", "one two", "One\x0bTwo", "é É", "x " * 30, "X " * 50, common, common.upper()]
    rows = list(enumerate(texts))
    pick.shuffle(rows)
    return [*rows, rows[3], rows[3], (None, texts[5]), (None, "no other has this text of words"), (None, None)]


def told(df):
    return sorted(((x["doc_id"], x["n_shingles"], x["component_id"]) for x in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    clashing = {c: F.lit("x") for c in ("key", "n", "codes", "node", "label", "c", "part", "token", "first_id", "component_id", "__right_node", "__right_key")}
    assert told(ngram_join.jaccard_components(df.withColumns(clashing))) == plain(rows)


def test_components_in_small_trees_at_other_thresholds(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TREE_SETS", 3)
    monkeypatch.setattr(ngram_join, "TREE_TOKENS", 100)
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (60, 95, 100):
        assert told(ngram_join.jaccard_components(df, percent=percent)) == plain(rows, percent)


def test_a_full_sketch_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SKETCH_BITS", 16)
    monkeypatch.setattr(ngram_join, "LEVELS", {2: 16, 4: 16, 16: 16})
    monkeypatch.setattr(ngram_join, "REMEMBERED", 3)
    rows = corpus(5)
    assert told(ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_tree_finds_what_all_pairs_do():
    pick = random.Random(7)
    for _ in range(60):
        base = sorted(pick.sample(range(1, 500), 40))
        sets = []
        for _ in range(pick.randint(1, 40)):
            own = set(base if pick.random() < 0.7 else pick.sample(range(1, 500), pick.randint(1, 60)))
            own -= set(pick.sample(base, pick.randint(0, 8)))
            own |= set(pick.sample(range(1, 500), pick.randint(0, 4)))
            sets.append(np.array(sorted(own), dtype=np.uint64))
        sizes = [len(x) + pick.randint(0, 5) for x in sets]
        tree = ngram_join.Tree(sets, sizes)
        probe = np.array(sorted(set(base) ^ set(pick.sample(range(1, 600), 6))), dtype=np.uint64)
        size = len(probe) + pick.randint(0, 3)
        for percent in (50, 80, 100):
            want = [i for i, s in enumerate(sets) if (100 + percent) * len(np.intersect1d(s, probe)) >= percent * (size + sizes[i])]
            assert sorted(tree.similar(probe, size, percent)) == want


def test_empty_table_and_other_types(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.jaccard_components(df).collect() == []
    df = spark.createDataFrame([("b", "one two three"), ("a", "One two  three"), ("c", None)], "name string, body string")
    assert told(ngram_join.jaccard_components(df, id_col="name", text_col="body")) == [("a", 1, "a"), ("b", 1, "a"), ("c", 0, "c")]


def test_texts_over_a_slice(spark):
    """Long texts and slices with many rows."""
    pick = random.Random(9)
    long = pick.choices([f"w{k}" for k in range(5000)], k=260_000)
    near = list(long)
    for at in pick.sample(range(len(long)), 3000):
        near[at] = "edited"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:150_000])), (4, "short text"), (5, "Short text")]
    assert len(rows[0][1]) > kernels.SLICE_BYTES
    assert told(ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_over_given_documents(spark, folder):
    rows = [tuple(x) for x in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_ngram_jaccard(spark, folder)
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["bigint"] * 3
    assert told(got) == plain(rows)
