"""Collocations against plain counting, and the automata against dictionaries."""

import random
import re
from collections import Counter, defaultdict

import pytest
from compare import same_as_sql
from pyspark.sql import functions as F

from spindrift.llm import automata, collocations, queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=100, most_words=5, best=2000, covered=100):
    """(lang, rank, phrase, a, l, r, n, score) from Python's own integers."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most_words + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                gone |= {p[i : i + k] for i in range(len(p) - k + 1) if 100 * a >= covered * counts[p[i : i + k]]}
        scored = []
        for p, a in candidates.items():
            if p not in gone:
                score, _, x, y = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), x, y))
        for rank, (score, a, p, x, y) in enumerate(sorted(scored)[:best], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n[lang], -score))
    return sorted(out)


def told(df):
    return sorted(tuple(x[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for x in df.collect())


def corpus(seed, n=400):
    pick = random.Random(seed)
    words = ["the", "of", "The", "é", "É", "x\x01y", "日本", "a-b", "new", "york", "city", "\x1c", "ſt"]
    fixed = ["in the city of new york", "as well as", "no one. else", "x x x x x x", "new york", "a,b"]
    rows = []
    for k in range(n):
        parts = pick.choices(words, k=pick.choice([0, 1, 5, 30])) + pick.choices(fixed, k=pick.choice([0, 1, 3]))
        pick.shuffle(parts)
        rows.append((pick.choice([" ", "  ", "\t", " "]).join(parts) + pick.choice(["", ".", "\n", " !", "\r\n"]) + pick.choice(["", "of the"]), pick.choice(["en", "en", "de", "", None, "und"])))
    return [*rows, (None, "en"), ("", None), (" .,\t\n", "fr"), rows[0], rows[0]]


@pytest.mark.parametrize(("seed", "least"), [(1, 20), (2, 5)])
def test_small_texts(spark, seed, least, monkeypatch):
    monkeypatch.setattr(collocations, "BITS", 20)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(6)
    clashing = {c: F.lit("x") for c in ("n", "word", "h", "phrase", "range", "automaton", "rest", "score", "rank", "__right_lang")}
    assert told(collocations.collocations(df.withColumns(clashing), least=least)) == plain(rows, least)


def test_small_memory_and_other_parameters(spark, monkeypatch):
    """Tasks that pass on what they hold again and again, many automata of a range, full bit tables."""
    for name, value in (("HELD", 10), ("HASHES", 10), ("FAN", 2), ("BITS", 15), ("PER_BOUND", 1)):
        monkeypatch.setattr(collocations, name, value)
    rows = corpus(3)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert told(collocations.collocations(df, least=8, most_words=4, best=7, covered=80)) == plain(rows, 8, 4, 7, 80)


def test_large_numbers(spark):
    """Products over 64 bits: the score as Spark computes it against Python's integers."""
    rows = [(10**12 + 7, 10**14 + 3, 3 * 10**12 + 1, 2 * 10**12 + 9), (100, 10**14, 100, 100), (7 * 10**11, 9 * 10**13, 7 * 10**11, 8 * 10**11 + 1)]
    score = F.expr("(CAST(1000 AS decimal(4, 0)) * CAST(a AS decimal(15, 0)) * CAST(n AS decimal(18, 0))) div (CAST(l AS decimal(19, 0)) * CAST(r AS decimal(19, 0)))")
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").select(score.alias("s"))
    assert [x["s"] for x in got.collect()] == [1000 * a * n // (x * y) for a, n, x, y in rows]


def test_automata():
    pick = random.Random(4)
    for _ in range(50):
        rows = {tuple(pick.choices("abcde", k=pick.randint(1, 4))): pick.randint(1, 9) for _ in range(pick.randint(1, 120))}
        made = automata.Counts.loads(automata.Counts.build(sorted(rows.items())).dumps())
        assert {p: t[-1] for p, t in made.items()} == rows and [p for p, _ in made.items()] == sorted(rows)
        assert all(t == tuple(rows.get(p[:k], 0) for k in range(1, len(p) + 1)) for p, t in made.items())
        assert all(made.get(p) == n for p, n in rows.items())
        assert made.get(("z",)) == made.get(("a", "z")) == made.get(("a",) * 9) == 0
        other = {tuple(pick.choices("abcde", k=pick.randint(1, 4))): pick.randint(1, 9) for _ in range(60)}
        both = Counter(rows) + Counter(other)
        assert {p: t[-1] for p, t in automata.union([made, automata.Counts.build(sorted(other.items()))], 5).items()} == {p: n for p, n in both.items() if n >= 5}
    # Shared endings are held once.
    endings = [(x, y, z) for x in "abcdefgh" for y in "uvw" for z in "xyz"]
    assert len(automata.Counts.build([(p, 1) for p in endings]).arcs_at) < 8


def test_empty_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    df = spark.createDataFrame([(None, None), ("one two", "en")], "text string, lang string")
    assert collocations.collocations(df).collect() == []


def test_texts_over_a_slice(spark):
    pick = random.Random(6)
    text = " ".join(pick.choice(["alpha beta", "gamma", "delta epsilon zeta", "x", "y,"]) for _ in range(150_000))
    assert len(text) > 1 << 20
    rows = [(text, "en"), ("alpha beta", "en")]
    assert told(collocations.collocations(spark.createDataFrame(rows, "text string, lang string"))) == plain(rows)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_over_given_documents(spark, folder):
    rows = [tuple(x) for x in spark.read.parquet(f"{folder}/documents.parquet").select("text", "lang").collect()]
    got = queries.op13_collocations(spark, folder)
    assert dict(got.dtypes) == {"lang": "string", "phrase": "string"} | dict.fromkeys(("rank", "a", "l", "r", "n", "score"), "bigint")
    want = plain(rows)
    assert told(got) == want and want
    same_as_sql(spark, "op13_collocations", queries.op13_collocations, queries.ORACLE_SQL["op13_collocations"], folder)
