"""Secret scans: SQL over adversarial texts, brute force of the links, and texts with many secrets."""

import hashlib
import random
import re
import time

import pytest
from compare import same_as_sql
from pyspark.sql import functions as F

from spindrift.llm import queries, secrets


def texts(n=120):
    pick = random.Random(5)
    hexes = lambda k: "".join(pick.choices("0123456789abcdef", k=k))
    b64 = lambda k: "".join(pick.choices("ABCDabcd0189+/", k=k))
    parts = [
        lambda: f"password = '{b64(pick.choice([3, 7, 8, 20]))}'", lambda: "API_KEY:" + b64(12), lambda: "apikey \"=x", lambda: "secret=token: abcdefgh1", lambda: "AKIA" + "Q7" * pick.choice([3, 6, 9]), lambda: "xAKIAAKIA" + "Z" * 14,
        lambda: hexes(pick.choice([8, 31, 32, 64])), lambda: "g" + hexes(33) + "g", lambda: "client_id = abc.123", lambda: "my_account-id: zz99@x", lambda: "access_key_id=" + b64(6), lambda: b64(40), lambda: b64(41), lambda: b64(40) + "=",
        lambda: "https://api.example.com:443/v1/x?y=1", lambda: "é😀 http://h.example", lambda: "word " * pick.choice([1, 30, 90]), lambda: "日本語 " * 9, lambda: "\n", lambda: "to-ken = abcdefghij", lambda: "passwd\"  :  \"longvalue12",
    ]
    rows = [" ".join(pick.choice(parts)() for _ in range(pick.choice([1, 4, 12, 30]))) for _ in range(n)]
    return [*rows, None, "", "x", rows[3], rows[3]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("secrets")
    df = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts())], "doc_id long, text string")
    df.withColumns({"lang": F.lit("en"), "source": F.lit("a"), "n_chars": F.lit(0)}).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_same_as_sql(spark, folder):
    same_as_sql(spark, "op3", queries.op3_secrets, queries.ORACLE_SQL["op3_secrets"], folder)


def test_base_spans_by_brute_force(spark, folder):
    found = {r.doc_id: r for r in queries.op3_secrets(spark, folder).where("doc_id is not null").collect()}
    for i, text in enumerate(texts()):
        if i % 9 == 0:
            continue
        spans = []
        for place, (kind, pattern, group, least) in enumerate((("assign", secrets.ASSIGN, 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32))):
            spans += [(m.start(), place, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
        told = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        r = found[i]
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest(), text
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for *_, k in spans) for kind in secrets.BASE)


def test_redaction_by_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"__text": F.lit("own"), "secrets": F.lit("mine"), "__base": F.lit(3), "a.b": F.lit(4)})
    found = {r.doc_id: r.secrets for r in secrets.find_secrets(df.drop("secrets")).collect()}
    got = secrets.redact(df)
    assert got.columns == df.columns
    for r in got.collect():
        text, out, at = rows[r.doc_id][1], "", 0
        for s in found[r.doc_id]:
            if s.start >= at:
                out += text[at : s.start] + secrets.REDACTED
            at = max(at, s.end)
        assert r.text == (None if text is None else out + text[at:]) and (r["__text"], r["secrets"], r["__base"]) == ("own", "mine", 3)


def test_many_secrets_in_long_texts(spark):
    pick = random.Random(2)
    key = lambda: "".join(pick.choices("0123456789abcdef", k=40))
    one = key() + " " + "beef dead face feed " * 100_000
    many = " ".join(key() + " client_id=abcd1 é" for _ in range(25_000))
    df = spark.createDataFrame([(1, one), (2, many)], "doc_id long, text string")
    secrets.find_secrets(df).collect()
    began = time.perf_counter()
    found = {r.doc_id: len(r.secrets) for r in secrets.find_secrets(df).collect()}
    assert found == {1: 1, 2: 50_000} and time.perf_counter() - began < 20
    assert {r.doc_id: r.text.count(secrets.REDACTED) for r in secrets.redact(df).collect()} == found
