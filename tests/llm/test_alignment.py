"""Token alignment against a plain reading of its definition, with the libraries' own encodings of whole texts."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import alignment, queries

HARD = [
    None, "", " ", "  ", "\n", " a  b ", "a\tb\n\n c", "x▁y", "▁", "<|endoftext|> and </s><s><unk>", "<0x0A>", "ÀÉÎ ñ ß", "日本語の文 です", "👩‍👩‍👧 ok", "a　b c d", "x\x1cy \x85z\x00",
    "don't we'll I'M", "1234567 89.5e-3", "  \n \n\tindented\r\nline\r\n", "a" * 3000, "ab " * 40, "é" * 300, "​﻿ zero", "foo.\nBar\n\nBaz ", "\n\nstart", "#" * 200 + "!" * 50,
]


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(open(alignment.BYTE_BPE, "rb").read(), open(alignment.PIECE_BPE, "rb").read())


def plain(texts):
    """Rows of the contract, from whole encodings and sets of ends."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
    back = alignment._byte_level()
    names = {i: t for t, i in json.load(open(alignment.BYTE_BPE))["model"]["vocab"].items()}
    out, links = [], Counter()
    for text in texts:
        if not text:
            out.append(None)
            continue
        raw = f" {text}".encode()
        ids = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        told = [bytes(map(back.__getitem__, names[i])) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if any(b"".join(x) != raw for x in told):
            out.append(None)
            continue
        ends = [np.cumsum([len(x) for x in t]).tolist() for t in told]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, low = [], [0, 0]
        for cut in shared:
            high = [e.index(cut, k) + 1 for e, k in zip(ends, low, strict=True)]
            groups.append("|".join(",".join(map(str, x[k:m])) for x, k, m in zip(ids, low, high, strict=True)))
            low = high
        own, starts = [], [[0, *e[:-1]] for e in ends]
        j = 0
        for i, x in enumerate(ids[0]):
            while ends[1][j] <= starts[0][i]:
                j += 1
            k = j
            while k < len(ids[1]) and starts[1][k] < ends[0][i]:
                own.append((x, ids[1][k]))
                k += 1
        links.update(own)
        out.append((len(ids[0]), len(ids[1]), len(groups), own, ";".join(groups)))
    most = defaultdict(int)
    for (_, y), n in links.items():
        most[y] = max(most[y], n)
    done = []
    for x in out:
        if x is None:
            done.append((0, 0, 0, 0, 0, 0, ""))
        else:
            done.append((*x[:3], len(x[3]), sum(links[p] == most[p[1]] for p in x[3]), sum(links[p] for p in x[3]), hashlib.sha256(x[4].encode()).hexdigest()))
    return done


def digests(df):
    return [(x["n_a"], x["n_b"], x["n_groups"], x["n_links"], x["n_best"], x["count_sum"], hashlib.sha256(x["groups"].encode()).hexdigest() if x["n_a"] else x["groups"]) for x in df.collect()]


def test_cuts_are_those_of_the_definition():
    pick = random.Random(1)
    for _ in range(200):
        n = pick.choice([1, 2, 5, 40, 300])
        a, b = (np.array(sorted(pick.sample(range(4 * n), pick.randint(1, n)))) for _ in "ab")
        at = np.array([0]), np.array([len(a)]), np.array([0]), np.array([len(b)])
        i, j = alignment.shared_cuts(a, b, *at)
        both = sorted(set(a.tolist()) & set(b.tolist()))
        assert a[i].tolist() == both == b[j].tolist()


def test_pieces_are_encoded_as_whole_texts(pair):
    texts = [x for x in HARD if x]
    pick = random.Random(2)
    marks = [" ", "  ", "\n", "\t", "a", "é", "'s", "1", ".", "語", "　", "\x1c", "\x85", "▁", "Foo", " ", "\r\n"]
    texts += ["".join(pick.choices(marks, k=pick.randint(1, 60))) for _ in range(3000)]
    for text in texts:
        pieces = pair.pieces(text)
        assert "".join(pieces) == f" {text}"
        assert pair.encode_a(pieces)[0].tolist() == pair.a.encode_ordinary(f" {text}"), text
        if "▁" not in text:  # a text with B's own sign for spaces has no tokens
            assert pair.encode_b(pieces)[0].tolist() == pair.b.encode(text), text
        assert pair.long_a.encode(f" {text}", add_special_tokens=False).ids == pair.a.encode_ordinary(f" {text}"), text


@pytest.mark.parametrize("block_chars", [1, 500, alignment.BLOCK_CHARS])
def test_hard_texts(spark, block_chars):
    """In blocks of any size; nulls, repeated rows, null ids, clashing columns."""
    texts = [*HARD, HARD[5], HARD[5], "word " * 300]
    rows = [(k if k % 7 else None, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({"block": F.lit(1), "pair": F.lit("x"), "groups": F.lit(2), "__right_pair": F.lit(3)})
    got = alignment.align(df, block_chars=block_chars)
    assert sorted(digests(got)) == sorted(plain(texts))
    assert sorted(map(str, (x["doc_id"] for x in got.collect()))) == sorted(str(k) for k, _ in rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(df).collect() == []


def test_other_names_and_types(spark):
    df = spark.createDataFrame([("x", "one two"), ("y", None)], "name string, body string")
    assert {x["doc_id"]: x["n_a"] for x in alignment.align(df, id_col="name", text_col="body").collect()} == {"x": 2, "y": 0}


def test_a_long_text(spark):
    pick = random.Random(5)
    text = " ".join("".join(pick.choices("abcdeé", k=pick.randint(1, 9))) for _ in range(250_000))
    assert len(text.encode()) > 1 << 20
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    assert sorted(digests(alignment.align(df, block_chars=1000))) == sorted(plain([text, "short"]))


def test_query_over_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        pytest.skip("no given tables")
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    got = queries.op11_token_alignment(spark, folder)
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["bigint"] * 7 + ["string"]
    found = {x["doc_id"]: tuple(x)[1:] for x in got.collect()}
    assert found == dict(zip(texts, plain(texts.values()), strict=True))
