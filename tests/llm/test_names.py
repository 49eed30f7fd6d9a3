"""Tables that have every internal name of the library already: no operator fails on them, and all their columns stay as they were."""

import pytest
from pyspark.sql import functions as F

from spindrift.llm import decontaminate, mixing, neardup, quality_model, quality_rules, secrets

NAMES = "__id __key __text_key __passes __bad_id __bad_key __keep_id __keep_key __text __trimmed __w __lines __h __sorted __at __copy __part __right_doc_id __before_x __own ___id".split()
WORDS = "the river runs to the sea and all of it was seen by one who had been there".split()


def rows():
    base = " ".join(WORDS * 8)
    texts = [base, f"{base} token = abcdefgh1234", base.upper(), "short", None, "", " ".join(f"w{k}" for k in range(120)), " ".join(f"v{k} of the" for k in range(60))]
    return [(k, t, "en", "s", 0) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def named(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"own {c}") for c in NAMES})


@pytest.fixture(scope="module")
def tables(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(30)))], "item_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(8)], "doc_id long, quality long, toxic long")
    return items, labels


STAGES = {
    "keep_good": lambda df, items, labels: quality_model.keep_good(df, labels),
    "keep_one": lambda df, items, labels: neardup.keep_one(df),
    "drop_contaminated": lambda df, items, labels: decontaminate.drop_contaminated(df, items),
    "redact": lambda df, items, labels: secrets.redact(df),
    "take_mix": lambda df, items, labels: mixing.take_mix(df),
    "judge": lambda df, items, labels: quality_rules.judge(df),
}


@pytest.mark.parametrize("name", STAGES)
def test_own_columns_stay(named, tables, name):
    plain = STAGES[name](named.select("doc_id", "text", "lang", "source", "n_chars"), *tables)
    got = STAGES[name](named, *tables)
    assert got.columns[: len(named.columns)] == named.columns or set(named.columns) <= set(got.columns)
    found = got.collect()
    assert all(r[c] == f"own {c}" for r in found for c in NAMES)
    told = lambda rs: sorted((str(r["doc_id"]), str(r["text"])) for r in rs)
    assert found and told(found) == told(plain.collect())


@pytest.mark.parametrize("name", STAGES)
def test_empty_tables(named, tables, name):
    items, labels = tables
    assert STAGES[name](named.limit(0), items.limit(0), labels.limit(0)).collect() == []
