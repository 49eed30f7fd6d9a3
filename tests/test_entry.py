"""The driver contract, with and without the training-data subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ALONE = """
import sys
for name in ("corpus_pipeline", "spindrift.llm"):
    sys.modules[name] = None
import __spark_entry__ as e
assert len(e.queries()) > 40 and set(e.oracle_sql()) <= set(e.queries())
assert not [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
"""


def test_the_rest_works_without_the_subpackage():
    subprocess.run([sys.executable, "-c", ALONE], cwd=ROOT, check=True)


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark):
    import pytest

    import __spark_entry__ as e

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the given tables")
    found = e.entry(spark)
    assert found.columns == ["query_id", "chunk_id", "score", "rank"] and found.count() > 0


ELSEWHERE = """
import os, sys
os.environ.pop("PYTHONPATH", None)
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as e
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()

def where(spark, folder):
    from spindrift.functions import text

    @F.pandas_udf("string")
    def loaded(x):
        import spindrift
        return x.map(lambda _: spindrift.__file__)

    return spark.range(2).select(text.nfc(F.lit("e\u0301")).alias("a"), loaded(F.col("id").cast("string")).alias("b"))

rows = [tuple(r) for _ in range(2) for r in e.importable(where)(spark, "").collect()]
assert len(rows) == 4 and all(a == "\xe9" and "spindrift_package.zip" in b for a, b in rows), rows
"""


def test_workers_get_the_package_from_spark(tmp_path):
    subprocess.run([sys.executable, "-c", ELSEWHERE, ROOT], cwd=tmp_path, check=True)
