"""Planning searches: query type, exactness, budgets, and the clauses of the keyword branch. One row for each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import QUERY_TYPES, SETTINGS, Settings
from ..functions.text import CJK, bigrams, words


def query_type(query: Column) -> Column:
    """exact (quotes), filename (ends like one), code, semantic (long, five words or more) or hybrid; the first that fits."""
    many = (F.length(query) > 15) & (F.size(F.filter(F.split(query, r"(?U)\s+"), lambda w: w != "")) > 4)
    return (
        F.when(F.contains(query, F.lit('"')) | F.contains(query, F.lit("'")), "exact")
        .when(query.rlike(r"\.[a-zA-Z0-9]{1,4}$"), "filename")
        .when(query.rlike(r"(def |class |import |Exception|Error|\.py)"), "code")
        .when(many, "semantic")
        .otherwise("hybrid")
    )


def _of_type(kind: Column, place: int) -> Column:
    out = None
    for name, values in QUERY_TYPES.items():
        out = F.when(kind == name, values[place]) if out is None else out.when(kind == name, values[place])
    return out


def clauses(query: Column) -> Column:
    """All clauses must match, each by any of its alternatives: array of arrays of (tokens, is_prefix).

    A word of letters and digits is a prefix; a run of three or more ideographs may match by itself or by any of its bigrams; a
    word with other characters is a phrase of its parts. Words without any letter or digit don't count.
    """
    apart = F.regexp_replace(F.replace(query, F.lit('"'), F.lit(" ")), f"([{CJK}]+)", " $1 ")
    parts = F.filter(F.split(apart, r"(?U)\s+"), lambda w: F.size(words(w)) > 0)

    def alternatives(word: Column) -> Column:
        one = lambda t, prefix: F.struct(t.alias("tokens"), F.lit(prefix).alias("is_prefix"))
        plain = word.rlike(f"^[a-zA-Z0-9{CJK}]+$")
        grown = F.array_distinct(F.concat(F.array(word), bigrams(word)))
        return (
            F.when(word.rlike(f"^[{CJK}]{{3,}}$"), F.transform(grown, lambda t: one(words(t), True)))
            .when(plain, F.array(one(words(word), True)))
            .otherwise(F.array(one(words(word), False)))
        )

    return F.transform(parts, alternatives)


def plan(queries: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Adds the plan of each query (query_id, query, and perhaps exact_focus, filename_only, limit); blank queries have none."""
    have = set(queries.columns)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in have else F.lit(False)
    limit = F.greatest(F.lit(1), F.least(F.lit(settings.most_results), F.coalesce(F.col("limit"), F.lit(settings.default_limit)))) if "limit" in have else F.lit(settings.default_limit)
    out = queries.withColumn("query", F.trim("query")).where("length(query) > 0").withColumn("query_type", query_type(F.col("query")))
    high = flag("exact_focus") | flag("filename_only")
    kind = F.col("query_type")
    out = out.withColumns({"exactness": F.when(high, "high").otherwise("medium"), "limit": limit, "filename_only": flag("filename_only")})
    return out.withColumns(
        {
            "sparse_k": _of_type(kind, 0),
            "dense_k": _of_type(kind, 1),
            "sparse_weight": _of_type(kind, 2),
            "dense_weight": _of_type(kind, 3),
            "rerank_k": F.greatest(F.lit(settings.rerank_top_n), "limit"),
            "fusion_k": F.greatest(F.lit(settings.fusion_top_k), 2 * F.greatest(F.lit(settings.rerank_top_n), F.col("limit"))),
            "clauses": clauses(F.col("query")),
        }
    )
