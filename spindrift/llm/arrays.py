"""Array expressions whose time is (nearly) linear in the array or text.

They are made of columns: as SQL text, long ones fill the caches of Spark's parser, which the driver keeps as long as it runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of the pieces that long texts are cut into.
PIECE = 1024


def scanned(values: str, pick: Callable[[Column, Column], Column]) -> Column:
    """Running values of `pick`, a sum or maximum of two, over an array: each round doubles the reach."""
    size = F.size(values)
    rounds = F.when(size > 1, F.sequence(F.lit(0), F.ceil(F.log2(size)).cast("int"))).otherwise(F.array().cast("array<int>"))

    def one(acc: Column, k: Column) -> Column:
        reach = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: F.when(i >= reach, pick(x, F.get(acc, i - reach))).otherwise(x))

    return F.aggregate(rounds, F.col(values), one)


def pieces(text: Column) -> Column:
    """A text in pieces of PIECE code points; make it a column before it's cut from."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(pieces: Column, low: Column, high: Column) -> Column:
    """The code points of a text in pieces from low to high. Only the pieces between are read, not all before them."""
    first, last = (F.floor(at / PIECE).cast("int") for at in (low, high))
    one = F.substr(F.get(pieces, first), low % PIECE + 1, high - low)
    head = F.substr(F.get(pieces, first), low % PIECE + 1, F.lit(PIECE))
    tail = F.coalesce(F.substr(F.get(pieces, last), F.lit(1), high % PIECE), F.lit(""))
    between = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(low >= high, "").when(first == last, one).otherwise(F.concat(head, between, tail))


def own_prefix(columns: list[str]) -> str:
    """A prefix that none of the columns has."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix
