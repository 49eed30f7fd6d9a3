"""Joins on keys that one group may fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import own_prefix


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """An equi-join whose both sides are dealt anew, so that adaptive execution can split a hot key of the left side.

    Spark splits a skewed partition only if it comes straight from a shuffle of the join. A side that is already grouped by
    the keys would keep its partitioning and stand in the way; the added condition, derived from the keys, makes Spark deal it
    again. It's part of the condition only, so no bytes are added to the shuffled rows.
    """
    p = own_prefix([*left.columns, *right.columns])
    named = {k: f"{p}right_{k}" for k in keys}
    other = right.withColumnsRenamed(named)
    on = [F.col(k) == F.col(named[k]) for k in keys]
    on.append(F.xxhash64(*keys) == F.xxhash64(*named.values()))
    joined = left.join(other, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*named.values())
