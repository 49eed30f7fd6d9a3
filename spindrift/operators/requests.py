"""Search requests: stripping phrases around the search terms, merging slots, dates, rate limits, history."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases around a search, and the marks of an instruction.
PREFIXES = (
    "帮我搜索下", "帮我搜一下", "帮我搜下", "帮我搜索", "帮我搜", "帮我查找", "帮我找一下", "帮我找下", "帮我找", "帮我查一下", "帮我查下", "请帮我搜索", "请帮我搜", "请搜索", "请搜一下", "请搜", "请查找",
    "请找一下", "能否帮我搜索", "能否搜索", "能否搜一下", "麻烦搜索", "麻烦搜一下", "麻烦帮我", "搜索一下", "搜一下", "搜下", "查找一下", "找一下", "找下", "查一下", "查下", "我想搜索", "我想搜", "我要搜索",
    "我要搜", "想要搜索", "需要搜索",
)
SUFFIXES = (
    "的信息", "的资料", "的文件", "的内容", "的东西", "相关文件", "相关资料", "相关内容",
)
PARTICLES = r"[吧呢吗呀嘛啊助诶嘿\s]+[。.!！?？…]*\s*$"
ENGLISH_PREFIX = r"(?i)^\s*(please\s+)?(can\s+you\s+)?(could\s+you\s+)?(help\s+me\s+)?(to\s+)?(search|find|look\s+up|look\s+for)\s+"
ENGLISH_SUFFIX = r"(?i)\s+(please|thanks|thank\s+you)[.!\s]*$"
INSTRUCTION = r"(?i)(帮我|请帮|请搜|能否|麻烦|我想搜|我要搜|搜索一下|搜一下|搜下|查找|找一下|找下|查一下|查下|看看|的信息|的资料|的文件|的内容|关于|help\s+me|please\s+search|search\s+for|look\s+for|find\s+(me\s+)?)"


def strip_filler(text: Column) -> Column:
    """What is searched for, without the phrases around it: the longest phrase at each end goes once, then particles and English phrases."""
    longest = lambda xs: "|".join(sorted(xs, key=len, reverse=True))
    out = F.trim(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, f"^(?:{longest(PREFIXES)})[ ，。、\\t]*", "")
    out = F.regexp_replace(out, f"(?<=.)(?:{longest(SUFFIXES)})$", "")
    out = F.regexp_replace(out, r"[ ，。、\t]+$", "")
    for pattern in (PARTICLES, ENGLISH_PREFIX, ENGLISH_SUFFIX):
        out = F.trim(F.regexp_replace(out, pattern, ""))
    return out


def refine(user_text: Column, model_query: Column) -> Column:
    """The model's query, or the stripped user text where the model has only echoed an instruction."""
    u, q = F.trim(F.coalesce(user_text, F.lit(""))), F.trim(F.coalesce(model_query, F.lit("")))
    bare = strip_filler(u)
    joined = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    echoed = (q == u) | ((F.length(q) >= F.greatest(F.lit(10), F.floor(F.length(u) * 0.72))) & F.contains(joined(q), joined(u)))
    much_longer = (F.length(bare) + 8 < F.length(q)) & F.contains(q, bare)
    usable = (u != "") & (q != "") & u.rlike(INSTRUCTION) & (bare != "") & (bare != u)
    return F.when(usable & (echoed | much_longer), bare).otherwise(q)


def merge_slots(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Each slot from slot_<name>, else ui_<name>, else its default."""
    have = rows.columns
    out = {n: F.coalesce(*(F.col(f"{p}_{n}") for p in ("slot", "ui") if f"{p}_{n}" in have), F.lit(d)) for n, d in defaults.items()}
    return rows.withColumns(out)


def day_bound(day: Column, end: bool) -> Column:
    """Epoch seconds of the first or last second of a day given as yyyy-MM-dd, in the session's time zone; null if it's no such day."""
    first = F.unix_timestamp(F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))).cast("double")
    return first + 86399.0 if end else first


def preset_range(days: Column, now_ts: Column) -> Column:
    """Start of the last so many days."""
    return now_ts - days * 86400.0


def clean_request(rows: DataFrame) -> DataFrame:
    """Requests with unknown sources and date fields replaced, limits within 1 to 200 and times as numbers."""
    return rows.withColumns(
        {
            "source": F.when(F.col("source").isin("all", "file", "mweb"), F.col("source")).otherwise("all"),
            "date_field": F.when(F.col("date_field").isin("mtime", "ctime"), F.col("date_field")).otherwise("mtime"),
            "limit": F.greatest(F.lit(1), F.least(F.lit(200), F.coalesce(F.col("limit").try_cast("int"), F.lit(50)))),
            "date_from": F.col("date_from").try_cast("double"),
            "date_to": F.col("date_to").try_cast("double"),
        }
    )


def admitted(times: list[float], state: list[float], limit: int, period: float) -> tuple[list[bool], list[float]]:
    """Which of some events in order of time are admitted, and the admitted ones that later events must still count.

    An event is admitted if fewer than `limit` admitted ones lie within the `period` before it; a limit of 0 or less admits all.
    """
    out = []
    for t in times:
        state = [x for x in state if t - x < period]
        out.append(limit <= 0 or len(state) < limit)
        if out[-1] and limit > 0:
            state.append(t)
    return out, state


def rate_limit(events: DataFrame, keys: list[str], time: str, limit: int, period: float, order: list[str]) -> DataFrame:
    """Adds `allowed` to events. Admission depends on earlier admissions of the key, so each key's events pass in order of time.

    Rows are dealt by key and sorted; each task reads them once as a stream and holds at most `limit` times of one key, so a key with
    any number of events needs no more memory than another.
    """
    columns = events.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, []
        for frame in frames:
            allowed = []
            for own, t in zip(frame[keys].itertuples(index=False, name=None), frame["__t"].tolist(), strict=True):
                if own != key:
                    key, state = own, []
                ok, state = admitted([t], state, limit, period)
                allowed += ok
            yield frame.drop(columns="__t").assign(allowed=allowed)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    dealt = events.withColumn("__t", seconds).repartition(*keys).sortWithinPartitions(*keys, "__t", *order)
    return dealt.mapInPandas(run, fields + ", allowed boolean").select(*columns, "allowed")


def history(searches: DataFrame, key: str, time: str, keep: int = 50) -> DataFrame:
    """The latest search of each query (key), newest first, the first `keep` of them."""
    rest = [c for c in searches.columns if c != key]
    latest = searches.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, *[c for c in rest if c != time])).alias("x")).select(key, "x.*")
    return latest.withColumn("place", F.row_number().over(Window.orderBy(F.col(time).desc(), key))).where(F.col("place") <= keep)


def reverse_map(pairs: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """For each key the sorted different values."""
    return pairs.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(out))
