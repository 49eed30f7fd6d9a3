"""Streams with state in event time: the rate limiter, and the expiry of cached rows.

A decision is made when the watermark has passed an event's time, so it doesn't depend on how the events were dealt into batches, nor,
within the lateness, on the order in which they came. State is dropped by event time too: a pause between batches forgets nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.requests import admitted


def limited(events: DataFrame, keys: list[str], time: str, limit: int, period: float, order: list[str], lateness: str = "10 seconds") -> DataFrame:
    """Adds `allowed` to a stream of events, as requests.rate_limit does to a table.

    An event waits in its key's state until the watermark, the latest time seen less `lateness`, has reached it; the key's events then pass in
    order of time (and of the `order` columns). A key's state holds these and at most `limit` admitted times. It goes when the watermark is a
    period past its last admitted event. Events later than the lateness are left out, as are those without a time.
    """
    columns = events.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting = state.get if state.exists else ([], [])
        held, waiting = list(held), [pickle.loads(x) for x in waiting]
        if not state.hasTimedOut:
            for frame in frames:
                places = [frame.columns.get_loc(c) for c in columns]
                own = [frame.columns.get_loc(c) for c in order]
                waiting += [(row[t], tuple(row[k] for k in own), tuple(row[k] for k in places)) for t in [frame.columns.get_loc("__t")] for row in frame.itertuples(index=False, name=None)]
        passed = state.getCurrentWatermarkMs()
        ready = sorted((x for x in waiting if x[0] * 1000 <= passed), key=lambda x: x[:2])
        waiting = [x for x in waiting if x[0] * 1000 > passed]
        allowed, held = admitted([x[0] for x in ready], held, limit, period)
        if waiting or held:
            state.update((held, [pickle.dumps(x) for x in waiting]))
            due = min(x[0] for x in waiting) if waiting else held[-1] + period
            state.setTimeoutTimestamp(max(int(due * 1000) + 1, passed + 1))
        elif state.exists:
            state.remove()
        if ready:
            yield pd.DataFrame([x[2] for x in ready], columns=columns).assign(allowed=allowed)

    at = F.col(time).cast("timestamp")
    timed = events.withColumns({"__at": at, "__t": F.unix_micros(at) / 1e6}).where("__at IS NOT NULL").withWatermark("__at", lateness)
    return timed.groupBy(*keys).applyInPandasWithState(run, fields + ", allowed boolean", "times array<double>, waiting array<binary>", "append", GroupStateTimeout.EventTimeTimeout)


def expired(rows: DataFrame, key: str, time: str, days: float = 30.0, lateness: str = "10 seconds") -> DataFrame:
    """(key, time) of cached rows that expire, from a stream of rows put into a cache; `time` is in seconds since 1970.

    Of rows with the same key the latest counts. A row expires when the watermark is more than `days` past its time: what incremental.expire
    would then leave out. A key that is put again later begins anew. Rows without a time never expire.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest = state.get[0] if state.exists else float("-inf")
        if not state.hasTimedOut:
            latest = max([latest, *(float(f["__t"].max()) for f in frames)])
        due, passed = int((latest + days * 86400.0) * 1000), state.getCurrentWatermarkMs()
        if due < passed:
            if state.exists:
                state.remove()
            yield pd.DataFrame({key: [own[0]], time: [latest]})
        else:
            state.update((latest,))
            state.setTimeoutTimestamp(max(due + 1, passed + 1))

    timed = rows.where(F.col(time).isNotNull()).select(key, F.col(time).cast("double").alias("__t"), F.timestamp_micros((F.col(time) * 1e6).cast("long")).alias("__at"))
    return timed.withWatermark("__at", lateness).groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, `{time}` double", "latest double", "append", GroupStateTimeout.EventTimeTimeout)
