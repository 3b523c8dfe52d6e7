"""Stateful processors that Spark's windows cannot say: suppression by time limit, stream-time buffers, punctuation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def suppress_until(df: DataFrame, key: str, ms: str, value: str, limit_ms: int) -> DataFrame:
    """At most one update for each key in ``limit_ms`` of stream time: the newest value, when its first has waited so long.

    ``df`` is a stream of (key string, ms long, value double). A key keeps one value and
    the time it was first held, so state is bounded by the number of keys; its rows of a
    micro-batch are sorted by time in memory, 16 bytes each.
    """

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, since, now = state.get if state.exists else (None, -1, -1)
        out = []
        # A key's rows may come in several batches: all are put in order, not each.
        parts = [(b[ms].to_numpy(np.int64), b[value].to_numpy(np.float64)) for b in batches]
        t, v = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((v, t))
        t, v = t[order], v[order]
        at = 0
        while at < len(t):
            if since < 0:
                since = int(t[at])
            due = at if now - since >= limit_ms else max(at, int(np.searchsorted(t, since + limit_ms)))
            last = min(due, len(t) - 1)
            now, held, at = max(now, int(t[last])), float(v[last]), last + 1
            if due == last:
                out.append((k[0], now, held))
                held, since = None, -1
        state.update((held, since, now))
        yield pd.DataFrame(out, columns=[key, ms, value])

    return df.groupBy(key).applyInPandasWithState(run, f"{key} string, {ms} long, {value} double", "held double, since long, now long", "append", GroupStateTimeout.NoTimeout)


def running(df: DataFrame, key: str, value: str) -> DataFrame:
    """A stateful processor: the running count and sum of each key, emitted once a trigger."""

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, s = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, s = n + len(batch), s + float(batch[value].sum())
        state.update((n, s))
        yield pd.DataFrame([(k[0], n, s)], columns=[key, "n", "total"])

    return df.groupBy(key).applyInPandasWithState(run, f"{key} string, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def grace_join(stream: list[tuple], table: list[tuple], grace: int) -> list[tuple]:
    """The rule of a stream-table join with a grace buffer, on plain rows (key, ms, value): the table's version at the
    stream record's time, for records that are not older than stream time less grace when they come."""
    out, now = [], -1
    for key, t, v in stream:
        now = max(now, t)
        if t < now - grace:
            continue
        seen = [x for k, u, x in table if k == key and u <= t]
        out.append((key, t, v, seen[-1] if seen else None))
    return out


def stream_grace_join(stream: DataFrame, table: DataFrame, key: str, ms: str, value: str, grace: int) -> DataFrame:
    """A stream-table join with a grace buffer: a record waits until stream time of its key has passed its own by ``grace``,
    then meets the table's version at its time; records that come later than that are dropped.

    Both are streams of (key string, ms long, value string). A key's state is its
    buffer and the table's versions that the buffer may still need.
    """
    from pyspark.sql import functions as F

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, buffer, versions = state.get if state.exists else (-1, [], [])
        buffer, versions = [tuple(x) for x in buffer], [tuple(x) for x in versions]
        rows = sorted((int(t), int(side), v) for b in batches for t, side, v in b[[ms, "_side", value]].itertuples(index=False))
        for t, side, v in rows:
            if side == 0:
                versions.append((t, v))
            elif t >= now - grace:
                now = max(now, t)
                buffer.append((t, v))
        versions.sort()
        ready = sorted(x for x in buffer if x[0] <= now - grace)
        buffer = [x for x in buffer if x[0] > now - grace]
        out = [(k[0], t, v, next((w for u, w in reversed(versions) if u <= t), None)) for t, v in ready]
        old = [x for x in versions if x[0] <= now - grace]
        state.update((now, buffer, old[-1:] + [x for x in versions if x[0] > now - grace]))
        yield pd.DataFrame(out, columns=[key, ms, value, "found"])

    both = stream.select(key, ms, value, F.lit(1).alias("_side")).unionByName(table.select(key, ms, value, F.lit(0).alias("_side")))
    pairs = "array<struct<t: long, v: string>>"
    return both.groupBy(key).applyInPandasWithState(run, f"{key} string, {ms} long, {value} string, found string", f"now long, buffer {pairs}, versions {pairs}", "append", GroupStateTimeout.NoTimeout)


def punctuated(df: DataFrame, key: str, ms: str, value: str, every_ms: int) -> DataFrame:
    """Stream-time punctuation: whenever a key's stream time passes a multiple of ``every_ms``, its running sum so far is emitted for it."""

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, due = state.get if state.exists else (0.0, -1)
        out = []
        for t, v in sorted((int(t), float(v)) for b in batches for t, v in b[[ms, value]].itertuples(index=False)):
            if due < 0:
                due = (t // every_ms + 1) * every_ms
            if t >= due:
                at = t // every_ms * every_ms
                out.append((k[0], at, total))
                due = at + every_ms
            total += v
        state.update((total, due))
        yield pd.DataFrame(out, columns=[key, ms, "total"])

    return df.groupBy(key).applyInPandasWithState(run, f"{key} string, {ms} long, total double", "total double, due long", "append", GroupStateTimeout.NoTimeout)
