"""Histogram sort into shards of near equal bytes.

Rows are ordered by (XXH64 of the text, doc_id), so equal texts stand together,
and that order is cut into shards. The cuts are found by refining a histogram:
every undecided cut keeps a bracket of keys; each round puts ``PROBES`` keys
evenly inside each bracket, all partitions count the exact bytes and rows below
every probe, and the brackets shrink to the two probes around the target. A cut
is decided when its count is within its tolerance, or when its bracket holds one
row or one key. A bracket of one hash (a group of copies larger than the tolerance) is
refined by doc_id inside it, so a hot group is cut as well.

Rows of equal text and doc_id are one key. If such a key outweighs the tolerance
of a cut that falls into it (a hot group without doc_ids, say), the rows are
written once to the shared folder with a number each, and the key's second part
becomes a hash of doc_id and number, which any cut can part.

Besides the cuts between shards, looser cuts split every shard into parts of
``PART_BYTES`` at most, so that no task sorts a whole shard. Then the rows are
exchanged once, each to its part, and sorted there; the first slot of a part is
known from the counts, so slots need no further pass.

The histogram runs over a narrow table (hash, doc_id, size) written to the
shared folder. What comes to the driver is one row for each probe.

Defined results: a null text has size 1 and the checksum of the empty text; a
null doc_id stands first in its group; rows of equal text and doc_id have slots
in no particular order, and where they had to be numbered so has their text's
whole group; an empty table gives no rows; a document larger than the tolerance
shifts the cut to one of its sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored

SHARDS = 16
PROBES = 32
#: Part of a shard's size by which a cut between shards may be off.
TOLERANCE = 0.0005
#: Part of a part's size by which a cut inside a shard may be off.
LOOSE = 0.1
PART_BYTES = 256 << 20
NO_ID = -(1 << 63)
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1

Key = tuple[int, int]


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text and one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def key_of(text: Column, doc_id: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.coalesce(text, F.lit(""))), F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def below(probes: list[Key], h: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How many probes are at or below each key; probes ascend."""
    ph = np.array([p[0] for p in probes], np.int64)
    pd = np.array([p[1] for p in probes], np.int64)
    out, last = np.searchsorted(ph, h, "left"), np.searchsorted(ph, h, "right")
    tied = np.flatnonzero(last > out)
    for value in np.unique(h[tied]):
        a, b = np.searchsorted(ph, value, "left"), np.searchsorted(ph, value, "right")
        rows = tied[h[tied] == value]
        out[rows] = a + np.searchsorted(pd[a:b], d[rows], "right")
    return out


def _histogram(probes: list[Key]):
    """Function for mapInArrow over (h, d, size): bytes and rows of a partition between neighbouring probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(probes) + 1
        total, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            h, d, size = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            at = below(probes, h, d)
            rows += np.bincount(at, minlength=n)
            np.add.at(total, at, size)
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used]), pa.array(rows[used])], ["at", "bytes", "rows"])

    return run


def counts(keys: DataFrame, probes: list[Key]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) of all partitions below each probe."""
    got = keys.mapInArrow(_histogram(probes), "at long, bytes long, rows long").groupBy("at").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()
    total, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in got:
        total[r.at], rows[r.at] = r.bytes, r.rows
    return list(zip(np.cumsum(total)[:-1].tolist(), np.cumsum(rows)[:-1].tolist()))


def _between(low: Key, high: Key, n: int) -> list[Key]:
    """Up to n keys inside (low, high)."""
    if high[0] - low[0] > 1:
        inner = [(low[0] + (high[0] - low[0]) * k // (n + 1), _LOW) for k in range(1, n + 1)]
    elif high[0] > low[0]:  # one hash and the first key of the next
        inner = [(low[0], low[1] + (_HIGH - low[1]) * k // (n + 1)) for k in range(1, n + 1)] + [(high[0], _LOW)]
    else:
        inner = [(low[0], low[1] + (high[1] - low[1]) * k // (n + 1)) for k in range(1, n + 1)]
    return [k for k in dict.fromkeys(inner) if low < k < high]


def splitters(keys: DataFrame, targets: list[tuple[int, float]], total: tuple[int, int]) -> tuple[list[tuple[Key, int, int]], bool]:
    """(key, bytes below, rows below) for each target (bytes below, tolerance), and whether one lies in a key of many rows."""
    low: list[tuple[Key, int, int]] = [((_LOW, _LOW), 0, 0) for _ in targets]
    high: list[tuple[Key, int, int]] = [((_HIGH, _HIGH), *total) for _ in targets]
    found: list[tuple[Key, int, int] | None] = [None] * len(targets)
    tied = False
    while any(f is None for f in found):
        asked: dict[int, list[Key]] = {}
        for k, f in enumerate(found):
            if f is None:
                inner = _between(low[k][0], high[k][0], PROBES)
                if inner:
                    asked[k] = inner
                else:
                    found[k] = min(low[k], high[k], key=lambda x: abs(x[1] - targets[k][0]))
                    tied |= abs(found[k][1] - targets[k][0]) > targets[k][1] and high[k][2] - low[k][2] > 1
        if not asked:
            break
        probes = sorted({p for x in asked.values() for p in x})
        known = dict(zip(probes, counts(keys, probes)))
        for k, inner in asked.items():
            want, slack = targets[k]
            for p in inner:
                x = (p, *known[p])
                if x[1] <= want and p > low[k][0]:
                    low[k] = x
                if x[1] >= want and p < high[k][0]:
                    high[k] = x
            best = min(low[k], high[k], key=lambda x: abs(x[1] - want))
            if abs(best[1] - want) <= slack or low[k][1] == high[k][1] or high[k][2] - low[k][2] <= 1:
                found[k] = best
    return found, tied


def shard(docs: DataFrame, shards: int = SHARDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """All columns of ``docs`` and size, shard, slot (gapless from 0 in each shard); columns of those names are replaced.

    The rows come out ordered in parts, so writing them partitioned by shard
    gives one sorted file for each part.
    """
    docs = docs.drop("size", "shard", "slot")
    names = docs.columns
    salt, at_h, at_d, at_p = (_free(names, x) for x in ("_salt", "_h", "_d", "_p"))
    h, d = key_of(F.col("text"), F.col("doc_id"))
    keys = stored(docs.select(h.alias("h"), d.alias("d"), size_of(F.col("text")).alias("size")), "keys")
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    per = max(1, -(-total.bytes // (shards * part_bytes)))
    n = shards * per
    slack = lambda k: TOLERANCE * total.bytes / shards if k % per == 0 else LOOSE * total.bytes / n
    targets = [(total.bytes * k // n, slack(k)) for k in range(1, n)]
    cuts, tied = splitters(keys, targets, (total.bytes, total.rows))
    if tied:
        docs = stored(docs.withColumn(salt, F.monotonically_increasing_id()), "numbered")
        d = F.xxhash64(d, F.col(salt))
        keys = stored(docs.select(h.alias("h"), d.alias("d"), size_of(F.col("text")).alias("size")), "keys")
        cuts, _ = splitters(keys, targets, (total.bytes, total.rows))
    order = sorted(cuts, key=lambda x: x[0])
    probes = [c[0] for c in order]
    first = np.array([0, *(c[2] for c in order)], np.int64)
    start = np.array([first[p - p % per] for p in range(n)])

    @F.pandas_udf("part int, base long")
    def dealt(h, d):
        import pandas as pd

        part = below(probes, h.to_numpy(), d.to_numpy()) if probes else np.zeros(len(h), np.int64)
        return pd.DataFrame({"part": part.astype(np.int32), "base": first[part] - start[part]})

    out = docs.select("*", h.alias(at_h), d.alias(at_d), size_of(F.col("text")).alias("size")).withColumn(at_p, dealt(at_h, at_d))
    out = out.repartitionById(n, F.col(f"{at_p}.part")).sortWithinPartitions(at_h, at_d)
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return out.select(*names, "size", F.floor(F.col(f"{at_p}.part") / per).cast("int").alias("shard"), (F.col(f"{at_p}.base") + own).alias("slot"))


def _free(names: list[str], name: str) -> str:
    """The name, with as many underscores more as make it new."""
    while name.lower() in (n.lower() for n in names):
        name += "_"
    return name
