"""Query front end: a range query in parts that are split at absolute times, sharded by series, merged and kept.

*Split.* The evaluation times of a query that lie in one window of ``split``
milliseconds since the epoch make a part, so the inner parts of two
overlapping queries of one step phase are the same and can be kept.

*Shards.* The series of an aggregate are dealt by a hash of their labels. Each
shard gives partial results that merge: sums and counts for an average, moments
for deviations, a shard's own best for topk and bottomk. All shards are one
grouping, so the data are read once.

*Kept results.* The merged rows of a part stand in the shared folder for
``ttl`` seconds; the driver knows their folder by the part's key.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.plans import promql_parser as P
from millrace.plans.metric_queries import _SUM, END, START, STEP, samples
from millrace.plans.promql import MAX_POINTS, Engine, _nan, _numbers
from millrace.registry import query
from millrace.storage import scratch

DAY = 86_400_000
_MERGED = ("sum", "avg", "count", "min", "max", "group", "stddev", "stdvar", "topk", "bottomk")


def parts(start: int, end: int, step: int, split: int) -> list[tuple[int, int]]:
    """(first, last) evaluation time of each part; every time of the grid is in one of them."""
    if step <= 0 or split <= 0:
        raise ValueError("step and split interval must be positive")
    if start > end:
        return []
    if (end - start) // step > MAX_POINTS:
        raise ValueError(f"exceeded maximum resolution of {MAX_POINTS} points per series")
    out, first = [], start
    while first <= end:
        border = (first // split + 1) * split
        last = min(end, first + (border - 1 - first) // step * step)
        last = first + (last - first) // step * step
        out.append((first, last))
        first = last + step
    return out


def _single(x) -> bool:
    """Every series of the expression comes from one series of the data."""
    if isinstance(x, P.Subquery):
        return _single(x.expr)
    if isinstance(x, P.Call):
        return not x.name.startswith(("absent", "histogram", "scalar", "vector", "info", "time", "label")) and all(map(_single, x.args))
    return isinstance(x, (P.Selector, P.Number, P.Text))


def shardable(x) -> bool:
    """An aggregate whose results merge, over an expression of single series."""
    return isinstance(x, P.Aggregate) and x.op in _MERGED and _single(x.expr)


def _best(rows: DataFrame, x: P.Aggregate, *group: str) -> DataFrame:
    order = F.col("value").desc() if x.op == "topk" else F.col("value")
    nth = F.row_number().over(W.partitionBy(*group, "gk", "step").orderBy(F.isnan("value"), order, "series"))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= int(x.param.value)).drop("_nth")


def partials(engine: Engine, x: P.Aggregate, shards: int) -> DataFrame:
    """What each shard gives for an aggregate, in one pass: its best rows, or sums, counts, extremes and moments."""
    v = engine.grouped(x).withColumn("shard", F.pmod(F.xxhash64("series"), F.lit(shards)))
    if x.op in ("topk", "bottomk"):
        return _best(v, x, "shard")
    sums = {"s": F.sum("value"), "n": F.count("*").cast("double"), "low": F.min(_numbers()), "high": F.max(_numbers()), "m2": F.var_pop("value") * F.count("value")}
    return v.groupBy("shard", "gk", "step").agg(F.first("g").alias("labels"), *[c.alias(n) for n, c in sums.items()])


def merged(rows: DataFrame, x: P.Aggregate) -> DataFrame:
    """labels, step, value of the aggregate from the rows of all shards."""
    if x.op in ("topk", "bottomk"):
        return _best(rows, x).select("labels", "step", "value")
    if x.op in ("stddev", "stdvar"):
        value = lambda e: (e["m2"], e["n"], e["mean"])

        def both(a, e):
            (m2, n, mean), (q2, k, other) = value(a), value(e)
            off = other - mean
            return F.struct((m2 + q2 + off * off * n * k / (n + k)).alias("m2"), (n + k).alias("n"), (mean + off * k / (n + k)).alias("mean"))

        rows = rows.groupBy("gk", "step").agg(F.first("labels").alias("labels"), F.collect_list(F.struct("m2", "n", (F.col("s") / F.col("n")).alias("mean"))).alias("d"))
        whole = F.aggregate(F.slice("d", 2, F.greatest(F.size("d"), F.lit(1))), F.element_at("d", 1), both)
        var = whole["m2"] / whole["n"]
        return rows.select("labels", "step", (F.sqrt(var) if x.op == "stddev" else var).alias("value"))
    value = {"sum": F.sum("s"), "avg": F.sum("s") / F.sum("n"), "count": F.sum("n"), "min": _nan(F.min("low")), "max": _nan(F.max("high")), "group": F.lit(1.0)}[x.op]
    return rows.groupBy("gk", "step").agg(F.first("labels").alias("labels"), value.cast("double").alias("value")).select("labels", "step", "value")


@dataclass
class Results:
    """Results of parts that are kept for a while; ``clock`` gives seconds."""

    ttl: float = 600.0
    clock: Callable[[], float] = time.time
    known: dict[str, tuple[str, float]] = field(default_factory=dict)
    hits: int = 0

    def get(self, key: str) -> str | None:
        path, until = self.known.get(key, (None, 0.0))
        if path is None or until <= self.clock():
            self.known.pop(key, None)
            return None
        self.hits += 1
        return path

    def put(self, key: str, path: str) -> None:
        self.known[key] = (path, self.clock() + self.ttl)


def range_query(data: DataFrame, text: str, start: int, end: int, step: int, split: int = DAY, shards: int = 4, kept: Results | None = None, name: str = "") -> DataFrame:
    """labels, step, value of a range query by parts; ``name`` tells the samples of one tenant from another's where results are kept."""
    spark, x, out = data.sparkSession, P.parse(text), None
    whole = re.search(r"\b(start|end|range)\s*\(\s*\)", text)  # these mean the whole query's range
    for first, last in [(start, end)] if whole else parts(start, end, step, split):
        key = hashlib.sha256(repr((name, text, first, last, step)).encode()).hexdigest()
        path = kept.get(key) if kept else None
        if path is None:
            engine = Engine(data, first, last, step)
            rows = merged(partials(engine, x, shards), x) if shards > 1 and shardable(x) else engine.query(text)
            if kept:
                path = scratch(spark, "results")
                rows.write.parquet(path)
                kept.put(key, path)
        if path is not None:
            rows = spark.read.parquet(path)
        out = rows if out is None else out.unionByName(rows)
    return out


def _registered(name: str, text: str, columns: tuple[str, ...], oracle: str, keep: bool = False) -> None:
    @query("frontend_" + name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data, kept = samples(spark, sf_dir), Results() if keep else None
        if keep:  # a query of one phase that begins later: all parts but the first are the same
            range_query(data, text, START + 2 * STEP, END, STEP, 10 * DAY, 2, kept)
        out = range_query(data, text, START, END, STEP, 10 * DAY, 2, kept)
        if keep and kept.hits < 2:
            raise AssertionError("no kept results were found")
        labels = [F.coalesce(F.try_element_at("labels", F.lit(c)), F.lit("")).alias(c) for c in columns]
        return out.select("step", *labels, (F.round("value", 6) + F.lit(0.0)).alias("value"))


for _op, _f in (("sum", "sum(value)"), ("avg", "avg(value)"), ("max", "max(value)"), ("stddev", "stddev_pop(value)")):
    _registered(f"sharded_{_op}", f"{_op} by (event_type) (sum_over_time(v[1d]))", ("event_type",), _SUM + f"SELECT step, event_type, round({_f}, 6) AS value FROM x GROUP BY ALL")
_registered("sharded_topk", "topk by (event_type) (1, sum_over_time(v[1d]))", ("event_type", "u"), _SUM + "SELECT step, event_type, u, round(value, 6) AS value FROM x QUALIFY row_number() OVER (PARTITION BY step, event_type ORDER BY value DESC, u) <= 1")
_registered("split", "sum_over_time(v[1d])", ("event_type", "u"), _SUM + "SELECT step, event_type, u, round(value, 6) AS value FROM x")
_registered("kept_results", "count by (event_type) (sum_over_time(v[1d]))", ("event_type",), _SUM + "SELECT step, event_type, count(*)::DOUBLE AS value FROM x GROUP BY ALL", keep=True)
