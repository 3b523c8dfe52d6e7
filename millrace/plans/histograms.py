"""Native histograms: sparse exponential (or custom) buckets as rows, merged and read with built-in functions.

A histogram is a struct of schema, zero_threshold, zero_count, count, sum, two maps
(bucket number to count) for positive and negative values, and custom bounds. In
schema s, bucket i holds values in (2^((i-1)/2^s), 2^(i/2^s)]; in schema -53, bucket
i ends at the i-th custom bound. Histograms of different resolution meet in the
coarsest one: two neighbouring buckets of a schema are one of the next below.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.registry import query, views

TYPE = "struct<schema:int,zero_threshold:double,zero_count:double,count:double,sum:double,positive:map<int,double>,negative:map<int,double>,custom:array<double>>"
CUSTOM = -53


def _coarser(buckets: Column, by: Column) -> Column:
    """(number, count) entries with their numbers in the schema that is ``by`` below; numbers may repeat."""
    number = lambda i: F.ceil(i / F.pow(F.lit(2.0), by)).cast("int")
    return F.transform(F.map_entries(buckets), lambda e: F.struct(number(e["key"]).alias("i"), e["value"].alias("n")))


def merged(df: DataFrame, keys: list[str], hist: str = "hist", weight: Column | None = None) -> DataFrame:
    """keys and the sum of their histograms; ``weight`` multiplies each one (-1 subtracts).

    Two levels of partial aggregation: a row for each bucket, then one map for each
    key, whose size is bounded by the number of buckets.
    """
    w = F.lit(1.0) if weight is None else weight
    h = F.col(hist)
    low = df.where(h.isNotNull()).groupBy(*keys).agg(F.min(F.when(h["schema"] != CUSTOM, h["schema"])).alias("_schema"), F.max(h["zero_threshold"]).alias("_zero"), F.sum(h["count"] * w).alias("_count"), F.sum(h["sum"] * w).alias("_sum"), F.sum(h["zero_count"] * w).alias("_zeros"), F.max(h["custom"]).alias("_custom"))
    same = F.lit(True)
    a = df.where(h.isNotNull()).select(*[F.col(k).alias("_k_" + k) for k in keys], h.alias("_h"), w.alias("_w"))
    for k in keys:
        same = same & F.col("_k_" + k).eqNullSafe(F.col(k))
    by = F.when(F.col("_h.schema") == CUSTOM, F.lit(0)).otherwise(F.col("_h.schema") - F.col("_schema"))
    rows = a.join(low, same).select(*keys, "_schema", "_zero", "_count", "_sum", "_zeros", "_custom", "_w", F.explode_outer(F.concat(F.transform(_coarser(F.col("_h.positive"), by), lambda e: F.struct(F.lit(1).alias("side"), e["i"].alias("i"), e["n"].alias("n"))), F.transform(_coarser(F.col("_h.negative"), by), lambda e: F.struct(F.lit(-1).alias("side"), e["i"].alias("i"), e["n"].alias("n"))))).alias("e"))
    # Buckets that lie inside the widest zero bucket belong to it.
    inside = (F.col("_zero") > 0) & F.col("_schema").isNotNull() & (F.pow(F.lit(2.0), F.col("e.i") / F.pow(F.lit(2.0), F.col("_schema"))) <= F.col("_zero"))
    rows = rows.withColumn("side", F.when(inside, 0).otherwise(F.col("e.side"))).groupBy(*keys, "_schema", "_zero", "_count", "_sum", "_zeros", "_custom", "side", F.when(F.col("side") != 0, F.col("e.i")).alias("i")).agg(F.sum(F.col("e.n") * F.col("_w")).alias("n"))
    side = lambda s: F.map_from_entries(F.filter(F.collect_list(F.when((F.col("side") == s) & (F.col("n") != 0), F.struct("i", "n"))), lambda e: e.isNotNull()))
    out = rows.groupBy(*keys, "_schema", "_zero", "_count", "_sum", "_zeros", "_custom").agg(side(1).alias("_p"), side(-1).alias("_n"), F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0.0)).alias("_more"))
    packed = F.struct(F.coalesce("_schema", F.lit(CUSTOM)).alias("schema"), F.col("_zero").alias("zero_threshold"), (F.col("_zeros") + F.col("_more")).alias("zero_count"), F.col("_count").alias("count"), F.col("_sum").alias("sum"), F.col("_p").alias("positive"), F.col("_n").alias("negative"), F.col("_custom").alias("custom"))
    return out.select(*keys, packed.cast(TYPE).alias(hist))


def _bound(schema: Column, i: Column, custom: Column) -> Column:
    return F.when(schema == CUSTOM, F.coalesce(F.get(custom, i), F.lit(math.inf))).otherwise(F.pow(F.lit(2.0), i / F.pow(F.lit(2.0), schema)))


def spans(h: Column) -> Column:
    """Buckets in ascending order as (lo, hi, n), the zero bucket among them."""
    lower = lambda i: F.when((h["schema"] == CUSTOM) & (i == 0), F.when(F.get(h["custom"], F.lit(0)) > 0, 0.0).otherwise(F.lit(-math.inf))).otherwise(_bound(h["schema"], i - 1, h["custom"]))
    entry = lambda lo, hi, n: F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), n.alias("n"))
    pos = F.transform(F.map_entries(h["positive"]), lambda e: entry(lower(e["key"]), _bound(h["schema"], e["key"], h["custom"]), e["value"]))
    neg = F.transform(F.map_entries(h["negative"]), lambda e: entry(-_bound(h["schema"], e["key"], h["custom"]), -lower(e["key"]), e["value"]))
    zero_lo = F.when(F.size(h["negative"]) == 0, 0.0).otherwise(-h["zero_threshold"])
    zero_hi = F.when(F.size(h["positive"]) == 0, 0.0).otherwise(h["zero_threshold"])
    zero = F.when(h["zero_count"] > 0, F.array(entry(zero_lo, zero_hi, h["zero_count"]))).otherwise(F.array().cast("array<struct<lo:double,hi:double,n:double>>"))
    kind = "array<struct<lo:double,hi:double,n:double>>"
    return F.sort_array(F.concat(neg.cast(kind), zero.cast(kind), pos.cast(kind)))


def _inside(b: Column, share: Column, linear: Column) -> Column:
    """The value that the share of a bucket's observations reaches: exponential between bounds of one sign, else linear."""
    straight = b["lo"] + (b["hi"] - b["lo"]) * share
    up = b["lo"] * F.pow(b["hi"] / b["lo"], share)
    down = b["hi"] * F.pow(b["lo"] / b["hi"], 1 - share)
    return F.when(linear | ((b["lo"] <= 0) & (b["hi"] >= 0)), straight).when(b["lo"] > 0, up).otherwise(down)


def _running(b: Column) -> Column:
    """Buckets with ``before``, the count of those below."""
    start = F.struct(F.lit(0.0).alias("n"), F.slice(F.transform(b, lambda e: F.struct(e["lo"].alias("lo"), e["hi"].alias("hi"), e["n"].alias("n"), F.lit(0.0).alias("before"))), 1, 0).alias("out"))
    step = lambda acc, e: F.struct((acc["n"] + e["n"]).alias("n"), F.concat(acc["out"], F.array(F.struct(e["lo"].alias("lo"), e["hi"].alias("hi"), e["n"].alias("n"), acc["n"].alias("before")))).alias("out"))
    return F.aggregate(b, start, step, lambda acc: acc["out"])


def quantile(q: float, h: Column) -> Column:
    if q < 0:
        return F.lit(-math.inf)
    if q > 1:
        return F.lit(math.inf)
    rank = F.lit(q) * h["count"]
    reach = F.filter(_running(spans(h)), lambda e: (e["before"] + e["n"] >= rank) & (e["n"] > 0))
    value = F.transform(F.slice(reach, 1, 1), lambda e: _inside(e, (rank - e["before"]) / e["n"], h["schema"] == CUSTOM))
    return F.when((h["count"] == 0) | h["count"].isNull(), F.lit(math.nan)).otherwise(F.coalesce(F.get(value, F.lit(0)), F.lit(math.nan)))


def fraction(lower: float, upper: float, h: Column) -> Column:
    if lower >= upper:
        return F.when(h["count"] > 0, 0.0).otherwise(F.lit(math.nan))

    def below(x: float) -> Column:
        def share(e: Column) -> Column:
            straight = (F.lit(x) - e["lo"]) / (e["hi"] - e["lo"])
            curved = F.when(e["lo"] > 0, F.ln(F.lit(x) / e["lo"]) / F.ln(e["hi"] / e["lo"])).otherwise(1 - F.ln(F.lit(x) / e["hi"]) / F.ln(e["lo"] / e["hi"]))
            part = F.when((h["schema"] == CUSTOM) | ((e["lo"] <= 0) & (e["hi"] >= 0)), straight).otherwise(curved)
            return F.when(F.lit(x) >= e["hi"], 1.0).when(F.lit(x) <= e["lo"], 0.0).otherwise(part)

        return F.aggregate(spans(h), F.lit(0.0), lambda acc, e: acc + e["n"] * share(e))

    return F.when(h["count"] > 0, (below(upper) - below(lower)) / h["count"]).otherwise(F.lit(math.nan))


def average(h: Column) -> Column:
    return F.when(h["count"] > 0, h["sum"] / h["count"]).otherwise(F.lit(math.nan))


def variance(h: Column) -> Column:
    """Around the mean, with each bucket at the geometric (zero and custom: arithmetic) mean of its bounds."""
    middle = lambda e: F.when((e["lo"] < 0) & (e["hi"] < 0), -F.sqrt(e["lo"] * e["hi"])).when((e["lo"] > 0) & (h["schema"] != CUSTOM), F.sqrt(e["lo"] * e["hi"])).when((e["lo"] <= 0) & (e["hi"] >= 0) & (h["schema"] != CUSTOM), 0.0).otherwise((e["lo"] + e["hi"]) / 2)
    total = F.aggregate(spans(h), F.lit(0.0), lambda acc, e: acc + e["n"] * F.pow(middle(e) - average(h), F.lit(2.0)))
    return F.when(h["count"] > 0, total / h["count"]).otherwise(F.lit(math.nan))


def increase(samples: DataFrame, keys: list[str], ts: str = "ts", hist: str = "hist") -> DataFrame:
    """keys and the growth of their histograms from first to last sample; a smaller count than before is a reset."""
    w = W.partitionBy(*keys).orderBy(ts)
    df = samples.withColumn("_before", F.lag(hist).over(w)).where("_before IS NOT NULL")
    reset = F.col(hist)["count"] < F.col("_before")["count"]
    new = df.select(*keys, F.col(hist), F.lit(1.0).alias("_sign"))
    old = df.where(~reset).select(*keys, F.col("_before").alias(hist), F.lit(-1.0).alias("_sign"))
    return merged(new.unionByName(old), keys, hist, F.col("_sign"))


def observed(df: DataFrame, keys: list[str], value: str, schema: int, zero_threshold: float = 1e-9) -> DataFrame:
    """Histograms of values by key: the sink's side, with partial aggregation over buckets."""
    x = F.col(value)
    i = F.ceil(F.log2(F.abs(x)) * float(2**schema)).cast("int")
    side = F.when(F.abs(x) <= zero_threshold, 0).when(x > 0, 1).otherwise(-1)
    rows = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys, side.alias("side"), F.when(F.abs(x) > zero_threshold, i).alias("i")).agg(F.count("*").cast("double").alias("n"), F.sum(x).alias("s"))
    part = lambda s: F.map_from_entries(F.filter(F.collect_list(F.when(F.col("side") == s, F.struct("i", "n"))), lambda e: e.isNotNull()))
    zero = F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0.0))
    packed = F.struct(F.lit(schema).alias("schema"), F.lit(zero_threshold).alias("zero_threshold"), zero.alias("zero_count"), F.sum("n").alias("count"), F.sum("s").alias("sum"), part(1).alias("positive"), part(-1).alias("negative"), F.array().cast("array<double>").alias("custom"))
    return rows.groupBy(*keys).agg(packed.cast(TYPE).alias("hist"))


def _daily(spark: SparkSession, sf_dir: str, schema: int = 1) -> DataFrame:
    e = views(spark, sf_dir, "events").sql("SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, value FROM events")
    return observed(e, ["event_type", "day"], "value", schema)


_H = """b AS (SELECT event_type, ceil(log2(value) * 2) AS i, count(*)::DOUBLE AS n FROM events WHERE value > 1e-9 GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY i) - n AS before, sum(n) OVER (PARTITION BY event_type) AS total FROM b)"""


@query("native_histogram_accessors", "SELECT event_type, count(*)::DOUBLE AS n, round(sum(value), 4) AS s, round(avg(value), 6) AS a FROM events GROUP BY event_type")
def accessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """histogram_count, _sum and _avg of the sum of daily histograms."""
    h = F.col("hist")
    return merged(_daily(spark, sf_dir), ["event_type"]).select("event_type", h["count"].alias("n"), F.round(h["sum"], 4).alias("s"), F.round(average(h), 6).alias("a"))


@query("native_histogram_quantile", f"WITH {_H} SELECT event_type, round(arg_min(CASE WHEN i IS NULL THEN 0 ELSE 2 ** ((i - 1) / 2) * (2 ** (1 / 2.0::DOUBLE)) ** ((0.9 * total - before) / n) END, i), 5) AS q FROM c WHERE before + n >= 0.9 * total GROUP BY event_type")
def native_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(_daily(spark, sf_dir), ["event_type"]).select("event_type", F.round(quantile(0.9, F.col("hist")), 5).alias("q"))


@query("native_histogram_fraction", "SELECT event_type, round(count(*) FILTER (WHERE value > 2 AND value <= 32) / count(*)::DOUBLE, 6) AS f FROM events GROUP BY event_type")
def native_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds that are bucket bounds need no interpolation."""
    return merged(_daily(spark, sf_dir), ["event_type"]).select("event_type", F.round(fraction(2.0, 32.0, F.col("hist")), 6).alias("f"))


@query("native_histogram_mixed_schemas", "SELECT event_type, ceil(log2(value))::INTEGER AS i, count(*)::DOUBLE AS n FROM events WHERE value > 1e-9 GROUP BY ALL")
def mixed_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of schema 3 and 0 meet in schema 0."""
    both = _daily(spark, sf_dir, 3).where("day(day) % 2 = 0").unionByName(_daily(spark, sf_dir, 0).where("day(day) % 2 = 1"))
    return merged(both, ["event_type"]).select("event_type", F.explode("hist.positive").alias("i", "n"))


@query("native_histogram_increase", "SELECT event_type, count(*)::DOUBLE AS n FROM events WHERE date_trunc('day', ts) > (SELECT min(date_trunc('day', ts)) FROM events e WHERE e.event_type = events.event_type) GROUP BY event_type")
def native_increase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of running histograms: all observations after the first day's."""
    d = _daily(spark, sf_dir)
    days = d.select("event_type", "day").distinct()
    running = merged(d.withColumnRenamed("day", "_d").join(days, "event_type").where("_d <= day").drop("_d"), ["event_type", "day"])
    return increase(running, ["event_type"], "day").select("event_type", F.col("hist.count").alias("n"))
