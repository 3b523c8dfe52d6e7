"""Windows of streams and tables; every function serves batch and streaming DataFrames unless it says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keyed(df: DataFrame, key: str) -> DataFrame:
    """Aggregations and joins need keys: rows without one are left out."""
    return df.where(F.col(key).isNotNull())


def tumbling(df: DataFrame, key: str, ts: str, size: str, *aggregates: Column) -> DataFrame:
    return hopping(df, key, ts, size, size, *aggregates)


def hopping(df: DataFrame, key: str, ts: str, size: str, slide: str, *aggregates: Column) -> DataFrame:
    out = keyed(df, key).groupBy(key, F.window(ts, size, slide).alias("w")).agg(*aggregates)
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in out.columns if c not in (key, "w")])


def sessions(df: DataFrame, key: str, ts: str, gap: str, gap_us: int, *aggregates: Column) -> DataFrame:
    """Sessions whose bounds are their first and last record (Spark's end is the last and the gap)."""
    out = keyed(df, key).groupBy(key, F.session_window(ts, gap).alias("w")).agg(*aggregates)
    end = F.timestamp_micros(F.unix_micros(F.col("w.end").cast("timestamp")) - gap_us)
    return out.select(key, F.col("w.start").alias("start"), end.alias("end"), *[c for c in out.columns if c not in (key, "w")])


def sliding(df: DataFrame, key: str, ms: str, width: int, value: str) -> DataFrame:
    """Data-defined windows, inclusive at both ends (batch): one ends at each record, one starts just after each, empty ones left out.

    Counts and sums come from running totals over the key's times: the frame is a
    RANGE of numbers, so there is no join of records with windows.
    """
    df = keyed(df, key).select(key, F.col(ms).cast("long").alias("t"), F.col(value).alias("v"))
    starts = df.select(key, (F.col("t") - width).alias("start")).union(df.select(key, F.col("t") + 1)).distinct()
    marks = starts.select(key, F.col("start").alias("t"), F.lit(0).alias("n"), F.lit(0.0).alias("v"), F.lit(True).alias("mark"))
    both = df.select(key, "t", F.lit(1).alias("n"), F.col("v").cast("double").alias("v"), F.lit(False).alias("mark")).union(marks)
    frame = W.partitionBy(key).orderBy("t").rangeBetween(0, width)
    out = both.withColumn("count", F.sum("n").over(frame)).withColumn("total", F.sum("v").over(frame)).where("mark AND count > 0")
    return out.select(key, F.col("t").alias("start"), (F.col("t") + width).alias("end"), "count", "total")


def latest(df: DataFrame, key: str, ts: str) -> DataFrame:
    """The table of a stream: the last record of each key (ties by all columns)."""
    rest = [c for c in df.columns if c != key]
    return keyed(df, key).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, *rest)).alias("r")).select(key, "r.*")


def versions(df: DataFrame, key: str, ts: str) -> DataFrame:
    """A versioned table: each record with valid_from and valid_to (null: now)."""
    return keyed(df, key).withColumn("valid_from", F.col(ts)).withColumn("valid_to", F.lead(ts).over(W.partitionBy(key).orderBy(ts)))
