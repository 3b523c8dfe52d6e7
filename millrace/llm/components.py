"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import settle


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def _apart(minima: DataFrame) -> DataFrame:
    """(_k, m): the key as a value of its own, which the aggregate's partitioning does not cover."""
    return minima.select(F.col("a").bitwiseXOR(F.lit(0).cast("long")).alias("_k"), "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b), roots among them; the root is the component's smallest node.

    A round groups by node with partial aggregation and joins the minima back, so
    a hub's links are never gathered in one row; rounds are logarithmic in the
    longest path. The minima are joined on a key of their own, so that join has an
    exchange on both sides and AQE can split a hub's links over tasks. The lineage
    is cut after each round. Self-links and repeated links do no harm, null ends
    are dropped, no links give no rows.
    """
    e = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = None
    while (now := _digest(e)) != before:
        before = now
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _apart(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.join(low, F.col("a") == F.col("_k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(_apart(least), F.col("a") == F.col("_k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
        e = settle(small.union(least.select("a", F.col("m").alias("b"))).distinct())
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
