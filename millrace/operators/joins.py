"""Batch joins: equi, outer, semi, anti, lateral, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.registry import query, sql, views

sql("inner_join", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", "same")
for _k in ("LEFT", "RIGHT", "FULL"):
    sql(f"{_k.lower()}_join", f"SELECT a.n_nationkey AS a, b.s_suppkey AS b FROM nation a {_k} JOIN (SELECT * FROM supplier WHERE s_nationkey < 12) b ON a.n_nationkey = b.s_nationkey AND a.n_regionkey > 0", "same")
sql("cross_join", "SELECT a.r_regionkey AS a, b.r_regionkey AS b FROM region a CROSS JOIN region b", "same")
sql("comma_join", "SELECT n.n_nationkey, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey", "same")
sql("using_join", "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y USING (k)", "same")
sql("natural_join", "SELECT * FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y", "same")
sql("self_join", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "same")
sql("multiway_join", "SELECT r.r_name, count(*) AS n FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name", "same")
sql("theta_join", "SELECT a.r_regionkey AS a, b.n_nationkey AS b FROM region a JOIN nation b ON b.n_nationkey BETWEEN a.r_regionkey * 2 AND a.r_regionkey * 3", "same")
sql("semi_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 2000)", "same")
sql("semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", "same")
sql("semi_any", "SELECT c_custkey FROM customer WHERE c_custkey = ANY (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", "same")
sql("anti_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderkey % 3 = 0)", "same")
sql("anti_not_in", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 6)", "same")
sql("compare_all", "SELECT p_partkey FROM part WHERE p_retailprice >= ALL (SELECT p_retailprice FROM part)", "same")
sql("lateral_join", "SELECT c.c_custkey, t.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t", "same")
sql("lateral_left_join", "SELECT c.c_custkey, t.n FROM customer c LEFT JOIN LATERAL (SELECT max(o_orderkey) AS n FROM orders o WHERE o.o_custkey = c.c_custkey HAVING count(*) > 2) t ON true", "same")


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, values: list[str], how: str = "left", chunk: int | None = None) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before its time.

    Both sides are united and swept by one window over the key: one exchange, no
    range join, and a running value streams through a key's rows. A null key
    matches nothing.

    With ``chunk`` (a width of the times, which are then numbers) a key is cut
    into pieces of time, so that a hot one is dealt over tasks: a small table of
    (key, piece) says which value stands when a piece begins, and the sweep goes
    over pieces.
    """
    packed = F.struct(*values)
    right = right.where(" AND ".join(f"`{k}` IS NOT NULL" for k in by))
    a = left.withColumn("_row", F.struct(*left.columns)).select(*by, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"), "_row", F.lit(None).cast(right.select(packed).schema[0].dataType).alias("_v"))
    b = right.select(*by, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), packed.alias("_v"))
    both = a.unionByName(b)
    if chunk:
        both = both.withColumn("_c", F.floor(F.col("_t") / chunk))
        pieces = both.groupBy(*by, "_c").agg(F.max(F.when(F.col("_side") == 0, F.struct("_t", "_v")))["_v"].alias("_end"))
        before = W.partitionBy(*by).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
        pieces = pieces.select(*by, "_c", F.last("_end", ignorenulls=True).over(before).alias("_begin"))
        both = both.join(pieces, [*by, "_c"], "left")
    w = W.partitionBy(*by, *(["_c"] if chunk else [])).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    last = F.last("_v", ignorenulls=True).over(w)
    out = both.withColumn("_last", F.coalesce(last, F.col("_begin")) if chunk else last).where("_side = 1")
    if how == "inner":
        out = out.where("_last IS NOT NULL")
    return out.select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def interval(left: DataFrame, right: DataFrame, by: Column, left_ts: Column, right_ts: Column, before: int, after: int, how: str = "inner") -> DataFrame:
    """Pairs of a key with left - before <= right <= left + after, in whole units of the times.

    Times are cut into buckets of the window's width and the left side is sent to
    each bucket it reaches (three at most), so the join is an equi-join on key and
    bucket instead of a range join. ``how`` is inner or left.

    Left: the buckets of a left row are joined as an outer join, and a count over
    the row's content says whether any of them has a partner. Rows of the same
    content have the same partners, so repeated rows and nulls in any column are
    no matter: a row without partner comes once for each time it stands on the left.
    """
    width = max(1, before + after)
    first, last = F.floor((left_ts - before) / width), F.floor((left_ts + after) / width)
    b = right.withColumn("_c", F.floor(right_ts / width))
    on = by & (F.col("_b") == F.col("_c")) & right_ts.between(left_ts - before, left_ts + after)
    if how == "inner":
        return left.withColumn("_b", F.explode(F.sequence(first, last))).join(b, on).drop("_b", "_c")
    a = left.withColumn("_home", F.coalesce(first, F.lit(0))).withColumn("_b", F.explode(F.coalesce(F.sequence(first, last), F.array(F.lit(0).cast("long")))))
    out = a.join(b.withColumn("_hit", F.lit(1)), on, "left")
    partners = F.count("_hit").over(W.partitionBy(*left.columns))
    return out.withColumn("_n", partners).where("_hit = 1 OR (_n = 0 AND _b = _home)").drop("_b", "_c", "_home", "_hit", "_n")


@query("asof_join", """
SELECT e.event_id, max(o.o_orderkey) AS last_order FROM (SELECT event_id, user_id FROM events) e
JOIN (SELECT o_custkey, o_orderkey FROM orders) o ON o.o_custkey = e.user_id AND o.o_orderkey <= e.event_id GROUP BY e.event_id""")
def asof_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir, "events", "orders")
    e = v.table("events").select("event_id", F.col("user_id").alias("k"), F.col("event_id").alias("t"))
    o = v.table("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("t"), F.col("o_orderkey").alias("last_order"))
    return as_of(e, o, ["k"], "t", "t", ["last_order"], "inner", chunk=1 << 20).select("event_id", "last_order")


@query("interval_join", """
SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view'
AND epoch_us(b.ts) BETWEEN epoch_us(a.ts) - 3600000000 AND epoch_us(a.ts) + 7200000000""")
def interval_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views(spark, sf_dir, "events").sql("SELECT event_id, user_id, event_type, unix_micros(CAST(ts AS TIMESTAMP)) AS us FROM events")
    a = e.where("event_type = 'click'").select(F.col("event_id").alias("a"), F.col("user_id").alias("ua"), F.col("us").alias("ta"))
    b = e.where("event_type = 'view'").select(F.col("event_id").alias("b"), F.col("user_id").alias("ub"), F.col("us").alias("tb"))
    return interval(a, b, F.col("ua") == F.col("ub"), F.col("ta"), F.col("tb"), 3_600_000_000, 7_200_000_000).select("a", "b")


@query("interval_left_join", """
SELECT a.event_id AS a, b.event_id AS b FROM (SELECT * FROM events WHERE event_type = 'purchase') a LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id
AND epoch_us(b.ts) BETWEEN epoch_us(a.ts) - 600000000 AND epoch_us(a.ts)""")
def interval_left_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views(spark, sf_dir, "events").sql("SELECT event_id, user_id, event_type, unix_micros(CAST(ts AS TIMESTAMP)) AS us FROM events")
    a = e.where("event_type = 'purchase'").select(F.col("event_id").alias("a"), F.col("user_id").alias("ua"), F.col("us").alias("ta"))
    b = e.where("event_type = 'view'").select(F.col("event_id").alias("b"), F.col("user_id").alias("ub"), F.col("us").alias("tb"))
    return interval(a, b, F.col("ua") == F.col("ub"), F.col("ta"), F.col("tb"), 600_000_000, 0, "left").select("a", "b")


@query("interval_left_join_nulls", """
WITH a AS (SELECT nullif(event_id % 3, 0) AS a, nullif(user_id % 4, 1) AS ua, CASE WHEN event_id % 11 > 0 THEN epoch_us(ts) // 600000000 END AS ta FROM events WHERE event_type = 'purchase'),
b AS (SELECT event_id AS b, user_id AS ub, epoch_us(ts) // 600000000 AS tb FROM events WHERE event_type = 'view')
SELECT a, ua, ta, b FROM a LEFT JOIN b ON ua = ub AND tb BETWEEN ta - 30 AND ta + 6""")
def interval_left_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left rows with nulls in every column, in key and time too, many of them repeated."""
    e = views(spark, sf_dir, "events").sql("SELECT event_id, user_id, event_type, unix_micros(CAST(ts AS TIMESTAMP)) div 600000000 AS t FROM events")
    a = e.where("event_type = 'purchase'").selectExpr("nullif(event_id % 3, 0) AS a", "nullif(user_id % 4, 1) AS ua", "CASE WHEN event_id % 11 > 0 THEN t END AS ta")
    b = e.where("event_type = 'view'").selectExpr("event_id AS b", "user_id AS ub", "t AS tb")
    return interval(a, b, F.col("ua") == F.col("ub"), F.col("ta"), F.col("tb"), 30, 6, "left").select("a", "ua", "ta", "b")
