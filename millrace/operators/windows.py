"""Window functions, with GROUPS frames and EXCLUDE rewritten for Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.registry import query, sql, views

_P = "FROM (SELECT p_partkey AS k, p_brand AS g, p_size AS v FROM part)"
for _n, _f in {
    "row_number": "row_number() OVER (PARTITION BY g ORDER BY v, k)",
    "rank": "rank() OVER (PARTITION BY g ORDER BY v)",
    "dense_rank": "dense_rank() OVER (PARTITION BY g ORDER BY v)",
    "percent_rank": "round(percent_rank() OVER (PARTITION BY g ORDER BY v), 8)",
    "cume_dist": "round(cume_dist() OVER (PARTITION BY g ORDER BY v), 8)",
    "ntile": "ntile(4) OVER (PARTITION BY g ORDER BY v, k)",
    "lag": "lag(v, 2, -1) OVER (PARTITION BY g ORDER BY k)",
    "lead": "lead(v) OVER (PARTITION BY g ORDER BY k)",
    "first_value": "first_value(v) OVER (PARTITION BY g ORDER BY k)",
    "last_value": "last_value(v) OVER (PARTITION BY g ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    "nth_value": "nth_value(v, 3) OVER (PARTITION BY g ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "sum": "CAST(sum(v) OVER (PARTITION BY g ORDER BY k) AS BIGINT)",
    "empty_over": "count(*) OVER ()",
    "rows_frame": "CAST(sum(v) OVER (PARTITION BY g ORDER BY k ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT)",
    "rows_single_bound": "CAST(sum(v) OVER (PARTITION BY g ORDER BY k ROWS 1 PRECEDING) AS BIGINT)",
    "rows_expression": "CAST(sum(v) OVER (PARTITION BY g ORDER BY k ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS BIGINT)",
    "range_numeric": "CAST(sum(v) OVER (PARTITION BY g ORDER BY v RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS BIGINT)",
    "range_desc": "count(*) OVER (PARTITION BY g ORDER BY v DESC RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)",
}.items():
    sql(f"window_{_n}", f"SELECT k, CAST({_f} AS {'DOUBLE' if 'round' in _f else 'BIGINT'}) AS x {_P}", "same")
sql("window_named", f"SELECT k, CAST(sum(v) OVER w AS BIGINT) AS s, CAST(row_number() OVER w AS BIGINT) AS r {_P} WINDOW w AS (PARTITION BY g ORDER BY k)", "same")
sql("window_extends_named", f"SELECT k, CAST(sum(v) OVER (w ORDER BY k ROWS 1 PRECEDING) AS BIGINT) AS s, CAST(count(*) OVER (w) AS BIGINT) AS n {_P} WINDOW w AS (PARTITION BY g)", f"SELECT k, CAST(sum(v) OVER (PARTITION BY g ORDER BY k ROWS 1 PRECEDING) AS BIGINT) AS s, CAST(count(*) OVER (PARTITION BY g) AS BIGINT) AS n {_P}")
sql("window_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM events", "same")
sql("window_range_nulls", "SELECT k, count(*) OVER (ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM (SELECT p_partkey AS k, nullif(p_size % 6, 0) AS x FROM part)", "same")
sql("window_over_groups", "SELECT o_orderstatus AS s, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC) AS BIGINT) AS r FROM orders GROUP BY o_orderstatus", "same")
sql("window_over_grouping_sets", "SELECT s, p, n, CAST(row_number() OVER (ORDER BY n DESC, s, p) AS BIGINT) AS r FROM (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority))", "same")
sql("window_distinct", f"SELECT k, CAST(size(collect_set(v) OVER (PARTITION BY g)) AS BIGINT) AS n {_P}", f"SELECT k, CAST(count(DISTINCT v) OVER (PARTITION BY g) AS BIGINT) AS n {_P}")


def groups_frame(df: DataFrame, by: list[str], order: str, value: str, before: int, after: int, name: str) -> DataFrame:
    """sum(value) over GROUPS BETWEEN before PRECEDING AND after FOLLOWING: peer groups are numbered, then it is RANGE over the number."""
    df = df.withColumn("_g", F.dense_rank().over(W.partitionBy(*by).orderBy(F.col(order).asc_nulls_last())))
    return df.withColumn(name, F.sum(value).over(W.partitionBy(*by).orderBy("_g").rangeBetween(-before, after))).drop("_g")


def excluding(df: DataFrame, by: list[str], order: str, value: str, exclude: str, name: str) -> DataFrame:
    """Running sum over RANGE UNBOUNDED PRECEDING with an EXCLUDE clause, by subtracting the row or its peers."""
    total = F.sum(value).over(W.partitionBy(*by).orderBy(F.col(order).asc_nulls_last()))
    peers = F.sum(value).over(W.partitionBy(*by, order))
    less: dict[str, Column] = {"NO OTHERS": F.lit(0), "CURRENT ROW": F.coalesce(F.col(value), F.lit(0)), "GROUP": F.coalesce(peers, F.lit(0)), "TIES": F.coalesce(peers, F.lit(0)) - F.coalesce(F.col(value), F.lit(0))}
    return df.withColumn(name, total - less[exclude])


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir, "part").sql("SELECT p_partkey AS k, p_brand AS g, p_size AS v FROM part")


@query("window_groups_frame", f"SELECT k, CAST(sum(v) OVER (PARTITION BY g ORDER BY v GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS x {_P}")
def groups_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups_frame(_parts(spark, sf_dir), ["g"], "v", "v", 1, 1, "x").select("k", "x")


for _e in ("NO OTHERS", "CURRENT ROW", "GROUP", "TIES"):

    @query("window_exclude_" + _e.lower().replace(" ", "_"), f"SELECT k, CAST(coalesce(sum(v) OVER (PARTITION BY g ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE {_e}), 0) AS BIGINT) AS x {_P}")
    def exclude_query(spark: SparkSession, sf_dir: str, e: str = _e) -> DataFrame:
        return excluding(_parts(spark, sf_dir), ["g"], "v", "v", e, "x").select("k", "x")
