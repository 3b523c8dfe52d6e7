"""Aggregates and grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.registry import query, sql, views

sql("group_by_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey HAVING count(*) > 1", "same")
sql("group_by_expression", "SELECT p_size % 5 AS k, count(*) AS n FROM part GROUP BY p_size % 5", "same")
sql("group_by_ordinal", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2", "same")
sql("basic_aggregates", "SELECT count(*) AS n, count(nullif(p_size, 7)) AS c, CAST(sum(p_size) AS BIGINT) AS s, round(avg(p_size), 6) AS a, min(p_name) AS lo, max(p_retailprice) AS hi FROM part", "same")
sql("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "same")
sql("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag)::TINYINT AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("grouping_sets", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", "same")
sql("grouping_sets_nested", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY GROUPING SETS (ROLLUP (o_orderstatus, o_orderpriority), (o_orderpriority))",
    "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (), (o_orderpriority))")
sql("group_by_nothing", "SELECT count(*) AS n FROM orders GROUP BY GROUPING SETS (())", "SELECT count(*) AS n FROM orders")
sql("group_by_distinct_sets", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY DISTINCT ROLLUP (o_orderstatus, o_orderpriority), ROLLUP (o_orderstatus)",
    "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("grouping_of_two", "SELECT o_orderstatus AS s, o_orderpriority AS p, grouping(o_orderstatus, o_orderpriority) AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "SELECT o_orderstatus AS s, o_orderpriority AS p, grouping(o_orderstatus, o_orderpriority)::BIGINT AS g, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("group_by_distinct_cube", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY DISTINCT CUBE (o_orderstatus, o_orderpriority), GROUPING SETS ((o_orderstatus), ())",
    "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
sql("degenerate_having", "SELECT 1 AS one HAVING 1 < 2", "SELECT 1 AS one")
sql("aggregate_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 1000) AS n, count(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 1000) AS d FROM orders GROUP BY o_orderstatus", "same")
sql("distinct_aggregates", "SELECT p_brand, count(DISTINCT p_size) AS n, CAST(sum(DISTINCT p_size) AS BIGINT) AS s FROM part GROUP BY p_brand", "same")
sql("aggregate_order_by", "SELECT n_regionkey, array_join(transform(sort_array(collect_list(struct(n_name, n_nationkey)), false), x -> x.n_name), ',') AS names FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
sql("string_agg", "SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("array_agg_nulls", "SELECT k, size(collect_list(struct(x))) AS n, size(array_agg(x)) AS present FROM (SELECT n_regionkey AS k, nullif(n_nationkey % 3, 0) AS x FROM nation) GROUP BY k", "SELECT k, len(array_agg(x))::INTEGER AS n, count(x)::INTEGER AS present FROM (SELECT n_regionkey AS k, nullif(n_nationkey % 3, 0) AS x FROM nation) GROUP BY k")
sql("bool_aggregates", "SELECT p_brand, bool_and(p_size > 2) AS a, bool_or(p_size > 48) AS o, every(p_size > 0) AS e FROM part GROUP BY p_brand", "SELECT p_brand, bool_and(p_size > 2) AS a, bool_or(p_size > 48) AS o, bool_and(p_size > 0) AS e FROM part GROUP BY p_brand")
sql("bit_aggregates", "SELECT p_brand, bit_and(p_size) AS a, bit_or(p_size) AS o, bit_xor(p_size) AS x FROM part GROUP BY p_brand", "same")
sql("variance_family", "SELECT p_brand, round(var_pop(p_size), 6) AS vp, round(var_samp(p_size), 6) AS vs, round(stddev_pop(p_size), 6) AS sp, round(stddev_samp(p_size), 6) AS ss, round(variance(p_size), 6) AS v FROM part GROUP BY p_brand", "same")
sql("regression_family", """SELECT round(corr(p_size, p_retailprice), 8) AS c, round(covar_pop(p_size, p_retailprice), 4) AS cp, round(covar_samp(p_size, p_retailprice), 4) AS cs, round(regr_slope(p_size, p_retailprice), 8) AS sl,
round(regr_intercept(p_size, p_retailprice), 6) AS ic, round(regr_r2(p_size, p_retailprice), 8) AS r2, regr_count(p_size, p_retailprice) AS n, round(regr_avgx(p_size, p_retailprice), 4) AS ax, round(regr_avgy(p_size, p_retailprice), 4) AS ay,
round(regr_sxx(p_size, p_retailprice), 2) AS sxx, round(regr_syy(p_size, p_retailprice), 2) AS syy, round(regr_sxy(p_size, p_retailprice), 2) AS sxy FROM part""",
    """SELECT round(corr(p_size, p_retailprice), 8) AS c, round(covar_pop(p_size, p_retailprice), 4) AS cp, round(covar_samp(p_size, p_retailprice), 4) AS cs, round(regr_slope(p_size, p_retailprice), 8) AS sl,
round(regr_intercept(p_size, p_retailprice), 6) AS ic, round(regr_r2(p_size, p_retailprice), 8) AS r2, regr_count(p_size, p_retailprice)::BIGINT AS n, round(regr_avgx(p_size, p_retailprice), 4) AS ax, round(regr_avgy(p_size, p_retailprice), 4) AS ay,
round(regr_sxx(p_size, p_retailprice), 2) AS sxx, round(regr_syy(p_size, p_retailprice), 2) AS syy, round(regr_sxy(p_size, p_retailprice), 2) AS sxy FROM part""")
sql("ordered_set_aggregates", "SELECT p_brand, percentile_cont(0.5) WITHIN GROUP (ORDER BY p_size) AS c, CAST(percentile_disc(0.25) WITHIN GROUP (ORDER BY p_size) AS DOUBLE) AS d FROM part GROUP BY p_brand", "SELECT p_brand, quantile_cont(p_size, 0.5)::DOUBLE AS c, quantile_disc(p_size, 0.25)::DOUBLE AS d FROM part GROUP BY p_brand")
sql("mode_aggregate", "SELECT k, mode(x, true) AS m FROM (SELECT o_orderstatus AS k, o_custkey % 2 AS x FROM orders UNION ALL SELECT 'O', 1 UNION ALL SELECT 'F', 1 UNION ALL SELECT 'P', 1) GROUP BY k",
    "SELECT k, CASE WHEN sum(x) * 2 > count(*) THEN 1 ELSE 0 END::BIGINT AS m FROM (SELECT o_orderstatus AS k, o_custkey % 2 AS x FROM orders UNION ALL SELECT 'O', 1 UNION ALL SELECT 'F', 1 UNION ALL SELECT 'P', 1) GROUP BY k")
sql("json_agg", "SELECT n_regionkey, to_json(sort_array(collect_list(n_nationkey))) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, to_json(list_sort(list(n_nationkey)))::VARCHAR AS j FROM nation GROUP BY n_regionkey")
sql("json_object_agg", "SELECT to_json(map_from_entries(sort_array(collect_list(struct(r_name, r_regionkey))))) AS j FROM region", "SELECT '{' || string_agg('\"' || r_name || '\":' || r_regionkey, ',' ORDER BY r_name) || '}' AS j FROM region")
sql("nonfinite_aggregates", "SELECT CAST(max(x) AS STRING) AS hi, CAST(sum(x) AS STRING) AS s, count(x) AS n FROM (VALUES (DOUBLE('NaN')), (DOUBLE('1')), (DOUBLE('Infinity'))) AS v(x)", "SELECT 'NaN' AS hi, 'NaN' AS s, 3::BIGINT AS n")
sql("approx_distinct_exact_check", "SELECT count(DISTINCT l_partkey) AS n FROM lineitem", "same")


@query("approx_count_distinct")
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HyperLogLog++: an estimate, so it has no twin."""
    return views(spark, sf_dir, "lineitem").table("lineitem").agg(F.approx_count_distinct("l_partkey").alias("n"))


@query("range_agg", """
WITH s AS (SELECT l_suppkey AS k, l_linenumber + l_orderkey % 50 AS lo, l_linenumber + l_orderkey % 50 + 2 AS hi FROM lineitem),
o AS (SELECT *, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS grp FROM o)
SELECT k, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY k, grp""")
def range_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of half-open ranges of each key as disjoint ranges (gaps and islands)."""
    return views(spark, sf_dir, "lineitem").sql("""
WITH s AS (SELECT l_suppkey AS k, l_linenumber + l_orderkey % 50 AS lo, l_linenumber + l_orderkey % 50 + 2 AS hi FROM lineitem),
o AS (SELECT *, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS grp FROM o)
SELECT k, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY k, grp""")


@query("user_aggregate", "SELECT p_brand, CAST(sum(p_size * p_size) AS BIGINT) AS v FROM part GROUP BY p_brand")
def user_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user aggregate (state, step, finish) as a fold; a sum of squares."""
    p = views(spark, sf_dir, "part").table("part")
    fold = F.aggregate(F.collect_list("p_size"), F.lit(0).cast("long"), lambda s, x: s + x * x, lambda s: s)
    return p.groupBy("p_brand").agg(fold.alias("v"))


@query("table_aggregate_signed", "SELECT o_orderstatus AS k, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY o_orderstatus")
def table_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table aggregate with adder and subtractor: every tenth order is deleted by its change record."""
    o = views(spark, sf_dir, "orders").table("orders").select(F.col("o_orderstatus").alias("k"), F.col("o_totalprice").alias("v"), "o_orderkey")
    change = o.select("k", "v", F.lit(1).alias("sign")).union(o.where("o_orderkey % 10 = 0").select("k", "v", F.lit(-1).alias("sign")))
    return change.groupBy("k").agg(F.sum("sign").alias("n"), F.round(F.sum(F.col("sign") * F.col("v").cast("decimal(18,2)")).cast("double"), 2).alias("s"))


@query("cogroup", "SELECT k, sum(o)::BIGINT AS orders, sum(e)::BIGINT AS events FROM (SELECT o_custkey AS k, 1 AS o, 0 AS e FROM orders UNION ALL SELECT user_id, 0, 1 FROM events) GROUP BY k")
def cogroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams grouped by one key into one aggregate: tagged inputs, one exchange."""
    v = views(spark, sf_dir, "orders", "events")
    tagged = v.table("orders").select(F.col("o_custkey").alias("k"), F.lit("o").alias("tag")).union(v.table("events").select("user_id", F.lit("e")))
    return tagged.groupBy("k").agg(F.count_if(F.col("tag") == "o").alias("orders"), F.count_if(F.col("tag") == "e").alias("events"))
