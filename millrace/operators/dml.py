"""DML as DataFrames: each statement returns the changed table or the changed rows with their action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.registry import query, views


def merge(target: DataFrame, source: DataFrame, keys: list[str], matched: dict[str, Column] | str | None = None, insert: bool = True, by_source: str | None = None, action: bool = False) -> DataFrame:
    """MERGE by equal keys; ``matched`` is DELETE, or new values that may use s.<column>; ``by_source`` may be DELETE.

    One full outer join on the keys; with ``action`` the rows carry merge_action().
    """
    names = target.columns
    t = target.select(*[F.col(c).alias("t_" + c) for c in names], F.lit(1).alias("_t"))
    s = source.select(*[F.col(c).alias("s_" + c) for c in source.columns], F.lit(1).alias("_s"))
    j = t.join(s, [F.col("t_" + k) == F.col("s_" + k) for k in keys], "full")
    both, only_t, only_s = F.col("_t").isNotNull() & F.col("_s").isNotNull(), F.col("_s").isNull(), F.col("_t").isNull()
    what = F.when(both, F.lit({None: "KEEP", "DELETE": "DELETE"}.get(matched if not isinstance(matched, dict) else "", "UPDATE"))).when(only_t, F.lit(by_source or "KEEP")).when(only_s, F.lit("INSERT" if insert else "SKIP"))
    new = matched if isinstance(matched, dict) else {}
    out = [F.when(only_s, F.col("s_" + c) if c in source.columns else F.lit(None)).when(both, new.get(c, F.col("t_" + c))).otherwise(F.col("t_" + c)).alias(c) for c in names]
    j = j.select(*out, what.alias("merge_action")).where("merge_action <> 'SKIP'")
    return j if action else j.where("merge_action <> 'DELETE'").drop("merge_action")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: dict[str, Column] | None) -> DataFrame:
    """INSERT ... ON CONFLICT DO UPDATE, or DO NOTHING without ``update``; the first source row of a key counts."""
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*source.columns))
    return merge(target, source.withColumn("_n", nth).where("_n = 1").drop("_n"), keys, update)


def update_from(target: DataFrame, source: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    return merge(target, source, keys, values, insert=False)


def delete_using(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(source.select(*keys).distinct(), keys, "left_anti")


def violations(df: DataFrame, not_null: list[str] = (), unique: list[str] = (), checks: dict[str, Column] = {}, foreign: dict[str, DataFrame] = {}) -> DataFrame:
    """constraint and number of rows that break it."""
    parts = [df.where(F.col(c).isNull()).agg(F.lit(f"not_null({c})").alias("constraint"), F.count("*").alias("n")) for c in not_null]
    parts += [df.groupBy(c).count().where(f"count > 1 AND {c} IS NOT NULL").agg(F.lit(f"unique({c})").alias("constraint"), F.coalesce(F.sum("count"), F.lit(0)).alias("n")) for c in unique]
    parts += [df.where(~c).agg(F.lit(f"check({n})").alias("constraint"), F.count("*").alias("n")) for n, c in checks.items()]
    parts += [df.where(F.col(c).isNotNull()).join(o.select(F.col(o.columns[0]).alias(c)).distinct(), c, "left_anti").agg(F.lit(f"foreign_key({c})").alias("constraint"), F.count("*").alias("n")) for c, o in foreign.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def replay(changes: DataFrame, keys: list[str], order: str = "lsn") -> DataFrame:
    """The table after a change log of (op c/u/d, keys, values, lsn): the last record of each key, unless it is a delete."""
    last = F.max_by(F.struct(*changes.columns), F.col(order)).alias("r")
    return changes.groupBy(*keys).agg(last).select("r.*").where("op <> 'd'").drop("op", order)


def _t(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = views(spark, sf_dir, "part")
    return v.sql("SELECT p_partkey AS id, p_size AS v, p_brand AS label FROM part WHERE p_partkey % 3 <> 0"), v.sql("SELECT p_partkey AS id, p_size + 1000 AS v, 'new' AS label FROM part WHERE p_partkey % 2 = 0")


_T = "t AS (SELECT p_partkey AS id, p_size AS v, p_brand AS label FROM part WHERE p_partkey % 3 <> 0), s AS (SELECT p_partkey AS id, p_size + 1000 AS v, 'new' AS label FROM part WHERE p_partkey % 2 = 0)"


@query("merge_into", f"WITH {_T} SELECT coalesce(t.id, s.id) AS id, CASE WHEN t.id IS NULL THEN s.v WHEN s.id IS NULL THEN t.v ELSE t.v + s.v END AS v, coalesce(t.label, s.label) AS label FROM t FULL JOIN s ON t.id = s.id WHERE s.id IS NOT NULL OR t.id IS NULL")
def merge_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MERGE: update matched, insert new, delete those not matched by source."""
    t, s = _t(spark, sf_dir)
    return merge(t, s, ["id"], {"v": F.col("t_v") + F.col("s_v")}, by_source="DELETE")


@query("merge_returning", f"WITH {_T} SELECT coalesce(t.id, s.id) AS id, CASE WHEN t.id IS NULL THEN 'INSERT' WHEN s.id IS NULL THEN 'KEEP' ELSE 'UPDATE' END AS merge_action FROM t FULL JOIN s ON t.id = s.id")
def merge_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = _t(spark, sf_dir)
    return merge(t, s, ["id"], {"v": F.col("s_v")}, action=True).select("id", "merge_action")


@query("on_conflict_update", f"WITH {_T} SELECT coalesce(t.id, s.id) AS id, coalesce(s.v, t.v) AS v, coalesce(t.label, s.label) AS label FROM t FULL JOIN s ON t.id = s.id")
def on_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = _t(spark, sf_dir)
    return upsert(t, s, ["id"], {"v": F.col("s_v")})


@query("on_conflict_nothing", f"WITH {_T} SELECT coalesce(t.id, s.id) AS id, coalesce(t.v, s.v) AS v, coalesce(t.label, s.label) AS label FROM t FULL JOIN s ON t.id = s.id")
def on_conflict_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = _t(spark, sf_dir)
    return upsert(t, s, ["id"], None)


@query("update_from", f"WITH {_T} SELECT t.id, coalesce(s.v, t.v) AS v, coalesce(s.label, t.label) AS label FROM t LEFT JOIN s ON t.id = s.id")
def update_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = _t(spark, sf_dir)
    return update_from(t, s, ["id"], {"v": F.col("s_v"), "label": F.col("s_label")})


@query("delete_using", f"WITH {_T} SELECT * FROM t WHERE id NOT IN (SELECT id FROM s)")
def delete_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = _t(spark, sf_dir)
    return delete_using(t, s, ["id"])


@query("insert_select", f"WITH {_T} SELECT * FROM t UNION ALL SELECT * FROM s")
def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s = _t(spark, sf_dir)
    return t.unionByName(s)


@query("dml_cte_returning", f"WITH {_T}, gone AS (SELECT * FROM t WHERE v > 25) SELECT label, count(*) AS n FROM gone GROUP BY label")
def dml_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WITH gone AS (DELETE ... RETURNING *) SELECT ... FROM gone."""
    t, _ = _t(spark, sf_dir)
    return t.where("v > 25").groupBy("label").agg(F.count("*").alias("n"))


@query("constraint_report", "SELECT 'not_null(o_custkey)' AS \"constraint\", count(*) FILTER (WHERE o_custkey IS NULL) AS n FROM orders UNION ALL SELECT 'unique(o_orderkey)', 0 UNION ALL SELECT 'check(positive)', count(*) FILTER (WHERE NOT o_totalprice > 1000) FROM orders UNION ALL SELECT 'foreign_key(o_custkey)', count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) FROM orders")
def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir, "orders", "customer")
    return violations(v.table("orders"), ["o_custkey"], ["o_orderkey"], {"positive": F.col("o_totalprice") > 1000}, {"o_custkey": v.table("customer").select("c_custkey")})


@query("generated_and_identity", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS id, p_size * 2 AS twice FROM part")
def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir, "part").sql("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_partkey) AS BIGINT) AS id, p_size * 2 AS twice FROM part")


@query("inheritance_scan", "SELECT c_custkey AS id, c_name AS name, 'customer' AS child FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir, "customer", "supplier")
    return v.sql("SELECT c_custkey AS id, c_name AS name, 'customer' AS child FROM customer").unionByName(v.sql("SELECT s_suppkey AS id, s_name AS name, 'supplier' AS child FROM supplier"))


@query("row_security_policy", "SELECT c_custkey FROM customer WHERE c_nationkey = 7")
def policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy as a filtered view; the tenant predicate reaches the scan."""
    v = views(spark, sf_dir, "customer")
    v.sql("SELECT * FROM customer WHERE c_nationkey = 7").createOrReplaceTempView("customer_of_tenant")
    return v.sql("SELECT c_custkey FROM customer_of_tenant")


@query("cdc_replay", "SELECT o_orderkey AS id, o_totalprice * (CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END) AS v FROM orders WHERE o_orderkey % 5 <> 0")
def cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts of all orders, updates of each fourth, deletes of each fifth, replayed by log position."""
    o = views(spark, sf_dir, "orders").sql("SELECT o_orderkey AS id, o_totalprice AS v FROM orders")
    log = o.select(F.lit("c").alias("op"), "id", "v", F.lit(1).alias("lsn")).union(o.where("id % 4 = 0").select(F.lit("u"), "id", F.col("v") * 2, F.lit(2))).union(o.where("id % 5 = 0").select(F.lit("d"), "id", F.lit(None), F.lit(3)))
    return replay(log, ["id"])


@query("sql_function", "SELECT p_partkey, p_size * 2 + 3 AS y FROM part")
def sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir, "part")
    v.sql("CREATE OR REPLACE TEMPORARY FUNCTION affine(x INT, a INT DEFAULT 2, b INT DEFAULT 3) RETURNS INT RETURN x * a + b")
    return v.sql("SELECT p_partkey, affine(p_size) AS y FROM part")


@query("sql_table_function", "SELECT p_partkey FROM part WHERE p_size > 40")
def sql_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir, "part")
    return v.sql("SELECT p_partkey FROM part WHERE p_size > :least", args={"least": 40})
