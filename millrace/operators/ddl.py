"""DDL and session commands in Spark's terms: tables made of queries, views, sequences, schema changes, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.dialect import run_sql
from millrace.registry import query, sql, views
from millrace.storage import scratch


def numbered(df: DataFrame, name: str, start: int = 1, step: int = 1) -> DataFrame:
    """nextval() of a sequence for each row: gapless values, dealt without gathering the rows.

    Rows of each partition are counted first; a partition's values begin after
    those of the partitions before it. What comes to the driver is a count for
    each partition. The rows are written once, so both passes see the same ones.
    """
    at = scratch(df.sparkSession, "sequence")
    df.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()).write.parquet(at)
    kept = df.sparkSession.read.parquet(at)
    counts = sorted((r["_part"], r["n"], r["low"]) for r in kept.groupBy("_part").agg(F.count("*").alias("n"), F.min("_row").alias("low")).collect())
    base, total = {}, 0
    for part, n, low in counts:
        base[part] = total - low
        total += n
    if not base:
        return df.withColumn(name, F.lit(None).cast("long"))
    offset = F.create_map(*[F.lit(x) for kv in base.items() for x in kv])[F.col("_part")]
    return kept.withColumn(name, (F.col("_row") + offset) * step + start).drop("_part", "_row")


def alter(df: DataFrame, add: dict[str, Column] = {}, rename: dict[str, str] = {}, drop: list[str] = (), retype: dict[str, str] = {}) -> DataFrame:
    """ALTER TABLE: added columns (their default), renamed, dropped and retyped ones."""
    out = df.drop(*drop).withColumns({c: F.col(c).cast(t) for c, t in retype.items()}).withColumnsRenamed(rename)
    return out.withColumns(dict(add)) if add else out


def like(df: DataFrame) -> DataFrame:
    """CREATE TABLE ... LIKE: the columns without rows."""
    return df.sparkSession.createDataFrame([], df.schema)


def partition_of(df: DataFrame, bounds: list[tuple[str, Column]]) -> DataFrame:
    """The partition that each row of a partitioned table is routed to; rows that none takes raise."""
    name = F.raise_error(F.lit("no partition of relation found for row"))
    for n, test in reversed(bounds):
        name = F.when(test, F.lit(n)).otherwise(name)
    return df.withColumn("partition", name)


def statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """ANALYZE: column, rows, nulls, distinct values, least and greatest as text; one pass."""
    facts = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(c).alias("different"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest")) for c in columns]
    return df.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


sql("show_version_kind", "SELECT length(version()) > 0 AS v, current_database() AS d, typeof(1L) AS t", "SELECT true AS v, 'default' AS d, 'bigint' AS t")


@query("create_table_as", "SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey")
def create_table_as(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = views(spark, sf_dir, "nation").sql("SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey")
    at = scratch(spark, "table")
    out.write.parquet(at)
    return spark.read.schema(out.schema).parquet(at)


@query("create_view", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0")
def create_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir, "customer")
    v.sql("CREATE OR REPLACE TEMPORARY VIEW rich(c_custkey, c_name) AS SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0")
    return v.sql("SELECT * FROM rich")


@query("sequence_nextval", "SELECT count(*) AS n, 100::BIGINT AS lo, (100 + 5 * (count(*) - 1))::BIGINT AS hi, count(*) AS different FROM orders")
def nextval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence from 100 by 5 over all orders: as many different values as rows, without a gap."""
    out = numbered(views(spark, sf_dir, "orders").table("orders").select("o_orderkey"), "id", 100, 5)
    return out.agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count_distinct("id").alias("different"))


@query("alter_table", "SELECT p_partkey::VARCHAR AS id, p_size AS size, 'none' AS note FROM part")
def alter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views(spark, sf_dir, "part").table("part").select("p_partkey", "p_size", "p_name")
    return alter(p, {"note": F.lit("none")}, {"p_partkey": "id", "p_size": "size"}, ["p_name"], {"p_partkey": "string"})


@query("create_table_like", "SELECT count(*) AS n FROM part WHERE false")
def table_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return like(views(spark, sf_dir, "part").table("part")).agg(F.count("*").alias("n"))


@query("partition_routing", "SELECT CASE WHEN o_totalprice < 1000 THEN 'low' WHEN o_totalprice < 3000 THEN 'mid' ELSE 'rest' END AS partition, count(*) AS n FROM orders GROUP BY 1")
def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views(spark, sf_dir, "orders").table("orders")
    return partition_of(o, [("low", F.col("o_totalprice") < 1000), ("mid", F.col("o_totalprice") < 3000), ("rest", F.lit(True))]).groupBy("partition").agg(F.count("*").alias("n"))


@query("analyze_statistics", "SELECT 'o_custkey' AS \"column\", count(*) AS rows, 0::BIGINT AS nulls, count(DISTINCT o_custkey) AS different, min(o_custkey)::VARCHAR AS least, max(o_custkey)::VARCHAR AS greatest FROM orders UNION ALL SELECT 'o_orderstatus', count(*), 0, count(DISTINCT o_orderstatus), min(o_orderstatus), max(o_orderstatus) FROM orders")
def analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics(views(spark, sf_dir, "orders").table("orders"), ["o_custkey", "o_orderstatus"])


@query("explain_plan")
def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPLAIN of a statement, a row for each line; plans have no twin."""
    df = run_sql(views(spark, sf_dir, "orders"), "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 10 GROUP BY o_orderstatus")
    text = df._jdf.queryExecution().simpleString()
    return spark.createDataFrame([(k, x) for k, x in enumerate(text.split("\n"))], "line int, plan string")


@query("schema_import", "SELECT 'nation' AS \"table\", unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS \"column\" UNION ALL SELECT 'region', unnest(['r_regionkey', 'r_name'])")
def schema_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMPORT FOREIGN SCHEMA ... LIMIT TO: the columns of the imported tables."""
    v = views(spark, sf_dir, "nation", "region")
    return spark.createDataFrame([(t, c) for t in ("nation", "region") for c in v.table(t).columns], "table string, column string")


@query("tenant_isolation", "SELECT 'click' AS tenant, count(*) AS n FROM events WHERE event_type = 'click'")
def tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scan carries its tenant's predicate; it reaches the files."""
    e = views(spark, sf_dir, "events").table("events").where(F.col("event_type") == "click")
    return e.groupBy(F.col("event_type").alias("tenant")).agg(F.count("*").alias("n"))
