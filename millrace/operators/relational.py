"""Scans, projections, predicates, ordering and set operations as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.registry import query, sql, views

sql("revenue_by_nation", """
SELECT n.n_name AS nation, count(DISTINCT o.o_orderkey) AS orders, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN nation n ON n.n_nationkey = c.c_nationkey
WHERE o.o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' GROUP BY n.n_name ORDER BY revenue DESC, nation""", "same")
sql("tpch_q1", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""", "same")
sql("tpch_q3", """
SELECT l.l_orderkey AS orderkey, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, o.o_orderpriority AS priority
FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE c.c_mktsegment = 'BUILDING' GROUP BY l.l_orderkey, o.o_orderpriority ORDER BY revenue DESC, orderkey LIMIT 10""", "same")
sql("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24", "same")
sql("table_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer", "same")
sql("values_scan", "SELECT * FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS v(id, name) ORDER BY id", "same")
sql("projection_star", "SELECT n.*, n.n_nationkey * 2 AS twice FROM nation n", "same")
sql("where_three_valued", "SELECT p_partkey FROM part WHERE NOT (CASE WHEN p_size > 25 THEN NULL ELSE p_size > 10 END)", "same")
sql("row_comparison", "SELECT n_nationkey FROM nation WHERE n_regionkey > 1 OR (n_regionkey = 1 AND n_nationkey > 10)", "SELECT n_nationkey FROM nation WHERE (n_regionkey, n_nationkey) > (1, 10)")
sql("null_tests", "SELECT x, x IS NULL AS a, x IS NOT NULL AS b, (x > 1) IS TRUE AS c, (x > 1) IS NOT FALSE AS d, (x > 1) IS NULL AS e FROM (VALUES (1), (2), (NULL)) AS v(x)", "same")
sql("is_distinct_from", "SELECT a, b, a IS DISTINCT FROM b AS d, a IS NOT DISTINCT FROM b AS s FROM (VALUES (1, 1), (1, 2), (NULL, 1), (NULL, NULL)) AS v(a, b)", "same")
sql("in_list", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3, NULL)", "same")
sql("not_in_null", "SELECT count(*) AS n FROM nation WHERE n_regionkey NOT IN (1, NULL)", "same")
sql("between_symmetric", "SELECT p_partkey FROM part WHERE p_size BETWEEN least(20, 10) AND greatest(20, 10)", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
sql("like_ilike", "SELECT p_partkey, p_name LIKE '%a%' AS l, p_name ILIKE '%A%' AS i, p_name NOT LIKE 'x!_%' ESCAPE '!' AS n FROM part", "same")
sql("similar_to", "SELECT p_partkey FROM part WHERE p_type SIMILAR TO '%(STEEL|BRASS|TIN)%' OR p_brand SIMILAR TO 'Brand#[13]_'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_type, '.*(STEEL|BRASS|TIN).*') OR regexp_full_match(p_brand, 'Brand#[13].')")
sql("regex_operators", "SELECT p_partkey FROM part WHERE p_brand ~ '#1[0-9]' AND p_type ~* 'steel|tin|a' AND p_name !~ '^zz'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#1[0-9]') AND regexp_matches(p_type, '(?i)steel|tin|a') AND NOT regexp_matches(p_name, '^zz')")
sql("case_forms", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS a, CASE p_size % 3 WHEN 0 THEN 'fizz' WHEN 1 THEN 'one' END AS b FROM part", "same")
sql("casts", "SELECT CAST(CAST(p_retailprice AS DECIMAL(12,1)) * 10 AS DOUBLE) AS d, CAST(p_size AS STRING) AS s, try_cast(p_name AS INT) AS t, p_size::double AS f FROM part", "SELECT CAST(CAST(p_retailprice AS DECIMAL(12,1)) * 10 AS DOUBLE) AS d, CAST(p_size AS VARCHAR) AS s, try_cast(p_name AS INT) AS t, p_size::double AS f FROM part")
sql("arithmetic", "SELECT p_partkey, p_size + 1 AS a, p_size % 7 AS m, power(p_size, 2) AS p, p_size & 12 AS b, p_size | 3 AS o, p_size # 5 AS x, shiftleft(p_size, 2) AS s, |/ p_size AS r, @ (10 - p_size) AS v, (p_size + 1) ^ 2 AS q FROM part", "SELECT p_partkey, p_size + 1 AS a, p_size % 7 AS m, power(p_size, 2) AS p, p_size & 12 AS b, p_size | 3 AS o, xor(p_size, 5) AS x, p_size << 2 AS s, sqrt(p_size) AS r, abs(10 - p_size) AS v, power(p_size + 1, 2) AS q FROM part")
sql("string_concat", "SELECT n_nationkey, n_name || '-' || CAST(n_regionkey AS STRING) AS s, n_name || NULL AS z FROM nation", "SELECT n_nationkey, n_name || '-' || CAST(n_regionkey AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS z FROM nation")
sql("any_array", "SELECT n_nationkey FROM nation WHERE n_regionkey = ANY (array(0, 2)) AND n_nationkey <> ALL (array(1, 5))", "SELECT n_nationkey FROM nation WHERE n_regionkey IN (0, 2) AND n_nationkey NOT IN (1, 5)")
sql("array_predicates", "SELECT p_partkey, arrays_overlap(split(p_type, ' '), array('STEEL', 'SMALL')) AS o, size(array_except(array('STEEL'), split(p_type, ' '))) = 0 AS c, element_at(split(p_type, ' '), 1) AS f, array_join(slice(split(p_type, ' '), 1, 2), '+') AS s FROM part",
    "SELECT p_partkey, list_has_any(string_split(p_type, ' '), ['STEEL', 'SMALL']) AS o, list_contains(string_split(p_type, ' '), 'STEEL') AS c, string_split(p_type, ' ')[1] AS f, array_to_string(string_split(p_type, ' ')[1:2], '+') AS s FROM part")
sql("json_access", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, variant_get(parse_json(props), '$.k', 'string') AS t, variant_get(parse_json(props), '$.none', 'string') IS NULL AS z FROM events",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS t, json_extract(props, '$.none') IS NULL AS z FROM events")
sql("is_json", "SELECT x, try_parse_json(x) IS NOT NULL AS ok, coalesce(schema_of_variant(try_parse_json(x)) LIKE 'OBJECT%', false) AS o FROM (VALUES ('{\"a\": 1}'), ('[1]'), ('no'), ('3')) AS v(x)",
    "SELECT x, json_valid(x) AS ok, CASE WHEN json_valid(x) THEN json_type(x) = 'OBJECT' ELSE false END AS o FROM (VALUES ('{\"a\": 1}'), ('[1]'), ('no'), ('3')) AS v(x)")
sql("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", "same")
sql("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey", "same")
sql("order_by_nulls", "SELECT k, x FROM (SELECT p_partkey AS k, nullif(p_size % 5, 0) AS x FROM part) ORDER BY x, k", "same")
sql("order_by_desc_nulls", "SELECT k, x FROM (SELECT p_partkey AS k, nullif(p_size % 5, 0) AS x FROM part) ORDER BY x DESC, k", "SELECT k, x FROM (SELECT p_partkey AS k, nullif(p_size % 5, 0) AS x FROM part) ORDER BY x DESC NULLS FIRST, k")
sql("order_by_ordinal_alias", "SELECT n_name AS a, n_regionkey AS b FROM nation ORDER BY 2 DESC, a LIMIT 7", "same")
sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 + 5 OFFSET 3", "same")
sql("limit_subquery", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT (SELECT count(*) FROM region)", "same")
sql("fetch_first", "SELECT p_partkey FROM part ORDER BY p_partkey FETCH FIRST 4 ROWS ONLY", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 4")
sql("fetch_with_ties", "SELECT p_partkey, p_size FROM part ORDER BY p_size FETCH FIRST 3 ROWS WITH TIES", "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size) AS r FROM part) WHERE r <= 3")
sql("topk_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2", "same")
_A, _B = "SELECT n_regionkey % 3 AS k FROM nation", "SELECT p_size % 4 + 1 AS k FROM part WHERE p_partkey < 40"
for _op in ("UNION", "UNION ALL", "INTERSECT", "INTERSECT ALL", "EXCEPT", "EXCEPT ALL"):
    sql("set_" + _op.lower().replace(" ", "_"), f"({_A}) {_op} ({_B})", "same")
sql("set_nulls", "(SELECT 1 AS a UNION ALL SELECT NULL) INTERSECT (SELECT NULL UNION ALL SELECT 2)", "same")
sql("set_precedence", "SELECT 1 AS a UNION ALL SELECT 2 INTERSECT SELECT 2 UNION ALL SELECT 1", "same")
sql("set_order_limit", f"({_A}) UNION ({_B}) ORDER BY k DESC LIMIT 2", "same")
sql("set_type_unification", "SELECT CAST(1 AS DOUBLE) AS a UNION ALL SELECT CAST(n_nationkey AS DOUBLE) FROM nation WHERE n_nationkey < 3", "same")


@query("whole_row_reference", "SELECT r_regionkey, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS whole FROM region")
def whole_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views(spark, sf_dir, "region").table("region")
    return r.select("r_regionkey", F.to_json(F.struct("*")).alias("whole"))


@query("table_sample")
def table_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BERNOULLI with a seed: the sample is the feature, so it has no twin."""
    return views(spark, sf_dir, "orders").sql("SELECT o_orderkey FROM orders TABLESAMPLE (10 PERCENT) REPEATABLE (7)")


@query("prepared_statement", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'O'")
def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir, "orders").sql("SELECT o_orderkey FROM orders WHERE o_totalprice > :least AND o_orderstatus = :status", args={"least": 1000, "status": "O"})


@query("cursor_fetch", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE rn BETWEEN 11 AND 15")
def cursor_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOVE 10, FETCH 5 of a cursor over the orders."""
    return views(spark, sf_dir, "orders").table("orders").select("o_orderkey").orderBy("o_orderkey").offset(10).limit(5)
