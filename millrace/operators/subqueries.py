"""Subqueries, CTEs, recursion and table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.registry import query, sql, views
from millrace.storage import checkpoints

sql("scalar_subquery", "SELECT n_name, (SELECT max(s_acctbal) FROM supplier) AS hi, (SELECT r_name FROM region WHERE r_regionkey > 99) AS none FROM nation", "same")
sql("correlated_subquery", "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c", "same")
sql("derived_table", "SELECT k, n FROM (SELECT p_brand AS k, count(*) AS n FROM part GROUP BY p_brand) t WHERE n > 3", "same")
sql("cte_chain", "WITH a AS (SELECT p_partkey AS k, p_size AS s FROM part), b(k, t) AS (SELECT k, s * 2 FROM a WHERE s > 5), c AS (WITH d AS (SELECT k FROM b) SELECT k FROM d) SELECT b.k, b.t FROM b JOIN c ON b.k = c.k", "same")
sql("cte_materialized", "WITH a AS MATERIALIZED (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey), b AS NOT MATERIALIZED (SELECT * FROM a) SELECT a.k, b.n FROM a JOIN b ON a.k = b.k", "same")
sql("generate_series_table", "SELECT g.n, h.n AS m FROM generate_series(1, 5) AS g, generate_series(10, 1, -4) AS h", "SELECT g.n, h.m FROM generate_series(1, 5) AS g(n), generate_series(10, 1, -4) AS h(m)")
sql("generate_series_empty", "SELECT count(*) AS c FROM generate_series(5, 1)", "same")
sql("lateral_table_function", "SELECT p.p_partkey, s.part FROM part p, LATERAL string_to_table(p.p_type, ' ') AS s", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS part FROM part")
sql("json_keys_table", "SELECT e.event_id, k.k FROM events e, LATERAL jsonb_object_keys(e.props) AS k", "SELECT event_id, unnest(json_keys(props)) AS k FROM events")
sql("rows_from", "SELECT pos + 1 AS ord, z.a, z.b FROM (SELECT sequence(1, 3) AS a, split('x,y', ',') AS b) LATERAL VIEW posexplode(arrays_zip(a, b)) AS pos, z", "SELECT unnest([1, 2, 3]) AS ord, unnest([1, 2, 3]) AS a, unnest(['x', 'y']) AS b")
sql("srf_in_select", "SELECT n_nationkey, explode(sequence(1, n_regionkey + 1)) AS i FROM nation", "SELECT n_nationkey, unnest(generate_series(1, n_regionkey + 1))::INTEGER AS i FROM nation")
sql("generate_subscripts", "SELECT p_partkey, explode(sequence(1, size(split(p_type, ' ')))) AS i FROM part", "SELECT p_partkey, generate_subscripts(string_split(p_type, ' '), 1)::INTEGER AS i FROM part")
sql("recursive_search_depth_first", "WITH RECURSIVE t(id, path) AS (SELECT 0, CAST(array(0) AS ARRAY<INT>) UNION ALL SELECT e.dst, concat(t.path, array(e.dst)) FROM t JOIN (SELECT n_nationkey AS dst, CAST(floor((n_nationkey - 1) / 2) AS INT) AS src FROM nation WHERE n_nationkey > 0) e ON e.src = t.id) SELECT id, CAST(row_number() OVER (ORDER BY path) AS BIGINT) AS ord FROM t",
    "WITH RECURSIVE t(id, path) AS (SELECT 0, [0] UNION ALL SELECT e.dst, list_append(t.path, e.dst) FROM t JOIN (SELECT n_nationkey AS dst, floor((n_nationkey - 1) / 2)::INTEGER AS src FROM nation WHERE n_nationkey > 0) e ON e.src = t.id) SELECT id, row_number() OVER (ORDER BY path) AS ord FROM t")
sql("recursive_cycle_mark", "WITH RECURSIVE t(id, path, is_cycle) AS (SELECT 1, array(1), false UNION ALL SELECT (t.id * 7) % 20, concat(t.path, array((t.id * 7) % 20)), array_contains(t.path, (t.id * 7) % 20) FROM t WHERE NOT t.is_cycle) SELECT id, is_cycle FROM t",
    "WITH RECURSIVE t(id, path, is_cycle) AS (SELECT 1, [1], false UNION ALL SELECT (t.id * 7) % 20, list_append(t.path, (t.id * 7) % 20), list_contains(t.path, (t.id * 7) % 20) FROM t WHERE NOT t.is_cycle) SELECT id, is_cycle FROM t")
sql("json_table", "SELECT j.id, v.pos + 1 AS ord, variant_get(v.value, '$.x', 'int') AS x, variant_get(v.value, '$.y', 'string') AS y FROM (SELECT 1 AS id, '[{\"x\": 5, \"y\": \"a\"}, {\"x\": 6}]' AS doc) j, LATERAL variant_explode(parse_json(j.doc)) v", "SELECT 1 AS id, 1 AS ord, 5 AS x, 'a' AS y UNION ALL SELECT 1, 2, 6, NULL")
sql("recursive_union_all", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 30) SELECT n FROM t", "same")
sql("recursive_tree", "WITH RECURSIVE t(id, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.depth + 1 FROM nation n JOIN t ON (n.n_nationkey - 1) / 2 >= t.id AND (n.n_nationkey - 1) / 2 < t.id + 1 WHERE n.n_nationkey > 0) SELECT id, depth FROM t", "same")
sql("generate_series", "SELECT explode(sequence(3, 20, 4)) AS n", "SELECT unnest(generate_series(3, 20, 4))::INTEGER AS n")
sql("generate_series_timestamp", "SELECT CAST(t AS STRING) AS t FROM (SELECT explode(sequence(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03', INTERVAL 12 HOURS)) AS t)", "SELECT strftime(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03', INTERVAL 12 HOURS)), '%Y-%m-%d %H:%M:%S') AS t")
sql("unnest", "SELECT p_partkey, w FROM part LATERAL VIEW explode(split(p_type, ' ')) AS w", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part")
sql("unnest_parallel", "SELECT inline(arrays_zip(a, b)) FROM (SELECT array(1, 2, 3) AS a, array('x', 'y') AS b)", "SELECT unnest([1, 2, 3]) AS a, unnest(['x', 'y']) AS b")
sql("with_ordinality", "SELECT p_partkey, pos + 1 AS ord, w FROM part LATERAL VIEW posexplode(split(p_type, ' ')) AS pos, w", "SELECT p_partkey, generate_subscripts(string_split(p_type, ' '), 1)::INTEGER AS ord, unnest(string_split(p_type, ' ')) AS w FROM part")
sql("string_to_table", "SELECT explode(split('a,b,,c', ',')) AS s", "SELECT unnest(string_split('a,b,,c', ',')) AS s")
sql("regexp_split_to_table", "SELECT n_nationkey, explode(split(n_name, '[AEIOU]+')) AS s FROM nation", "SELECT n_nationkey, unnest(regexp_split_to_array(n_name, '[AEIOU]+')) AS s FROM nation")
sql("json_each", "SELECT e.event_id, v.key AS k, CAST(v.value AS STRING) AS x FROM events e, LATERAL variant_explode(parse_json(e.props)) v", "SELECT event_id, unnest(json_keys(props)) AS k, json_extract_string(props, '$.k') AS x FROM events")
sql("json_array_elements", "SELECT v.pos AS pos, CAST(v.value AS INT) AS x FROM variant_explode(parse_json('[5, 6, 7]')) v", "SELECT unnest([0, 1, 2])::INTEGER AS pos, unnest([5, 6, 7]) AS x")


def recursive_union(seed: DataFrame, step, limit: int = 100) -> DataFrame:
    """WITH RECURSIVE ... UNION: ``step(new rows)`` until no row is new; rows are distinct, cycles end.

    A round joins only the rows that are new, and cuts its lineage in the
    checkpoint folder, so plans stay small and lost executors do not repeat rounds.
    """
    checkpoints(seed.sparkSession)
    found = new = seed.distinct().checkpoint()
    for _ in range(limit):
        new = step(new).distinct().join(found, seed.columns, "left_anti").checkpoint()
        if new.isEmpty():
            return found
        found = found.union(new).checkpoint()
    raise RuntimeError(f"no fixed point in {limit} rounds")


@query("recursive_union_cycle", "WITH RECURSIVE t(id) AS (SELECT 1::BIGINT UNION SELECT (id * 7) % 200 FROM t) SELECT id FROM t")
def recursive_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything reachable from part 1 over the cyclic edges k -> 7k mod 200."""
    edges = views(spark, sf_dir, "part").sql("SELECT DISTINCT p_partkey % 200 AS src, (p_partkey % 200) * 7 % 200 AS dst FROM part")
    seed = spark.range(1, 2)
    return recursive_union(seed, lambda new: new.join(edges, new["id"] == edges["src"]).select(F.col("dst").alias("id")))
