"""Profile queries: flame graphs, diffs, series and heat maps of stack samples.

Samples have labels (columns), ts, stack (array of frames, root first) and value.
A stack is exploded into its prefixes once and summed with partial aggregation, so
a tree never has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.registry import query, views


def tree(samples: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """path (frames joined by ;), depth, total, self; beyond ``max_nodes`` by total, nodes fold into their parent's ``other``."""
    n = F.size("stack")
    depth = F.explode(F.sequence(F.lit(1), n)).alias("depth")
    p = samples.where(n > 0).select("stack", "value", depth)
    own = F.when(F.col("depth") == F.size("stack"), F.col("value")).otherwise(0)
    out = p.groupBy(F.array_join(F.slice("stack", 1, F.col("depth")), ";").alias("path"), "depth").agg(F.sum("value").alias("total"), F.sum(own).alias("self"))
    if max_nodes is None:
        return out
    kept = out.orderBy(F.col("total").desc(), "path").limit(max_nodes)
    gone = out.join(kept.select("path"), "path", "left_anti")
    parent = F.regexp_replace("path", "(^|;)[^;]*$", "")
    gone = gone.withColumn("parent", parent).join(kept.select(F.col("path").alias("parent")), "parent", "left_semi").unionByName(gone.where("depth = 1").withColumn("parent", F.lit("")))
    other = gone.groupBy(F.concat_ws(";", F.nullif("parent", F.lit("")), F.lit("other")).alias("path"), "depth").agg(F.sum("total").alias("total"))
    return kept.unionByName(other.withColumn("self", F.col("total")))


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both trees' totals by path."""
    a, b = tree(left).select("path", F.col("total").alias("left_total")), tree(right).select("path", F.col("total").alias("right_total"))
    return a.join(b, "path", "full").select("path", F.coalesce("left_total", F.lit(0)).alias("left_total"), F.coalesce("right_total", F.lit(0)).alias("right_total"))


def heatmap(samples: DataFrame, start: int, end: int, columns: int, rows: int, low: float, high: float) -> DataFrame:
    """Counts by time and value bins; ends are exclusive and values at the top go to the last bin."""
    df = samples.where((F.col("ts") >= start) & (F.col("ts") < end))
    x = F.floor((F.col("ts") - start) * columns / (end - start))
    y = F.least(F.lit(rows - 1), F.greatest(F.lit(0), F.floor((F.col("value") - low) * rows / (high - low))))
    return df.groupBy(x.cast("long").alias("x"), y.cast("long").alias("y")).agg(F.count("*").alias("n"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir, "part").sql("SELECT split(p_type, ' ') AS stack, CAST(p_size AS BIGINT) AS value, p_brand AS brand, p_partkey AS ts FROM part")


_P = "p AS (SELECT string_split(p_type, ' ') AS st, p_size::BIGINT AS v, p_brand AS brand, p_partkey AS ts FROM part), e AS (SELECT st, v, brand, unnest(range(1, len(st) + 1)) AS d FROM p), t AS (SELECT array_to_string(st[1:d], ';') AS path, d::INTEGER AS depth, sum(v)::BIGINT AS total, sum(CASE WHEN d = len(st) THEN v ELSE 0 END)::BIGINT AS self FROM e GROUP BY ALL)"


@query("flame_graph", f"WITH {_P} SELECT path, depth, total, self FROM t")
def flame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(parts(spark, sf_dir))


@query("flame_graph_truncated", f"""WITH {_P}, k AS (SELECT * FROM t ORDER BY total DESC, path LIMIT 20), o AS (SELECT regexp_replace(path, '(^|;)[^;]*$', '') AS parent, depth, total FROM t WHERE path NOT IN (SELECT path FROM k))
SELECT path, depth, total, self FROM k UNION ALL SELECT CASE WHEN parent = '' THEN 'other' ELSE parent || ';other' END, depth, sum(total)::BIGINT, sum(total)::BIGINT FROM o WHERE parent = '' OR parent IN (SELECT path FROM k) GROUP BY parent, depth""")
def flame_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree(parts(spark, sf_dir), 20)


@query("profile_diff", """WITH p AS (SELECT string_split(p_type, ' ') AS st, p_size::BIGINT AS v, p_partkey % 2 AS side FROM part), e AS (SELECT st, v, side, unnest(range(1, len(st) + 1)) AS d FROM p)
SELECT array_to_string(st[1:d], ';') AS path, coalesce(sum(v) FILTER (WHERE side = 0), 0)::BIGINT AS left_total, coalesce(sum(v) FILTER (WHERE side = 1), 0)::BIGINT AS right_total FROM e GROUP BY ALL""")
def profile_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    return diff(p.where("ts % 2 = 0"), p.where("ts % 2 = 1"))


@query("profile_series", "SELECT p_brand AS brand, (p_partkey // 100) * 100 AS step, sum(p_size)::BIGINT AS total, round(avg(p_size), 6) AS mean FROM part GROUP BY ALL")
def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).groupBy("brand", (F.floor(F.col("ts") / 100) * 100).alias("step")).agg(F.sum("value").alias("total"), F.round(F.avg("value"), 6).alias("mean"))


@query("profile_heatmap", "WITH r AS (SELECT min(p_partkey) AS a, max(p_partkey) + 1 AS z FROM part) SELECT floor((p_partkey - a)::DOUBLE * 10 / (z - a))::BIGINT AS x, least(4, floor(p_size * 5 / 50.0))::BIGINT AS y, count(*) AS n FROM part, r GROUP BY ALL")
def heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples, from the oldest to the newest."""
    p = parts(spark, sf_dir)
    return heatmap(p, *whole_range(p), 10, 5, 0, 50)


@query("profile_label_values", "SELECT DISTINCT p_brand AS brand FROM part")
def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("brand").distinct()


def profile_type(text: str) -> dict[str, str]:
    """name:sample type:sample unit:period type:period unit, with ``:delta`` at the end if the profile is one."""
    fields = text.split(":")
    delta = len(fields) == 6 and fields[5] == "delta"
    if len(fields) != 5 + delta or not all(fields[:2]):
        raise ValueError(f"not a profile type: {text!r}")
    return dict(zip(("name", "sample_type", "sample_unit", "period_type", "period_unit"), fields)) | {"delta": str(delta).lower()}


def select(samples: DataFrame, selector: str, start: int, end: int) -> DataFrame:
    """Samples in [start, end) whose ``labels`` match a selector such as ``{a="b", c=~"d.*"}``."""
    from millrace.plans import promql_parser
    from millrace.plans.promql import matches

    matchers = promql_parser.parse(selector).matchers
    return samples.where(matches(F.col("labels"), matchers)).where((F.col("ts") >= start) & (F.col("ts") < end))


def stats(samples: DataFrame) -> DataFrame:
    """Whether there is data, and the first and last time of it."""
    return samples.agg((F.count("*") > 0).alias("data"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def whole_range(samples: DataFrame) -> tuple[int, int]:
    """The times [start, end) that hold all samples; an empty one if there are none."""
    known = stats(samples).first()
    return (known.oldest, known.newest + 1) if known.data else (0, 1)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).withColumn("labels", F.create_map(F.lit("brand"), "brand", F.lit("kind"), F.get("stack", F.lit(0))))


@query("profile_select", "SELECT p_partkey AS ts, p_size::BIGINT AS value FROM part WHERE p_brand LIKE 'Brand#1%' AND string_split(p_type, ' ')[1] <> 'SMALL'")
def profile_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = labelled(spark, sf_dir)
    return select(p, '{brand=~"Brand#1.*", kind!="SMALL", none=""}', *whole_range(p)).select("ts", "value")


@query("profile_stats", "SELECT count(*) > 0 AS data, min(p_partkey) AS oldest, max(p_partkey) AS newest FROM part")
def profile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(parts(spark, sf_dir))


@query("profile_types", "SELECT 'process_cpu' AS name, 'cpu' AS sample_type, 'nanoseconds' AS sample_unit, 'true' AS delta UNION ALL SELECT 'memory', 'alloc_space', 'bytes', 'false'")
def profile_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [profile_type(x) for x in ("process_cpu:cpu:nanoseconds:cpu:nanoseconds:delta", "memory:alloc_space:bytes:space:bytes")]
    return spark.createDataFrame([(x["name"], x["sample_type"], x["sample_unit"], x["delta"]) for x in found], "name string, sample_type string, sample_unit string, delta string")


@query("profile_label_series", "SELECT p_brand AS brand, string_split(p_type, ' ')[1] AS kind, count(*) AS n FROM part GROUP BY ALL")
def label_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label sets that have samples."""
    return labelled(spark, sf_dir).groupBy(F.col("labels")["brand"].alias("brand"), F.col("labels")["kind"].alias("kind")).agg(F.count("*").alias("n"))


@query("profile_hot_cold_union", "SELECT string_split(p_type, ' ')[1] AS path, sum(p_size)::BIGINT AS total FROM part GROUP BY ALL")
def profile_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree over cold blocks and the hot head, whose rows overlap."""
    from millrace.sources.connectors import hot_and_cold

    p = parts(spark, sf_dir)
    return tree(hot_and_cold(p.where("ts % 3 < 2"), p.where("ts % 3 > 0"), ["ts"])).where("depth = 1").select("path", "total")
