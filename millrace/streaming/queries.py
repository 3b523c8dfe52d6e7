"""Registered stream and table queries: batch twins with DuckDB forms, and the same graphs run as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.joins import as_of
from millrace.registry import query, views
from millrace.streaming import runtime, stateful, windows


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir, "events").sql("SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, unix_micros(CAST(ts AS TIMESTAMP)) AS us, user_id, event_type, value FROM events")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{sf_dir}/events.parquet"
    # A pattern: the stream source takes a folder or a pattern, and the table may be one file.
    df = spark.readStream.schema(spark.read.parquet(at).schema).parquet(f"{sf_dir}/[e]vents.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts"))


def _us(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.unix_micros("start")).withColumn("end", F.unix_micros("end"))


_sums = lambda: (F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
_W = "epoch_us(ts)"
_TUMBLE = f"SELECT user_id, ({_W} // 86400000000) * 86400000000 AS start, ({_W} // 86400000000 + 1) * 86400000000 AS \"end\", count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


@query("stream_stateless", "SELECT event_id, upper(event_type) AS kind, value * 2 AS v FROM events WHERE value > 10 AND event_type <> 'view'")
def stateless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """filter, filter_not, map_values."""
    return events(spark, sf_dir).where("value > 10").where("NOT event_type = 'view'").select("event_id", F.upper("event_type").alias("kind"), (F.col("value") * 2).alias("v"))


@query("stream_flat_map", "SELECT event_id, unnest([event_type, user_id::VARCHAR]) AS x FROM events")
def flat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.explode(F.array("event_type", F.col("user_id").cast("string"))).alias("x"))


@query("stream_branch_merge", "SELECT CASE WHEN event_type = 'click' THEN 'a' WHEN value > 50 THEN 'b' ELSE 'c' END AS branch, event_id FROM events")
def branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record goes to the first branch whose predicate holds; the branches are merged again."""
    e = events(spark, sf_dir)
    first, second = F.col("event_type") == "click", F.col("value") > 50
    return e.where(first).select(F.lit("a").alias("branch"), "event_id").unionByName(e.where(~first & second).select(F.lit("b").alias("branch"), "event_id")).unionByName(e.where(~first & ~second).select(F.lit("c").alias("branch"), "event_id"))


@query("stream_count_reduce", "SELECT user_id, count(*) AS n, max(value) AS hi FROM events GROUP BY user_id")
def count_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.keyed(events(spark, sf_dir), "user_id").groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("hi"))


@query("window_tumbling", _TUMBLE)
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _us(windows.tumbling(events(spark, sf_dir), "user_id", "ts", "1 day", *_sums()))


@query("window_hopping", f"SELECT user_id, s AS start, s + 86400000000 AS \"end\", count(*) AS n, round(sum(value), 4) AS total FROM (SELECT user_id, value, unnest([({_W} // 43200000000) * 43200000000, ({_W} // 43200000000 - 1) * 43200000000]) AS s FROM events) GROUP BY ALL")
def hopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _us(windows.hopping(events(spark, sf_dir), "user_id", "ts", "1 day", "12 hours", *_sums()))


@query("window_session", f"""SELECT user_id, min(us) AS start, max(us) AS "end", count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us) AS s FROM (SELECT user_id, value, {_W} AS us,
CASE WHEN {_W} - lag({_W}) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _us(windows.sessions(events(spark, sf_dir), "user_id", "ts", "6 hours", 21_600_000_000, *_sums()))


@query("window_sliding", f"""WITH e AS (SELECT user_id, {_W} // 1000 AS t, value FROM events), w AS (SELECT DISTINCT user_id, t - 3600000 AS start FROM e UNION SELECT user_id, t + 1 FROM e)
SELECT w.user_id, w.start, w.start + 3600000 AS "end", count(*) AS "count", round(sum(value), 4) AS total FROM w JOIN e ON e.user_id = w.user_id AND e.t BETWEEN w.start AND w.start + 3600000 GROUP BY ALL""")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("ms", F.floor(F.col("us") / 1000))
    return windows.sliding(e, "user_id", "ms", 3_600_000, "value").withColumn("total", F.round("total", 4))


@query("table_latest", "SELECT user_id, arg_max(event_type, ts) AS event_type, max(epoch_us(ts)) AS us FROM events GROUP BY user_id")
def table_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.latest(events(spark, sf_dir).select("user_id", "us", "event_type"), "user_id", "us").select("user_id", "event_type", "us")


@query("table_versions", "SELECT event_id, epoch_us(ts) AS valid_from, coalesce(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)), -1) AS valid_to FROM events")
def table_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.versions(events(spark, sf_dir), "user_id", "us").select("event_id", "valid_from", F.coalesce("valid_to", F.lit(-1)).alias("valid_to"))


@query("stream_table_join", "SELECT e.event_id, c.c_name FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id")
def stream_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views(spark, sf_dir, "customer").table("customer")
    return events(spark, sf_dir).join(c, F.col("user_id") == F.col("c_custkey"), "left").select("event_id", "c_name")


@query("stream_global_table_join", "SELECT e.event_id, n.n_name FROM events e JOIN nation n ON n.n_nationkey = e.user_id % 25")
def stream_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is derived from the record; the table is left to Spark's size check for broadcasting."""
    n = views(spark, sf_dir, "nation").table("nation")
    return events(spark, sf_dir).join(n, F.col("user_id") % 25 == F.col("n_nationkey")).select("event_id", "n_name")


@query("stream_versioned_join", """SELECT a.event_id, max_by(b.event_id, b.ts) AS seen FROM (SELECT * FROM events WHERE event_type = 'purchase') a JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND b.ts <= a.ts GROUP BY a.event_id""")
def versioned_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's view record that was valid at its time."""
    e = events(spark, sf_dir)
    a = e.where("event_type = 'purchase'").select("user_id", "us", "event_id")
    b = e.where("event_type = 'view'").select("user_id", "us", F.col("event_id").alias("seen"))
    return as_of(a, b, ["user_id"], "us", "us", ["seen"], "inner").select("event_id", "seen")


@query("table_table_join", "SELECT coalesce(a.k, b.k) AS k, a.n, b.s FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT user_id AS k, count(*) AS s FROM events GROUP BY 1) b ON a.k = b.k")
def table_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir, "orders", "events")
    a = v.table("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    b = v.table("events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("s"))
    return a.join(b, "k", "full")


@query("foreign_key_join", "SELECT s.s_suppkey, n.n_name FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey")
def foreign_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir, "supplier", "nation")
    return v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")


@query("gateway_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("user_id", "event_type").dropDuplicates()


@query("columnar_topology", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE value > 5 GROUP BY event_type")
def columnar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, with-columns and a grouping inside each micro-batch (the file is one batch)."""
    out = event_stream(spark, sf_dir).where("value > 5").select("event_type", "value")
    rows = runtime.drain(out, batch=lambda b, n: b.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")))
    return rows.select("event_type", "n", "total")


@query("streamed_tumbling_update", _TUMBLE)
def streamed_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emit on update, run as a stream to its end: the last update of each window is the batch result."""
    out = windows.tumbling(event_stream(spark, sf_dir).withWatermark("ts", "1 hour"), "user_id", "ts", "1 day", F.count("*").alias("n"), F.sum("value").alias("value"))
    rows = runtime.drain(out, "update", batch=lambda b, n: b)
    last = rows.groupBy("user_id", "start", "end").agg(F.max_by(F.struct("n", "value"), "batch").alias("r")).select("user_id", "start", "end", "r.n", F.round("r.value", 4).alias("total"))
    return _us(last)


@query("streamed_processor", "SELECT user_id::VARCHAR AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def streamed_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stateful.running(event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("k"), "value"), "k", "value")
    rows = runtime.drain(out, "update", batch=lambda b, n: b)
    return rows.groupBy("k").agg(F.max_by(F.struct("n", "total"), "batch").alias("r")).select("k", "r.n", F.round("r.total", 4).alias("total"))


@query("streamed_suppress", """
WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS k, epoch_us(ts) // 1000 AS ms, value FROM events), n AS (SELECT a.k, a.ms, min(b.ms) AS due FROM (SELECT DISTINCT k, ms FROM e) a JOIN e b ON b.k = a.k AND b.ms >= a.ms + 86400000 GROUP BY ALL),
f AS (SELECT k, ms, lead(ms) OVER (PARTITION BY k ORDER BY ms) AS following FROM (SELECT DISTINCT k, ms FROM e)),
r AS (SELECT k, min(ms) AS since FROM e GROUP BY k UNION ALL SELECT r.k, f.following FROM r JOIN n ON n.k = r.k AND n.ms = r.since JOIN f ON f.k = n.k AND f.ms = n.due WHERE f.following IS NOT NULL)
SELECT e.k, e.ms, e.value FROM r JOIN n ON n.k = r.k AND n.ms = r.since JOIN e ON e.k = n.k AND e.ms = n.due""")
def streamed_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one update a day and key."""
    src = event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("k"), F.floor(F.col("us") / 1000).alias("ms"), "value")
    return runtime.drain(stateful.suppress_until(src, "k", "ms", "value", 86_400_000))


@query("stream_select_key", "SELECT o_orderkey % 7 AS k, count(*) AS n FROM orders GROUP BY 1")
def select_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """map / select_key marks a new key; the exchange comes with the grouping."""
    o = views(spark, sf_dir, "orders").table("orders")
    return o.select((F.col("o_orderkey") % 7).alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("stream_repartition", "SELECT count(*) AS n, count(DISTINCT user_id) AS keys FROM events")
def repartition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repartition(n): a key's records share a partition."""
    e = events(spark, sf_dir).repartition(6, "user_id").withColumn("p", F.spark_partition_id())
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("p").alias("p")).agg(F.sum("n").alias("n"), F.count_if(F.col("p") == 1).alias("keys"))


@query("stream_peek", "SELECT event_id FROM events WHERE value > 20")
def peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """peek sees the records on their way: counted by an observation, none changed."""
    return events(spark, sf_dir).observe("seen", F.count("*").alias("n")).where("value > 20").select("event_id")


@query("cogroup_tumbling", f"SELECT k, ({_W} // 86400000000) * 86400000000 AS start, sum(a)::BIGINT AS clicks, round(sum(b), 4) AS bought FROM (SELECT user_id AS k, ts, (event_type = 'click')::INTEGER AS a, CASE WHEN event_type = 'purchase' THEN value ELSE 0 END AS b FROM events WHERE event_type IN ('click', 'purchase')) GROUP BY ALL")
def cogroup_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams with an aggregator each into one windowed result."""
    e = events(spark, sf_dir)
    tagged = e.where("event_type = 'click'").select("user_id", "ts", F.lit(1).alias("a"), F.lit(0.0).alias("b")).unionByName(e.where("event_type = 'purchase'").select("user_id", "ts", F.lit(0).alias("a"), F.col("value").alias("b")))
    out = windows.tumbling(tagged.withColumnRenamed("user_id", "k"), "k", "ts", "1 day", F.sum("a").alias("clicks"), F.round(F.sum("b"), 4).alias("bought"))
    return out.select("k", F.unix_micros("start").alias("start"), "clicks", "bought")


@query("cogroup_session", f"""SELECT user_id, min(us) AS start, max(us) AS "end", sum(a)::BIGINT AS clicks, sum(b)::BIGINT AS views FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us) AS s FROM (SELECT user_id, (event_type = 'click')::INTEGER AS a, (event_type = 'view')::INTEGER AS b, {_W} AS us,
CASE WHEN {_W} - lag({_W}) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM events WHERE event_type IN ('click', 'view'))) GROUP BY user_id, s""")
def cogroup_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type IN ('click', 'view')")
    return _us(windows.sessions(e, "user_id", "ts", "6 hours", 21_600_000_000, F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "view").alias("views")))


@query("cogroup_sliding", f"""WITH e AS (SELECT user_id, {_W} // 1000 AS t, (CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'view' THEN 1000 END)::DOUBLE AS value FROM events WHERE event_type IN ('click', 'view')), w AS (SELECT DISTINCT user_id, t - 3600000 AS start FROM e UNION SELECT user_id, t + 1 FROM e)
SELECT w.user_id, w.start, round(sum(value), 4) AS total FROM w JOIN e ON e.user_id = w.user_id AND e.t BETWEEN w.start AND w.start + 3600000 GROUP BY ALL""")
def cogroup_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("event_type IN ('click', 'view')").withColumn("ms", F.floor(F.col("us") / 1000)).withColumn("w", F.when(F.col("event_type") == "click", 1.0).otherwise(1000.0))
    return windows.sliding(e, "user_id", "ms", 3_600_000, "w").select("user_id", "start", F.round("total", 4).alias("total"))


@query("grouped_table_count", "SELECT event_type AS k, count(*) AS n FROM (SELECT user_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id) GROUP BY 1")
def grouped_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table grouped by a value: each change takes the old value out and puts the new one in."""
    from pyspark.sql import Window as W

    e = events(spark, sf_dir).select("user_id", "us", "event_type")
    e = e.withColumn("old", F.lag("event_type").over(W.partitionBy("user_id").orderBy("us")))
    signed = e.select(F.col("event_type").alias("k"), F.lit(1).alias("d")).unionByName(e.where("old IS NOT NULL").select(F.col("old").alias("k"), F.lit(-1).alias("d")))
    return signed.groupBy("k").agg(F.sum("d").alias("n")).where("n > 0")


@query("table_to_stream_changes", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS old, event_type AS new FROM events")
def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """to_stream of a table: (old, new) of each update."""
    from pyspark.sql import Window as W

    e = events(spark, sf_dir)
    return e.select("event_id", F.lag("event_type").over(W.partitionBy("user_id").orderBy("us")).alias("old"), F.col("event_type").alias("new"))


@query("interactive_key_query", "SELECT arg_max(event_type, ts) AS event_type FROM events WHERE user_id = 3")
def key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point query of a store: its key's predicate reaches the scan."""
    e = events(spark, sf_dir).where("user_id = 3")
    return windows.latest(e.select("user_id", "us", "event_type"), "user_id", "us").select("event_type")


@query("interactive_range_query", "SELECT user_id, count(*) AS n FROM events WHERE user_id BETWEEN 2 AND 5 GROUP BY user_id")
def range_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_reduce(spark, sf_dir).where("user_id BETWEEN 2 AND 5").select("user_id", "n")


@query("interactive_window_query", _TUMBLE.replace("FROM events", "FROM events WHERE user_id = 2 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'"))
def window_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a key that start in a range of time."""
    out = windows.tumbling(events(spark, sf_dir).where("user_id = 2"), "user_id", "ts", "1 day", *_sums())
    return _us(out.where("start >= TIMESTAMP '2024-01-05' AND start < TIMESTAMP '2024-01-08'"))


@query("interactive_versioned_query", "SELECT event_id, event_type FROM events WHERE user_id = 2 AND ts <= TIMESTAMP '2024-01-10' ORDER BY ts DESC LIMIT 1")
def versioned_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of a key that was valid at a time."""
    v = windows.versions(events(spark, sf_dir).where("user_id = 2"), "user_id", "us")
    at = F.unix_micros(F.lit("2024-01-10 00:00:00").cast("timestamp"))
    return v.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))).select("event_id", "event_type")


@query("streamed_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def streamed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly once by id, as a stream."""
    src = event_stream(spark, sf_dir).withWatermark("ts", "60 days").select("user_id", "event_type", "ts")
    return runtime.drain(src.dropDuplicatesWithinWatermark(["user_id", "event_type"])).select("user_id", "event_type")


@query("streamed_interval_join", """SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view'
AND epoch_us(b.ts) BETWEEN epoch_us(a.ts) - 3600000000 AND epoch_us(a.ts) + 7200000000""")
def streamed_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream-stream join with an asymmetric window; watermarks bound its state."""
    side = lambda kind, n: event_stream(spark, sf_dir).where(F.col("event_type") == kind).select(F.col("event_id").alias(n), F.col("user_id").alias("u" + n), F.col("ts").alias("t" + n)).withWatermark("t" + n, "1 hour")
    a, b = side("click", "a"), side("view", "b")
    return runtime.drain(a.join(b, F.expr("ua = ub AND tb BETWEEN ta - INTERVAL 1 HOUR AND ta + INTERVAL 2 HOURS")).select("a", "b"))


@query("streamed_punctuation", """WITH e AS (SELECT user_id::VARCHAR AS k, epoch_us(ts) // 1000 AS ms, value FROM events), b AS (SELECT *, ms // 86400000 AS d, lag(ms // 86400000) OVER (PARTITION BY k ORDER BY ms, value) AS p, sum(value) OVER (PARTITION BY k ORDER BY ms, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS total FROM e)
SELECT k, d * 86400000 AS ms, round(total, 4) AS total FROM b WHERE p IS NOT NULL AND d > p""")
def streamed_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("k"), F.floor(F.col("us") / 1000).alias("ms"), "value")
    return runtime.drain(stateful.punctuated(src, "k", "ms", "value", 86_400_000)).withColumn("total", F.round("total", 4))


@query("streamed_window_close", """SELECT * FROM (SELECT user_id, (epoch_us(ts) // 86400000000) * 86400000000 AS start, (epoch_us(ts) // 86400000000 + 1) * 86400000000 AS "end", count(*) AS n FROM events GROUP BY ALL)
WHERE "end" <= (SELECT max(epoch_us(ts)) FROM events) - 3600000000""")
def streamed_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emit on close (suppress until the window closes): one row for each closed window; those still open at the stream's end have none."""
    out = windows.tumbling(event_stream(spark, sf_dir).withWatermark("ts", "1 hour"), "user_id", "ts", "1 day", F.count("*").alias("n"))
    return _us(runtime.drain(out))


@query("streamed_grace_join", """
WITH c AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type = 'click'), p AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type = 'purchase'),
l AS (SELECT user_id, max(ms) - 3600000 AS low FROM c GROUP BY ALL)
SELECT c.user_id::VARCHAR AS k, c.ms, c.event_id::VARCHAR AS v, (SELECT arg_max(p.event_id::VARCHAR, (p.ms, p.event_id::VARCHAR)) FROM p WHERE p.user_id = c.user_id AND p.ms <= c.ms) AS found FROM c JOIN l USING (user_id) WHERE c.ms <= l.low""")
def streamed_grace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks wait an hour of their user's stream time for the version of a table of purchases."""
    src = event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("k"), F.floor(F.col("us") / 1000).alias("ms"), F.col("event_id").cast("string").alias("v"), "event_type")
    clicks, purchases = (src.where(F.col("event_type") == t).select("k", "ms", "v") for t in ("click", "purchase"))
    return runtime.drain(stateful.stream_grace_join(clicks, purchases, "k", "ms", "v", 3_600_000))


@query("record_cache", "SELECT user_id, epoch_us(ts) // 3600000000 AS commit, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS updates FROM events GROUP BY ALL")
def record_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of a key between two commits are one: the last of each hour is forwarded."""
    e = events(spark, sf_dir)
    return e.groupBy("user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("commit")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("updates"))


@query("streamed_foreach", "SELECT user_id, event_id, round(value * 2, 4) AS doubled FROM events WHERE event_type = 'click'")
def streamed_foreach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """foreach: a terminal that hands each record to a function; here it writes what it was given."""
    src = event_stream(spark, sf_dir).where("event_type = 'click'").select("user_id", "event_id", "value")
    return runtime.for_each(src, lambda r: (r["user_id"], r["event_id"], round(r["value"] * 2, 4)), "user_id long, event_id long, doubled double")
