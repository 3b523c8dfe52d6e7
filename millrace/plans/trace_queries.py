"""Registered trace queries over spans derived from ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans import traceql
from millrace.registry import query, views


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace for each conversation: turn t is a child of turn t // 2; duration is the text's length in ms."""
    c = views(spark, sf_dir, "conversations").table("conversations").groupBy("conv_id", "turn").agg(F.min_by("role", "text").alias("role"), F.max(F.length("text")).alias("n"))
    df = c.select(F.col("conv_id").cast("string").alias("trace_id"), F.col("turn").cast("string").alias("span_id"), F.when(F.col("turn") > 0, F.floor(F.col("turn") / 2).cast("string")).alias("parent_id"), F.concat(F.lit("turn-"), (F.col("turn") % 3).cast("string")).alias("name"),
        F.col("role").alias("service"), F.when(F.col("turn") % 2 == 0, "server").otherwise("client").alias("kind"), F.when(F.col("n") % 5 == 0, "error").otherwise("ok").alias("status"), (F.col("turn") * 1_000_000_000).alias("start"), (F.col("n") * 1_000_000).cast("long").alias("duration"),
        F.create_map(F.lit("n"), F.col("n").cast("string"), F.lit("turn"), F.col("turn").cast("string")).alias("attrs"), F.create_map(F.lit("env"), F.lit("prod")).alias("resource"))
    return traceql.enriched(traceql.nested_sets(df))


_S = """WITH RECURSIVE c AS (SELECT conv_id, turn, arg_min(role, text) AS role, max(length(text)) AS n FROM conversations GROUP BY ALL), s AS (SELECT conv_id::VARCHAR AS trace_id, turn::VARCHAR AS span_id, turn, CASE WHEN turn > 0 THEN (turn // 2)::VARCHAR END AS parent_id, 'turn-' || (turn % 3) AS name, role AS service,
CASE WHEN turn % 2 = 0 THEN 'server' ELSE 'client' END AS kind, CASE WHEN n % 5 = 0 THEN 'error' ELSE 'ok' END AS status, n, n * 1000000 AS duration, turn * 1000000000 AS start FROM c),
up AS (SELECT trace_id, span_id, parent_id AS anc FROM s WHERE parent_id IS NOT NULL AND parent_id <> span_id UNION ALL SELECT up.trace_id, up.span_id, s.parent_id FROM up JOIN s ON s.trace_id = up.trace_id AND s.span_id = up.anc WHERE s.parent_id IS NOT NULL AND s.parent_id <> s.span_id) """
_X = "SELECT s.trace_id, s.span_id FROM s WHERE "


def _search(name: str, text: str, oracle: str) -> None:
    @query("traceql_" + name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return traceql.Traces(spans(spark, sf_dir)).search(text).select("trace_id", "span_id")


_A = "EXISTS (SELECT 1 FROM s a {} WHERE a.trace_id = s.trace_id AND a.status = 'error' AND {})"
_UP = "EXISTS (SELECT 1 FROM up JOIN s a ON a.trace_id = up.trace_id AND a.span_id = up.anc WHERE up.trace_id = s.trace_id AND up.span_id = s.span_id AND a.status = 'error')"
_DOWN = "EXISTS (SELECT 1 FROM up JOIN s a ON a.trace_id = up.trace_id AND a.span_id = up.span_id WHERE up.trace_id = s.trace_id AND up.anc = s.span_id AND a.status = 'error')"
_N = "s.name = 'turn-1'"
_search("select", '{ status = error && span.n > 60 }', _S + _X + "status = 'error' AND n > 60")
_search("regex_or_not", '{ name =~ "turn-[01]" && !(kind = client || duration > 100ms) }', _S + _X + "name IN ('turn-0', 'turn-1') AND NOT (kind = 'client' OR duration > 100000000)")
_search("scopes", '{ resource.env = "prod" && resource.service.name = "user" && .turn != nil && .none = nil }', _S + _X + "service = 'user'")
_search("and_spansets", '{ status = error } && { name = "turn-2" }', _S + _X + "(status = 'error' OR name = 'turn-2') AND EXISTS (SELECT 1 FROM s a WHERE a.trace_id = s.trace_id AND a.status = 'error') AND EXISTS (SELECT 1 FROM s a WHERE a.trace_id = s.trace_id AND a.name = 'turn-2')")
_search("or_spansets", '{ status = error } || { name = "turn-2" }', _S + _X + "status = 'error' OR name = 'turn-2'")
_search("child", '{ status = error } > { name = "turn-1" }', _S + _X + f"{_N} AND s.parent_id IS NOT NULL AND " + _A.format("", "a.span_id = s.parent_id"))
_search("parent", '{ status = error } < { name = "turn-1" }', _S + _X + f"{_N} AND " + _A.format("", "a.parent_id = s.span_id"))
_search("sibling", '{ status = error } ~ { name = "turn-1" }', _S + _X + f"{_N} AND " + _A.format("", "a.parent_id = s.parent_id AND a.span_id <> s.span_id"))
_search("descendant", '{ status = error } >> { name = "turn-1" }', _S + _X + f"{_N} AND {_UP}")
_search("ancestor", '{ status = error } << { name = "turn-1" }', _S + _X + f"{_N} AND {_DOWN}")
_search("not_descendant", '{ status = error } !>> { name = "turn-1" }', _S + _X + f"{_N} AND NOT {_UP}")
_search("not_child", '{ status = error } !> { name = "turn-1" }', _S + _X + f"{_N} AND NOT " + _A.format("", "a.span_id = s.parent_id"))
_search("union_child", '{ status = error } &> { name = "turn-1" }', _S + _X + f"({_N} AND " + _A.format("", "a.span_id = s.parent_id") + ") OR (s.status = 'error' AND EXISTS (SELECT 1 FROM s a WHERE a.trace_id = s.trace_id AND a.name = 'turn-1' AND a.parent_id = s.span_id))")
_search("not_parent", '{ status = error } !< { name = "turn-1" }', _S + _X + f"{_N} AND NOT " + _A.format("", "a.parent_id = s.span_id"))
_search("not_ancestor", '{ status = error } !<< { name = "turn-1" }', _S + _X + f"{_N} AND NOT {_DOWN}")
_search("not_sibling", '{ status = error } !~ { name = "turn-1" }', _S + _X + f"{_N} AND NOT " + _A.format("", "a.parent_id = s.parent_id AND a.span_id <> s.span_id"))
_BACK = "(s.status = 'error' AND EXISTS (SELECT 1 FROM s a {} WHERE a.trace_id = s.trace_id AND a.name = 'turn-1' AND {}))"
_UP1 = "(s.status = 'error' AND EXISTS (SELECT 1 FROM up JOIN s a ON a.trace_id = up.trace_id AND a.span_id = up.anc WHERE up.trace_id = s.trace_id AND up.span_id = s.span_id AND a.name = 'turn-1'))"
_DOWN1 = "(s.status = 'error' AND EXISTS (SELECT 1 FROM up JOIN s a ON a.trace_id = up.trace_id AND a.span_id = up.span_id WHERE up.trace_id = s.trace_id AND up.anc = s.span_id AND a.name = 'turn-1'))"
_search("union_descendant", '{ status = error } &>> { name = "turn-1" }', _S + _X + f"({_N} AND {_UP}) OR {_DOWN1}")
_search("union_ancestor", '{ status = error } &<< { name = "turn-1" }', _S + _X + f"({_N} AND {_DOWN}) OR {_UP1}")
_search("union_parent", '{ status = error } &< { name = "turn-1" }', _S + _X + f"({_N} AND " + _A.format("", "a.parent_id = s.span_id") + ") OR " + _BACK.format("", "a.span_id = s.parent_id"))
_search("union_sibling", '{ status = error } &~ { name = "turn-1" }', _S + _X + f"({_N} AND " + _A.format("", "a.parent_id = s.parent_id AND a.span_id <> s.span_id") + ") OR " + _BACK.format("", "a.parent_id = s.parent_id AND a.span_id <> s.span_id"))
_search("parent_scope", '{ parent.turn = 1 && parent.name != nil }', _S + _X + "EXISTS (SELECT 1 FROM s a WHERE a.trace_id = s.trace_id AND a.span_id = s.parent_id AND a.turn = 1)")
_search("root_fields", '{ rootServiceName = "user" && nestedSetParent != -1 }', _S + ", r AS (SELECT trace_id, arg_min(service, turn) AS root FROM s WHERE parent_id IS NULL OR parent_id = span_id GROUP BY trace_id) SELECT s.trace_id, s.span_id FROM s JOIN r USING (trace_id) WHERE r.root = 'user' AND s.parent_id IS NOT NULL AND s.parent_id <> s.span_id")
_search("by_coalesce", '{ } | by(kind) | coalesce() | count() > 2', _S + _X + "(SELECT count(*) FROM s a WHERE a.trace_id = s.trace_id) > 2")
_search("pipeline_filter", '{ status = error } | { name = "turn-1" } | max(duration) > 60ms', _S + _X + "status = 'error' AND name = 'turn-1' AND (SELECT max(duration) FROM s a WHERE a.trace_id = s.trace_id AND a.status = 'error' AND a.name = 'turn-1') > 60000000")
_search("count_filter", '{ status = error } | count() > 1', _S + _X + "status = 'error' AND (SELECT count(*) FROM s a WHERE a.trace_id = s.trace_id AND a.status = 'error') > 1")
_search("avg_filter", '{ } | avg(duration) > 80ms', _S + _X + "(SELECT avg(duration) FROM s a WHERE a.trace_id = s.trace_id) > 80000000")
_search("by_filter", '{ } | by(kind) | count() > 2', _S + _X + "(SELECT count(*) FROM s a WHERE a.trace_id = s.trace_id AND a.kind = s.kind) > 2")
_search("child_count", '{ childCount > 1 }', _S + _X + "(SELECT count(*) FROM s a WHERE a.trace_id = s.trace_id AND a.parent_id = s.span_id) > 1")
_search("trace_by_id", '{ trace:id = "3" }', _S + _X + "trace_id = '3'")


@query("traceql_select_fields", _S + "SELECT trace_id, span_id, name, n::VARCHAR AS n FROM s WHERE status = 'error'")
def select_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traceql.Traces(spans(spark, sf_dir)).search("{ status = error } | select(name, span.n)")


def _metric(name: str, text: str, columns: str, oracle: str | None) -> None:
    @query("traceql_" + name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = traceql.Traces(spans(spark, sf_dir)).metrics(text, 2_000_000_000)
        return out.withColumn("value", F.round("value", 6)).select(*columns.split())


_M = _S + "SELECT (start // 2000000000) * 2000000000 AS step, {} AS \"group\", round({}, 6) AS value FROM s WHERE {} GROUP BY ALL"
_metric("rate", "{ status = error } | rate() by (name)", "step group value", _M.format("name", "count(*) / 2.0::DOUBLE", "status = 'error'"))
_metric("count_over_time", "{ } | count_over_time()", "step group value", _M.format("''", "count(*)::DOUBLE", "true"))
for _f in ("sum", "avg", "min", "max"):
    _metric(f"{_f}_over_time", f"{{ }} | {_f}_over_time(duration) by (kind)", "step group value", _M.format("kind", f"{_f}(duration)::DOUBLE", "true"))
_metric("topk", "{ } | count_over_time() by (name) | topk(1)", "step group value", "SELECT step, \"group\", value FROM (" + _M.format("name", "count(*)::DOUBLE", "true") + ") QUALIFY row_number() OVER (PARTITION BY step ORDER BY value DESC, \"group\") = 1")
_metric("bottomk", "{ } | count_over_time() by (name) | bottomk(1)", "step group value", "SELECT step, \"group\", value FROM (" + _M.format("name", "count(*)::DOUBLE", "true") + ") QUALIFY row_number() OVER (PARTITION BY step ORDER BY value, \"group\") = 1")
_Q = [f"SELECT *, '{q}' AS p FROM ({_M.format(chr(39) * 2, f'quantile_cont(duration::DOUBLE, {q})', 'true')})" for q in ("0.5", "0.9")]
_metric("quantile_over_time", "{ } | quantile_over_time(duration, 0.5, 0.9)", "step group p value", " UNION ALL ".join(_Q))
_metric("histogram_over_time", "{ } | histogram_over_time(duration)", "step group bucket value", _M.format("''", "count(*)::DOUBLE", "true").replace(' AS "group",', ' AS "group", pow(2.0::DOUBLE, ceil(log2(greatest(duration, 1)))) AS bucket,'))


@query("traceql_compare", _S + ", f AS (SELECT status = 'error' AS e, unnest(['name', 'service', 'status', 'n', 'turn']) AS attribute, unnest([name, service, status, n::VARCHAR, turn::VARCHAR]) AS v FROM s) SELECT attribute, v, count(*) FILTER (WHERE e) AS selected, count(*) FILTER (WHERE NOT e) AS baseline FROM f GROUP BY attribute, v QUALIFY row_number() OVER (PARTITION BY attribute ORDER BY selected DESC, baseline DESC, v) <= 5")
def compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traceql.Traces(spans(spark, sf_dir)).compare("{ status = error }", 5)


@query("span_metrics", _S + "SELECT service, name, kind, status, count(*) AS calls, sum(duration)::BIGINT AS total_ns, count(*) FILTER (WHERE duration <= 50000000) AS le_50000000, count(*) FILTER (WHERE duration <= 100000000) AS le_100000000 FROM s GROUP BY ALL")
def red_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traceql.span_metrics(spans(spark, sf_dir), [50_000_000, 100_000_000])


@query("service_graph", _S + "SELECT coalesce(a.service, '') AS client, b.service AS server, count(*) AS calls FROM s b LEFT JOIN s a ON a.trace_id = b.trace_id AND a.span_id = b.parent_id WHERE b.parent_id IS NOT NULL AND coalesce(a.service, '') <> b.service GROUP BY ALL")
def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traceql.service_graph(spans(spark, sf_dir))


@query("trace_tag_values", _S + "SELECT DISTINCT 'n' AS tag, n::VARCHAR AS v FROM s UNION SELECT DISTINCT 'turn', turn::VARCHAR FROM s")
def tag_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).select(F.explode("attrs").alias("tag", "v")).distinct()


@query("trace_tag_names", "SELECT 'resource' AS scope, 'env' AS tag UNION ALL SELECT 'span', 'n' UNION ALL SELECT 'span', 'turn'")
def tag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spans(spark, sf_dir)
    own = lambda scope, c: s.select(F.lit(scope).alias("scope"), F.explode(F.map_keys(c)).alias("tag"))
    return own("span", "attrs").union(own("resource", "resource")).distinct()


@query("trace_search_recent", _S + "SELECT trace_id, min(start) AS start, count(*) AS matched FROM s WHERE status = 'error' GROUP BY trace_id ORDER BY start DESC, trace_id LIMIT 5")
def search_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search response with the most_recent hint: the newest traces and their matched spans; the limit is the feature."""
    out = traceql.Traces(spans(spark, sf_dir)).search("{ status = error }").groupBy("trace_id").agg(F.min("start").alias("start"), F.count("*").alias("matched"))
    return out.orderBy(F.col("start").desc(), "trace_id").limit(5)


@query("trace_events_and_links", "SELECT conv_id::VARCHAR AS trace_id, turn::VARCHAR AS span_id FROM conversations WHERE turn % 3 = 1")
def events_and_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event and link scopes: a span matches if one of its events (links) does."""
    c = views(spark, sf_dir, "conversations").table("conversations")
    event = F.struct(F.concat(F.lit("e"), (F.col("turn") % 3).cast("string")).alias("name"), F.create_map(F.lit("k"), F.lit("v")).alias("attrs"))
    df = c.select(F.col("conv_id").cast("string").alias("trace_id"), F.col("turn").cast("string").alias("span_id"), F.array(event).alias("events"), F.array(F.struct(F.lit("t").alias("trace_id"), F.create_map(F.lit("k"), F.lit("w")).alias("attrs"))).alias("links"))
    return traceql.Traces(df).search('{ event:name = "e1" && event.k = "v" && link.k != "z" }').select("trace_id", "span_id")


@query("nested_sets", _S + "SELECT s.trace_id, s.span_id, (SELECT count(*) FROM up WHERE up.trace_id = s.trace_id AND up.anc = s.span_id) AS below FROM s")
def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants of each span from its nested set alone."""
    return spans(spark, sf_dir).select("trace_id", "span_id", F.floor((F.col("rgt") - F.col("lft")) / 2).alias("below"))


@query("service_graph_unpaired", _S + "SELECT b.trace_id, b.span_id FROM s b WHERE b.kind = 'client' AND NOT EXISTS (SELECT 1 FROM s a WHERE a.trace_id = b.trace_id AND a.parent_id = b.span_id AND a.kind = 'server')")
def unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client spans whose server span never came: the edges that expire."""
    s = spans(spark, sf_dir)
    servers = s.where("kind = 'server'").select("trace_id", F.col("parent_id").alias("span_id"))
    return s.where("kind = 'client'").join(servers, ["trace_id", "span_id"], "left_anti").select("trace_id", "span_id")


@query("trace_shard_merge", _S + "SELECT service, count(*) AS calls FROM s GROUP BY service")
def shard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of shards with the same labels are summed."""
    s = spans(spark, sf_dir).select("service", F.pmod(F.xxhash64("trace_id"), F.lit(4)).alias("shard"))
    return s.groupBy("shard", "service").agg(F.count("*").alias("calls")).groupBy("service").agg(F.sum("calls").alias("calls"))


@query("traceql_more_intrinsics", _S + _X + "n % 3 = 1 AND turn % 2 = 0 AND n * 1000 > 50000 AND turn % 5 <> 4")
def more_intrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status message, instrumentation scope, time of events since the span's start, spans that links name."""
    df = spans(spark, sf_dir)
    n, turn = F.try_element_at("attrs", F.lit("n")).cast("long"), F.try_element_at("attrs", F.lit("turn")).cast("long")
    event = F.struct(F.lit("tick").alias("name"), (F.col("start") + n * 1000).alias("time"), F.create_map(F.lit("k"), F.lit("v")).alias("attrs"))
    link = F.struct(F.col("trace_id"), F.concat(F.lit("s"), (turn % 5).cast("string")).alias("span_id"), F.create_map(F.lit("k"), F.lit("v")).alias("attrs"))
    df = df.withColumns({"status_message": F.concat(F.lit("m"), (n % 3).cast("string")), "scope": F.lit("lib"), "scope_version": F.concat(F.lit("1."), (turn % 2).cast("string")), "events": F.array(event), "links": F.array(link)})
    text = '{ statusMessage = "m1" && instrumentation:name = "lib" && instrumentation:version = "1.0" && event:timeSinceStart > 50us && !(link:spanID = "s4") && event:name = "tick" && trace:id != nil }'
    return traceql.Traces(df).search(text).select("trace_id", "span_id")
