"""Registered log queries over streams derived from ``conversations`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans import logql
from millrace.plans.metric_queries import END, START, STEP
from millrace.registry import query, views


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views(spark, sf_dir, "conversations").table("conversations")
    return c.select(F.create_map(F.lit("role"), "role", F.lit("conv"), F.col("conv_id").cast("string")).alias("labels"), (F.col("turn") * 1_000_000_000).alias("ts"), F.col("text").alias("line"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """props as JSON lines; a logfmt and a plain line made of the same event."""
    e = views(spark, sf_dir, "events").table("events").select("*", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return e.select(F.create_map(F.lit("event_type"), "event_type").alias("labels"), (F.col("us") * 1000).alias("ts"), F.col("props").alias("line"), "event_id", "user_id")


def logfmt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_lines(spark, sf_dir)
    return e.withColumn("line", F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit(' msg="ev '), F.col("event_id").cast("string"), F.lit('" took='), (F.col("event_id") % 50).cast("string"), F.lit("ms size="), (F.col("event_id") % 9).cast("string"), F.lit("KB")))


def _lines(name: str, source, text: str, columns: dict, oracle: str) -> None:
    @query("logql_" + name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return logql.logs(source(spark, sf_dir), text).select(*[c().alias(n) for n, c in columns.items()])


_l = lambda k: lambda: F.coalesce(F.try_element_at("labels", F.lit(k)), F.lit(""))
_ts, _line = (lambda: F.col("ts")), (lambda: F.md5("line"))
_TALK = {"role": _l("role"), "conv": _l("conv"), "ts": _ts, "line": _line}
_T = "SELECT role, conv_id::VARCHAR AS conv, turn * 1000000000 AS ts, md5(text) AS line FROM conversations WHERE "
_lines("selector", talk, '{role="user", none!~"x"}', _TALK, _T + "role = 'user'")
_lines("selector_regex", talk, '{role=~"user|sys.*"}', _TALK, _T + "regexp_full_match(role, 'user|sys.*')")
_lines("line_filters", talk, '{role=~".+"} |= "th" != "zz" |~ "[aeiou]{2}" !~ "qq+"', _TALK, _T + "contains(text, 'th') AND NOT contains(text, 'zz') AND regexp_matches(text, '[aeiou]{2}') AND NOT regexp_matches(text, 'qq+')")
_E = {"event_type": _l("event_type"), "ts": _ts, "k": _l("k")}
_lines("json", event_lines, '{event_type="click"} | json | k > 50', _E, "SELECT event_type, epoch_us(ts) * 1000 AS ts, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'click' AND json_extract(props, '$.k')::DOUBLE > 50")
_lines("json_path", event_lines, '{event_type="view"} | json k="k" | k != ""', _E, "SELECT event_type, epoch_us(ts) * 1000 AS ts, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'view' AND json_extract(props, '$.k') IS NOT NULL")
_F = {"u": _l("user"), "m": _l("msg"), "ts": _ts}
_lines("logfmt", logfmt_lines, '{event_type="click"} | logfmt | took > 25ms and size <= 4KB', _F, "SELECT user_id::VARCHAR AS u, 'ev ' || event_id AS m, epoch_us(ts) * 1000 AS ts FROM events WHERE event_type = 'click' AND event_id % 50 > 25 AND event_id % 9 <= 4")
_lines("regexp", logfmt_lines, '{event_type="click"} | regexp "user=(?P<who>\\\\d+)" | who =~ "1.*"', {"who": _l("who"), "ts": _ts}, "SELECT user_id::VARCHAR AS who, epoch_us(ts) * 1000 AS ts FROM events WHERE event_type = 'click' AND user_id::VARCHAR LIKE '1%'")
_lines("pattern", logfmt_lines, '{event_type="click"} | pattern "user=<who> msg=<_> took=<t> size=<_>"', {"who": _l("who"), "ts": _ts}, "SELECT user_id::VARCHAR AS who, epoch_us(ts) * 1000 AS ts FROM events WHERE event_type = 'click'")
_lines("formats", logfmt_lines, '{event_type="click"} | logfmt | label_format who=user | line_format "{{.who}}:{{.event_type | upper}}" | keep who', {"who": _l("who"), "ts": _ts, "line": lambda: F.col("line"), "e": _l("event_type")}, "SELECT user_id::VARCHAR AS who, epoch_us(ts) * 1000 AS ts, user_id || ':CLICK' AS line, '' AS e FROM events WHERE event_type = 'click'")
_lines("drop_labels", talk, '{role="user"} | drop conv', {"role": _l("role"), "conv": _l("conv"), "ts": _ts}, "SELECT role, '' AS conv, turn * 1000000000 AS ts FROM conversations WHERE role = 'user'")


def _metric(name: str, source, text: str, labels: tuple[str, ...], oracle: str | None) -> None:
    @query("logql_" + name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = logql.metric(source(spark, sf_dir), text, START, END, STEP)
        return out.select("step", *[_l(x)().alias(x) for x in labels], F.round("value", 6).alias("value"))


_G = f"WITH s AS (SELECT *, epoch_us(ts) // 1000 AS ms, json_extract(props, '$.k')::DOUBLE AS k FROM events), g AS (SELECT unnest(generate_series({START}::BIGINT, {END}::BIGINT, {STEP}::BIGINT)) AS step) SELECT step, event_type, round({{}}, 6) AS value FROM g JOIN s ON ms > step - {{}} AND ms <= step - {{}} GROUP BY ALL"
_EV = ("event_type",)
_metric("count_over_time", event_lines, 'count_over_time({event_type=~".+"}[1d])', _EV, _G.format("count(*)::DOUBLE", 86_400_000, 0))
_metric("rate", event_lines, 'rate({event_type=~".+"}[6h])', _EV, _G.format("count(*) / 21600.0::DOUBLE", 21_600_000, 0))
_metric("bytes_over_time", event_lines, 'bytes_over_time({event_type=~".+"}[6h])', _EV, _G.format("sum(strlen(props))::DOUBLE", 21_600_000, 0))
_metric("offset", event_lines, 'count_over_time({event_type=~".+"}[6h] offset 6h)', _EV, _G.format("count(*)::DOUBLE", 43_200_000, 21_600_000))
_metric("unwrap", event_lines, 'sum by (event_type) (sum_over_time({event_type=~".+"} | json | unwrap k [1d]))', _EV, _G.format("sum(k)", 86_400_000, 0))
_metric("quantile", event_lines, 'quantile_over_time(0.5, {event_type=~".+"} | json | unwrap k [1d])', _EV, _G.format("quantile_cont(k, 0.5)", 86_400_000, 0))
_metric("vector_aggregation", event_lines, 'sum(count_over_time({event_type=~".+"}[1d]))', (), _G.format("count(*)::DOUBLE", 86_400_000, 0).replace("event_type, round", "round"))
_metric("binary", event_lines, 'count_over_time({event_type=~".+"}[1d]) / on (event_type) count_over_time({event_type=~".+"}[6h]) > 2', _EV, "SELECT step, event_type, round(d.value / h.value, 6) AS value FROM (" + _G.format("count(*)::DOUBLE", 86_400_000, 0) + ") d JOIN (" + _G.format("count(*)::DOUBLE", 21_600_000, 0) + ") h USING (step, event_type) WHERE d.value / h.value > 2")
_metric("duration_unwrap", logfmt_lines, 'max by (event_type) (max_over_time({event_type=~".+"} | logfmt | unwrap duration(took) [1d]))', _EV, _G.format("max(event_id % 50) * 0.001::DOUBLE", 86_400_000, 0))


_lines("keep_labels", talk, '{role="user"} | keep role', {"role": _l("role"), "conv": _l("conv"), "ts": _ts}, "SELECT role, '' AS conv, turn * 1000000000 AS ts FROM conversations WHERE role = 'user'")
_lines("ip_filter", logfmt_lines, '{event_type="click"} |= ip("10.0.0.0/8")', {"ts": _ts}, "SELECT epoch_us(ts) * 1000 AS ts FROM events WHERE false")
_metric("bytes_rate", event_lines, 'bytes_rate({event_type=~".+"}[6h])', _EV, _G.format("sum(strlen(props)) / 21600.0::DOUBLE", 21_600_000, 0))
_metric("topk", event_lines, 'topk(1, count_over_time({event_type=~".+"}[1d]))', _EV, "SELECT * FROM (" + _G.format("count(*)::DOUBLE", 86_400_000, 0) + ") QUALIFY row_number() OVER (PARTITION BY step ORDER BY value DESC, event_type) = 1")
_metric("label_replace", event_lines, 'label_replace(count_over_time({event_type=~".+"}[1d]), "kind", "k-$1", "event_type", "(.).*")', ("kind",), "SELECT step, kind, sum(value) AS value FROM (SELECT step, 'k-' || left(event_type, 1) AS kind, value, event_type FROM (" + _G.format("count(*)::DOUBLE", 86_400_000, 0) + ")) GROUP BY step, kind, event_type")
_metric("set_unless", event_lines, 'count_over_time({event_type=~".+"}[1d]) unless count_over_time({event_type="click"}[1d])', _EV, "SELECT * FROM (" + _G.format("count(*)::DOUBLE", 86_400_000, 0) + ") WHERE event_type <> 'click'")
for _f in ("min", "max", "avg"):
    _metric(f"{_f}_unwrapped", event_lines, f'{_f} by (event_type) ({_f}_over_time({{event_type=~".+"}} | json | unwrap k [1d]))', _EV, _G.format(f"{_f}(k)", 86_400_000, 0))
for _f, _g in (("first", "arg_min(k, ms)"), ("last", "arg_max(k, ms)")):
    _metric(f"{_f}_unwrapped", event_lines, f'{_f}_over_time({{event_type="click"}} | json | unwrap k [1d])', _EV, "SELECT * FROM (" + _G.format(_g, 86_400_000, 0) + ") WHERE event_type = 'click'")
