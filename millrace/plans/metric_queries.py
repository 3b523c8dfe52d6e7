"""Registered metric queries over samples derived from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.promql import Engine
from millrace.registry import query, views

#: 2024-01-01 to 2024-02-01 in steps of six hours: with a day of lookback every row of ``events`` takes part.
START, END, STEP = 1_704_067_200_000, 1_706_745_600_000, 21_600_000


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One gauge, a counter and classic buckets per (event_type, user_id)."""
    e = views(spark, sf_dir, "events").sql("SELECT unix_millis(CAST(ts AS TIMESTAMP)) AS ts, event_type, CAST(user_id % 7 AS STRING) AS u, value FROM events")
    return e.select(F.create_map(F.lit("__name__"), F.lit("v"), F.lit("event_type"), "event_type", F.lit("u"), "u").alias("labels"), "ts", F.col("value").cast("double").alias("value"))


def bucket_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative daily counts of values at or below each bound, as a classic histogram."""
    bounds = ["10.0", "25.0", "50.0", "100.0", "200.0", "+Inf"]
    e = views(spark, sf_dir, "events").sql("SELECT unix_millis(CAST(date_trunc('day', ts) AS TIMESTAMP)) AS ts, event_type, value FROM events")
    e = e.withColumn("le", F.explode(F.array(*map(F.lit, bounds))))
    e = e.groupBy("ts", "event_type", "le").agg(F.count_if((F.col("le") == "+Inf") | (F.col("value") <= F.col("le").try_cast("double"))).cast("double").alias("value"))
    return e.select(F.create_map(F.lit("__name__"), F.lit("h_bucket"), F.lit("event_type"), "event_type", F.lit("le"), "le").alias("labels"), "ts", "value")


def metric(name: str, text: str, labels: tuple[str, ...], oracle: str | None = None, source=samples) -> None:
    # Rounding leaves negative zeros; adding zero makes them plain on both sides.
    @query("promql_" + name, f"SELECT * REPLACE (value + 0 AS value) FROM ({oracle})" if oracle else None)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = Engine(source(spark, sf_dir), START, END, STEP).query(text)
        return out.select("step", *[F.coalesce(F.try_element_at("labels", F.lit(x)), F.lit("")).alias(x) for x in labels], (F.round("value", 6) + F.lit(0.0)).alias("value"))


_S = "s AS (SELECT epoch_us(ts) // 1000 AS ts, event_type, (user_id % 7)::VARCHAR AS u, value::DOUBLE AS value FROM events)"
_G = f"g AS (SELECT unnest(generate_series({START}::BIGINT, {END}::BIGINT, {STEP}::BIGINT)) AS step)"


def _over(agg: str, span: int = 86_400_000, where: str = "true", offset: int = 0) -> str:
    return f"WITH {_S}, {_G} SELECT step, event_type, u, round({agg}, 6) AS value FROM g JOIN s ON s.ts > step - {span + offset} AND s.ts <= step - {offset} WHERE {where} GROUP BY ALL"


def _top(select: str, inner: str) -> str:
    return f"WITH x AS ({inner}) {select}"


_BOTH = ("event_type", "u")
for _n, _f in {"sum": "sum(value)", "avg": "avg(value)", "count": "count(*)::DOUBLE", "min": "min(value)", "max": "max(value)", "stddev": "stddev_pop(value)", "stdvar": "var_pop(value)", "last": "arg_max(value, ts)", "first": "arg_min(value, ts)", "present": "1.0::DOUBLE", "ts_of_first": "min(ts) / 1000", "ts_of_last": "max(ts) / 1000"}.items():
    metric(f"{_n}_over_time", f"{_n}_over_time(v[1d])", _BOTH, _over(_f))
metric("quantile_over_time", "quantile_over_time(0.25, v[1d])", _BOTH, _over("quantile_cont(value, 0.25)"))
metric("mad_over_time", "mad_over_time(v[1d])", _BOTH, _over("mad(value)"))
metric("ts_of_max_over_time", "ts_of_max_over_time(v[1d])", _BOTH, _over("max(ts) / 1000", where="true").replace("max(ts) / 1000", "arg_max(ts, value) / 1000"))
metric("instant_selector", 'v{event_type="click"}', _BOTH, _over("arg_max(value, ts)", 300_000, "event_type = 'click'"))
metric("matchers", 'sum_over_time(v{event_type=~"click|view",u!~"[3-9]",u!="1",none=""}[12h])', _BOTH, _over("sum(value)", 43_200_000, "event_type IN ('click', 'view') AND u IN ('0', '2')"))
metric("offset", "sum_over_time(v[1d] offset 6h)", _BOTH, _over("sum(value)", offset=21_600_000))
metric("at_start", "sum_over_time(v[1d] @ start() offset -1d)", _BOTH, f"WITH {_S}, {_G} SELECT step, event_type, u, round(sum(value), 6) AS value FROM g CROSS JOIN s WHERE ts > {START} AND ts <= {START + 86_400_000} GROUP BY ALL")
metric("at_end", "max_over_time(v[30d] @ end())", _BOTH, f"WITH {_S}, {_G} SELECT step, event_type, u, round(max(value), 6) AS value FROM g CROSS JOIN s WHERE ts > {END - 30 * 86_400_000} AND ts <= {END} GROUP BY ALL")
metric("duration_expression", "count_over_time(v[6h+30m*2])", _BOTH, _over("count(*)::DOUBLE", 25_200_000))
metric("subquery", "max_over_time(sum_over_time(v[6h])[1d:6h])", _BOTH, f"""WITH {_S}, q AS (SELECT unnest(generate_series({START - 86_400_000}::BIGINT, {END}::BIGINT, {STEP}::BIGINT)) AS t), i AS (SELECT t, event_type, u, sum(value) AS value FROM q JOIN s ON s.ts > t - 21600000 AND s.ts <= t GROUP BY ALL), {_G}
SELECT step, event_type, u, round(max(value), 6) AS value FROM g JOIN i ON i.t > step - 86400000 AND i.t <= step GROUP BY ALL""")
_SUM = f"WITH {_S}, {_G}, x AS (SELECT step, event_type, u, sum(value) AS value FROM g JOIN s ON s.ts > step - 86400000 AND s.ts <= step GROUP BY ALL) "
for _n, _f in {"sum": "sum(value)", "avg": "avg(value)", "count": "count(*)::DOUBLE", "min": "min(value)", "max": "max(value)", "stddev": "stddev_pop(value)", "stdvar": "var_pop(value)", "group": "1.0::DOUBLE"}.items():
    metric(f"agg_{_n}", f"{_n} by (event_type) (sum_over_time(v[1d]))", ("event_type",), _SUM + f"SELECT step, event_type, round({_f}, 6) AS value FROM x GROUP BY ALL")
metric("agg_without", "sum without (u) (sum_over_time(v[1d]))", ("event_type",), _SUM + "SELECT step, event_type, round(sum(value), 6) AS value FROM x GROUP BY ALL")
metric("agg_quantile", "quantile by (event_type) (0.9, sum_over_time(v[1d]))", ("event_type",), _SUM + "SELECT step, event_type, round(quantile_cont(value, 0.9), 6) AS value FROM x GROUP BY ALL")
metric("topk", "topk(3, sum_over_time(v[1d]))", _BOTH, _SUM + "SELECT step, event_type, u, round(value, 6) AS value FROM x QUALIFY row_number() OVER (PARTITION BY step ORDER BY value DESC, event_type, u) <= 3")
metric("bottomk", "bottomk by (event_type) (1, sum_over_time(v[1d]))", _BOTH, _SUM + "SELECT step, event_type, u, round(value, 6) AS value FROM x QUALIFY row_number() OVER (PARTITION BY step, event_type ORDER BY value, u) <= 1")
metric("count_values", 'count_values by (event_type) ("n", count_over_time(v[6h]))', ("event_type", "n"), f"WITH {_S}, {_G}, x AS (SELECT step, event_type, u, count(*) AS c FROM g JOIN s ON s.ts > step - 21600000 AND s.ts <= step GROUP BY ALL) SELECT step, event_type, c::VARCHAR AS n, count(*)::DOUBLE AS value FROM x GROUP BY ALL")
metric("limitk", "limitk(2, sum_over_time(v[1d]))", _BOTH)
metric("limit_ratio", "limit_ratio(0.5, sum_over_time(v[1d]))", _BOTH)
metric("vector_scalar", "sum_over_time(v[1d]) * 2 + 1", _BOTH, _over("sum(value) * 2 + 1"))
metric("comparison_filter", "sum_over_time(v[1d]) > 200", _BOTH, _SUM + "SELECT step, event_type, u, round(value, 6) AS value FROM x WHERE value > 200")
metric("comparison_bool", "sum_over_time(v[1d]) > bool 200", _BOTH, _SUM + "SELECT step, event_type, u, (value > 200)::INTEGER::DOUBLE AS value FROM x")
metric("vector_vector", "sum_over_time(v[1d]) / count_over_time(v[1d])", _BOTH, _over("sum(value) / count(*)"))
metric("group_left", "sum_over_time(v[1d]) / on (event_type) group_left sum by (event_type) (sum_over_time(v[1d]))", _BOTH, _SUM + "SELECT step, event_type, u, round(value / sum(value) OVER (PARTITION BY step, event_type), 6) AS value FROM x")
metric("ignoring", 'sum_over_time(v{event_type="click"}[1d]) - ignoring (event_type) sum_over_time(v{event_type="view"}[1d])', ("u",), _SUM + "SELECT step, u, round(a.value - b.value, 6) AS value FROM x a JOIN x b USING (step, u) WHERE a.event_type = 'click' AND b.event_type = 'view'")
metric("set_and", 'sum_over_time(v[1d]) and on (u) sum_over_time(v{event_type="click"}[6h]) > 50', _BOTH, _SUM + f", y AS (SELECT step, u, sum(value) AS w FROM g JOIN s ON s.ts > step - 21600000 AND s.ts <= step WHERE event_type = 'click' GROUP BY ALL) SELECT step, event_type, u, round(value, 6) AS value FROM x WHERE EXISTS (SELECT 1 FROM y WHERE y.step = x.step AND y.u = x.u AND w > 50)")
metric("set_unless", 'sum_over_time(v[1d]) unless sum_over_time(v{event_type="click"}[1d])', _BOTH, _SUM + "SELECT step, event_type, u, round(value, 6) AS value FROM x WHERE event_type <> 'click'")
metric("set_or", 'sum_over_time(v{event_type="click"}[1d]) or sum_over_time(v{event_type="view"}[1d])', _BOTH, _SUM + "SELECT step, event_type, u, round(value, 6) AS value FROM x WHERE event_type IN ('click', 'view')")
metric("math", "floor(sqrt(abs(-sum_over_time(v[1d]))))", _BOTH, _over("floor(sqrt(sum(value)))"))
metric("clamp_round", "round(clamp(avg_over_time(v[1d]), 10, 40), 5)", _BOTH, _over("floor(greatest(10, least(40, avg(value))) * (1 / 5.0::DOUBLE) + 0.5) / (1 / 5.0::DOUBLE)"))
metric("time_functions", "hour() + minute() + day_of_month() * 100", (), f"WITH {_G} SELECT step, (extract(hour FROM make_timestamp(step * 1000)) + extract(minute FROM make_timestamp(step * 1000)) + 100 * extract(day FROM make_timestamp(step * 1000)))::DOUBLE AS value FROM g")
metric("vector_time", "vector(time()) - 5", (), f"WITH {_G} SELECT step, step / 1000 - 5.0::DOUBLE AS value FROM g")
metric("label_replace", 'label_replace(sum_over_time(v[1d]), "w", "x-$1", "u", "([0-3])")', (*_BOTH, "w"), _SUM + "SELECT step, event_type, u, CASE WHEN u IN ('0','1','2','3') THEN 'x-' || u ELSE '' END AS w, round(value, 6) AS value FROM x")
metric("label_join", 'label_join(sum_over_time(v[1d]), "w", "/", "u", "event_type")', ("w",), _SUM + "SELECT step, u || '/' || event_type AS w, round(value, 6) AS value FROM x")
metric("absent", 'absent(v{event_type="click",u="1"})', _BOTH, f"WITH {_S}, {_G} SELECT step, 'click' AS event_type, '1' AS u, 1.0::DOUBLE AS value FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE event_type = 'click' AND u = '1' AND ts > step - 300000 AND ts <= step)")
_PAIR = "p AS (SELECT *, lag(value) OVER (PARTITION BY step, event_type, u ORDER BY ts) AS b, lag(ts) OVER (PARTITION BY step, event_type, u ORDER BY ts) AS bt, row_number() OVER (PARTITION BY step, event_type, u ORDER BY ts DESC) AS rn FROM (SELECT DISTINCT step, event_type, u, ts, value FROM g JOIN s ON s.ts > step - 86400000 AND s.ts <= step))"
metric("changes", "changes(v[1d])", _BOTH, f"WITH {_S}, {_G}, {_PAIR} SELECT step, event_type, u, sum((b IS NOT NULL AND b <> value)::INTEGER)::DOUBLE AS value FROM p GROUP BY ALL")
metric("resets", "resets(v[1d])", _BOTH, f"WITH {_S}, {_G}, {_PAIR} SELECT step, event_type, u, sum((b IS NOT NULL AND value < b)::INTEGER)::DOUBLE AS value FROM p GROUP BY ALL")
metric("idelta", "idelta(v[1d])", _BOTH, f"WITH {_S}, {_G}, {_PAIR} SELECT step, event_type, u, round(value - b, 6) AS value FROM p WHERE rn = 1 AND b IS NOT NULL")
metric("irate", "irate(v[1d])", _BOTH, f"WITH {_S}, {_G}, {_PAIR} SELECT step, event_type, u, round((CASE WHEN value < b THEN value ELSE value - b END) / ((ts - bt) / 1000), 6) AS value FROM p WHERE rn = 1 AND b IS NOT NULL")
metric("deriv", "deriv(v[1d])", _BOTH, f"WITH {_S}, {_G} SELECT step, event_type, u, round(regr_slope(value, ts / 1000 - 1704000000), 6) AS value FROM g JOIN s ON s.ts > step - 86400000 AND s.ts <= step GROUP BY ALL HAVING count(*) > 1")
_RATE = f"""WITH {_S}, {_G}, {_PAIR}, a AS (SELECT step, event_type, u, count(*) AS n, min(ts) AS t0, max(ts) AS t1, arg_min(value, ts) AS v0, arg_max(value, ts) - arg_min(value, ts) + sum(CASE WHEN value < b THEN b ELSE 0 END) AS d, arg_max(value, ts) - arg_min(value, ts) AS plain FROM p GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT *, (t1 - t0) / 1000 AS si, (t1 - t0) / 1000 / (n - 1) AS gap, (t0 - (step - 86400000)) / 1000 AS s0, (step - t1) / 1000 AS e0 FROM a),
f AS (SELECT *, CASE WHEN s0 >= gap * 1.1::DOUBLE THEN gap / 2 ELSE s0 END AS s1, CASE WHEN e0 >= gap * 1.1::DOUBLE THEN gap / 2 ELSE e0 END AS e1 FROM c),
z AS (SELECT *, CASE WHEN d > 0 AND v0 >= 0 AND si * v0 / d < s1 THEN si * v0 / d ELSE s1 END AS s2 FROM f) """
metric("increase", "increase(v[1d])", _BOTH, _RATE + "SELECT step, event_type, u, round(d * ((si + s2 + e1) / si), 6) AS value FROM z")
metric("rate", "rate(v[1d])", _BOTH, _RATE + "SELECT step, event_type, u, round(d * ((si + s2 + e1) / si) / 86400, 6) AS value FROM z")
metric("delta", "delta(v[1d])", _BOTH, _RATE + "SELECT step, event_type, u, round(plain * ((si + s1 + e1) / si), 6) AS value FROM z")
metric("predict_linear", "predict_linear(v[1d], 3600)", _BOTH, f"WITH {_S}, {_G} SELECT step, event_type, u, round(regr_slope(value, (ts - step) / 1000) * 3600 + regr_intercept(value, (ts - step) / 1000), 6) AS value FROM g JOIN s ON s.ts > step - 86400000 AND s.ts <= step GROUP BY ALL HAVING count(*) > 1")
metric("matcher_alternatives", 'count_over_time({event_type="click",u=~"[0-2]" or event_type="view",u!~"[0-2]"}[1d])', _BOTH, _over("count(*)::DOUBLE", where="(event_type = 'click' AND u IN ('0', '1', '2')) OR (event_type = 'view' AND u NOT IN ('0', '1', '2'))"))
metric("scalar_of_vector", "sum_over_time(v[1d]) / scalar(sum(sum_over_time(v[1d])))", _BOTH, _SUM + "SELECT step, event_type, u, round(value / sum(value) OVER (PARTITION BY step), 6) AS value FROM x")
metric("step_and_range", "vector(step() + range())", (), f"WITH {_G} SELECT step, {(STEP + END - START) / 1000}::DOUBLE AS value FROM g")
metric("sort_desc", "sort_desc(sum_over_time(v[1d]))", _BOTH, _over("sum(value)"))
#: Samples of a day's window (w), the last one of the five minutes before it (lo) and the first of those after it (hi).
_BORDERS = f"""WITH {_S}, {_G}, w AS (SELECT step, event_type, u, ts, value FROM g JOIN s ON s.ts > step - 86400000 AND s.ts <= step),
lo AS (SELECT step, event_type, u, max(ts) AS lt, arg_max(value, ts) AS lv FROM g JOIN s ON s.ts > step - 86700000 AND s.ts <= step - 86400000 GROUP BY ALL),
hi AS (SELECT step, event_type, u, min(ts) AS ht, arg_min(value, ts) AS hv FROM g JOIN s ON s.ts > step AND s.ts <= step + 300000 GROUP BY ALL),
e AS (SELECT step, event_type, u, min(ts) AS ft, arg_min(value, ts) AS fv, max(ts) AS zt, arg_max(value, ts) AS zv FROM w GROUP BY ALL) """
metric("increase_anchored", "increase(v[1d] anchored)", _BOTH, _BORDERS + """, p AS (SELECT step, event_type, u, ts, value FROM w UNION ALL SELECT step, event_type, u, step - 86400000, coalesce(lv, fv) FROM e LEFT JOIN lo USING (step, event_type, u)),
q AS (SELECT *, lag(value) OVER (PARTITION BY step, event_type, u ORDER BY ts) AS b FROM p) SELECT step, event_type, u, round(arg_max(value, ts) - arg_min(value, ts) + sum(CASE WHEN value < b THEN b ELSE 0 END), 6) AS value FROM q GROUP BY ALL""")
metric("delta_smoothed", "delta(v[1d] smoothed)", _BOTH, _BORDERS + """, a AS (SELECT *, step - 86400000 AS low FROM e FULL JOIN lo USING (step, event_type, u) FULL JOIN hi USING (step, event_type, u)),
f AS (SELECT *, coalesce(ft, ht) AS nt, coalesce(fv, hv) AS nv, coalesce(zt, lt) AS pt, coalesce(zv, lv) AS pv FROM a WHERE ft IS NOT NULL OR (ht IS NOT NULL AND lt IS NOT NULL))
SELECT step, event_type, u, round(CASE WHEN ht IS NULL OR pt = step THEN pv ELSE pv + (hv - pv) * (step - pt) / (ht - pt) END - CASE WHEN lt IS NULL THEN nv WHEN lt = low THEN lv ELSE lv + (nv - lv) * (low - lt) / (nt - lt) END, 6) AS value FROM f""")
#: Ranks and interpolation inside the buckets of a classic histogram summed over two days.
_BUCKETS = f"""WITH {_S}, {_G}, l AS (SELECT unnest([10, 25, 50, 100, 200, 'Infinity'::DOUBLE]) AS le), b AS (SELECT step, event_type, le, count(*) FILTER (WHERE value <= le)::DOUBLE AS n FROM g JOIN s ON (s.ts // 86400000) * 86400000 > step - 172800000 AND (s.ts // 86400000) * 86400000 <= step CROSS JOIN l GROUP BY ALL),
r AS (SELECT *, q, q * max(n) OVER w AS rank, coalesce(lag(n) OVER o, 0) AS c, coalesce(lag(le) OVER o, 0) AS low FROM b CROSS JOIN (SELECT unnest([{{}}]) AS q) WINDOW w AS (PARTITION BY step, event_type, q), o AS (PARTITION BY step, event_type, q ORDER BY le)) """
_AT = "round(CASE WHEN isinf(le) THEN 200 ELSE low + (le - low) * (rank - c) / (n - c) END, 6) AS value FROM r WHERE n >= rank QUALIFY row_number() OVER (PARTITION BY step, event_type, q ORDER BY le) = 1"
metric("histogram_quantiles", 'histogram_quantiles(sum_over_time(h_bucket[2d]), "q", 0.5, 0.9)', ("event_type", "q"), _BUCKETS.format("0.5::DOUBLE, 0.9::DOUBLE") + "SELECT step, event_type, q::VARCHAR AS q, " + _AT, source=bucket_samples)
metric("histogram_fraction", "histogram_fraction(0, 25, sum_over_time(h_bucket[2d]))", ("event_type",), _over("count(*) FILTER (WHERE value <= 25) / count(*)::DOUBLE", 172_800_000).replace("s.ts > step", "(s.ts // 86400000) * 86400000 > step").replace("s.ts <= step", "(s.ts // 86400000) * 86400000 <= step").replace("event_type, u,", "event_type,"), source=bucket_samples)
# Sixth decimals of smoothed values are ties as often as not, and rounded either way by either side: tests have a plain version.
metric("double_exponential_smoothing", "double_exponential_smoothing(v[1d], 0.5, 0.3)", _BOTH)
metric("histogram_quantile", "histogram_quantile(0.9, sum_over_time(h_bucket[2d]))", ("event_type",), _BUCKETS.format("0.9::DOUBLE") + "SELECT step, event_type, " + _AT, source=bucket_samples)


metric("ts_of_min_over_time", "ts_of_min_over_time(v[1d])", _BOTH, _over("arg_min(ts, (value, -ts)) / 1000"))
metric("trig", "sin(avg_over_time(v[1d])) + cos(avg_over_time(v[1d])) * atan(avg_over_time(v[1d])) + tanh(avg_over_time(v[1d]) / 100) + rad(deg(avg_over_time(v[1d]))) + asinh(avg_over_time(v[1d])) - pi()", _BOTH, _over("sin(avg(value)) + cos(avg(value)) * atan(avg(value)) + tanh(avg(value) / 100) + avg(value) + asinh(avg(value)) - pi()"))
metric("inverse_trig", "asin(avg_over_time(v[1d]) / 1000) + acos(avg_over_time(v[1d]) / 1000) * 2 + atanh(avg_over_time(v[1d]) / 1000) + acosh(avg_over_time(v[1d]) + 2) + sinh(avg_over_time(v[1d]) / 100) + cosh(avg_over_time(v[1d]) / 100) + tan(avg_over_time(v[1d]) / 1000)", _BOTH, _over("asin(avg(value) / 1000) + acos(avg(value) / 1000) * 2 + atanh(avg(value) / 1000) + acosh(avg(value) + 2) + (exp(avg(value) / 100) - exp(-avg(value) / 100)) / 2 + (exp(avg(value) / 100) + exp(-avg(value) / 100)) / 2 + tan(avg(value) / 1000)"))
metric("min_of_max_of", "vector(min_of(hour(), 10)) + max_of(day_of_month(), 12)", (), f"WITH {_G} SELECT step, (least(extract(hour FROM make_timestamp(step * 1000)), 10) + greatest(extract(day FROM make_timestamp(step * 1000)), 12))::DOUBLE AS value FROM g")


@query("metric_label_values", "SELECT DISTINCT 'event_type' AS name, event_type AS v FROM events UNION SELECT DISTINCT 'u', (user_id % 7)::VARCHAR FROM events UNION SELECT '__name__', 'v'")
def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select(F.explode("labels").alias("name", "v")).distinct()


@query("metric_cardinality", "SELECT count(DISTINCT (event_type, user_id % 7)) AS series, count(*) AS samples FROM events")
def cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.plans.promql import series_key

    return samples(spark, sf_dir).agg(F.count_distinct(series_key(F.col("labels"))).alias("series"), F.count("*").alias("samples"))


@query("recording_rule", _SUM + "SELECT 'day:v:sum' AS name, step, event_type, round(sum(value), 6) AS value FROM x GROUP BY ALL")
def recording_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Engine(samples(spark, sf_dir), START, END, STEP).query("sum by (event_type) (sum_over_time(v[1d]))")
    return out.select(F.lit("day:v:sum").alias("name"), "step", F.try_element_at("labels", F.lit("event_type")).alias("event_type"), F.round("value", 6).alias("value"))


@query("alerting_rule_for", _SUM + f""", t AS (SELECT step, event_type FROM x GROUP BY ALL HAVING sum(value) > 3000),
r AS (SELECT *, step - row_number() OVER (PARTITION BY event_type ORDER BY step) * {STEP} AS run FROM t)
SELECT step, event_type, CASE WHEN step - min(step) OVER (PARTITION BY event_type, run) >= 43200000 THEN 'firing' ELSE 'pending' END AS state FROM r""")
def alerting_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert is pending while its condition has held for less than ``for`` (12 h), then it fires."""
    from pyspark.sql import Window as W

    out = Engine(samples(spark, sf_dir), START, END, STEP).query("sum by (event_type) (sum_over_time(v[1d])) > 3000").withColumn("event_type", F.try_element_at("labels", F.lit("event_type")))
    w = W.partitionBy("event_type")
    out = out.withColumn("run", F.col("step") - F.row_number().over(w.orderBy("step")).cast("long") * STEP)
    held = F.col("step") - F.min("step").over(W.partitionBy("event_type", "run"))
    return out.select("step", "event_type", F.when(held >= 43_200_000, "firing").otherwise("pending").alias("state"))


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose series have job and instance labels, and a target_info series for each instance."""
    v = samples(spark, sf_dir)
    own = v.select(F.create_map(F.lit("__name__"), F.lit("v"), F.lit("job"), F.col("labels")["event_type"], F.lit("instance"), F.col("labels")["u"]).alias("labels"), "ts", "value")
    info = own.select(F.create_map(F.lit("__name__"), F.lit("target_info"), F.lit("job"), F.col("labels")["job"], F.lit("instance"), F.col("labels")["instance"], F.lit("zone"), F.concat(F.lit("z"), F.col("labels")["instance"])).alias("labels"), "ts", F.lit(1.0).alias("value"))
    return own.unionByName(info)


metric("info", "info(last_over_time(v[5m]))", ("job", "instance", "zone"), _over("arg_max(value, ts)", 300_000).replace("event_type, u,", "event_type AS job, u AS instance, 'z' || u AS zone,"), source=described)


@query("metric_label_names", "SELECT unnest(['__name__', 'event_type', 'u']) AS name")
def label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select(F.explode(F.map_keys("labels")).alias("name")).distinct()


@query("metric_series", "SELECT DISTINCT event_type, (user_id % 7)::VARCHAR AS u FROM events WHERE event_type <> 'view'")
def metric_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series that match a selector."""
    from millrace.plans.promql import matches

    v = samples(spark, sf_dir).where(matches(F.col("labels"), (("__name__", "=", "v"), ("event_type", "!=", "view"))))
    return v.select(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["u"].alias("u")).distinct()


@query("metric_tsdb_stats", "SELECT event_type AS v, count(DISTINCT user_id % 7) AS series, count(*) AS samples FROM events GROUP BY event_type")
def tsdb_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series and samples by the value of a label."""
    from millrace.plans.promql import series_key

    v = samples(spark, sf_dir).withColumn("k", series_key(F.col("labels")))
    return v.groupBy(F.col("labels")["event_type"].alias("v")).agg(F.count_distinct("k").alias("series"), F.count("*").alias("samples"))


@query("metric_exemplars", "SELECT event_type, event_id::VARCHAR AS trace_id, value FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-10'")
def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exemplars of the series of a selector in a range of time."""
    e = views(spark, sf_dir, "events").sql("SELECT map('__name__', 'v', 'event_type', event_type) AS labels, unix_millis(CAST(ts AS TIMESTAMP)) AS ts, value, CAST(event_id AS STRING) AS trace_id FROM events")
    from millrace.plans.promql import matches

    e = e.where(matches(F.col("labels"), (("event_type", "=", "purchase"),))).where(F.col("ts").between(1_704_412_800_000, 1_704_844_800_000))
    return e.select(F.col("labels")["event_type"].alias("event_type"), "trace_id", "value")


@query("metric_metadata", "SELECT * FROM (VALUES ('v', 'gauge', 'Value of an event.', ''), ('h', 'histogram', 'Values by size.', '')) AS m(metric, type, help, unit)")
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest metadata of each metric family, out of an ingestion log."""
    rows = [("v", 1, "counter", "old", ""), ("v", 2, "gauge", "Value of an event.", ""), ("h", 1, "histogram", "Values by size.", "")]
    log = spark.createDataFrame(rows, "metric string, ts int, type string, help string, unit string")
    return log.groupBy("metric").agg(F.max_by(F.struct("type", "help", "unit"), "ts").alias("m")).select("metric", "m.*")


@query("metric_remote_read", "SELECT epoch_us(ts) // 1000 AS ts, value FROM events WHERE event_type = 'click' AND user_id % 7 = 2 AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-10'")
def remote_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw samples of matchers and a range of time."""
    from millrace.plans.promql import matches

    v = samples(spark, sf_dir).where(F.col("ts").between(1_704_412_800_000, 1_704_844_800_000))
    return v.where(matches(F.col("labels"), (("event_type", "=", "click"), ("u", "=~", "2")))).select("ts", "value")
