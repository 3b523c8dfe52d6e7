"""The front ends on small hand-made data: dialect, metrics, logs, traces, streams."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates, jsons, strings
from millrace.plans import dialect, logql, promql, promql_parser, traceql
from millrace.streaming import runtime, stateful, windows


def test_rewrites():
    assert "LIMIT 4" in dialect.rewrite("SELECT a FROM t ORDER BY a FETCH FIRST 4 ROWS ONLY")
    assert "a NULLS LAST" in dialect.rewrite("SELECT a FROM t ORDER BY a")
    assert "a DESC NULLS FIRST" in dialect.rewrite("SELECT a FROM t ORDER BY a DESC")
    assert dialect.rewrite("SELECT a FROM t ORDER BY a NULLS FIRST").count("NULLS") == 1
    assert "'x ~ ORDER BY'" in dialect.rewrite("SELECT 'x ~ ORDER BY' AS s")
    assert dialect.similar_pattern("a%_(b|c)") == "^(?s:a.*.(b|c))$"


def test_any_all_with_nulls(spark):
    spark.createDataFrame([(1,), (3,), (None,)], "x int").createOrReplaceTempView("anyall")
    run = lambda t: [tuple(r) for r in dialect.run_sql(spark, t).collect()]
    assert run("SELECT x FROM anyall WHERE x = ANY (SELECT 3)") == [(3,)]
    assert run("SELECT x FROM (VALUES (5), (2)) AS v(x) WHERE x > ALL (SELECT x FROM anyall)") == []
    assert run("SELECT x FROM (VALUES (5), (2)) AS v(x) WHERE x > ALL (SELECT x FROM anyall WHERE x IS NOT NULL)") == [(5,)]


def series(spark, values, labels=None, step=60_000, name="m"):
    labels = {"__name__": name, **(labels or {})}
    return [(labels, k * step, float(v)) if v is not None else (labels, k * step, None) for k, v in enumerate(values)]


def metric(spark, rows, text, start, end, step=60_000):
    df = spark.createDataFrame(rows, "labels map<string,string>, ts long, value double")
    return sorted((tuple(sorted(r.labels.items())), r.step, r.value) for r in promql.Engine(df, start, end, step).query(text).collect())


def test_staleness_and_lookback(spark):
    rows = series(spark, [1, None, 3])
    got = metric(spark, rows, "m", 0, 480_000)
    assert [(t // 60_000, v) for _, t, v in got] == [(0, 1.0), (2, 3.0), (3, 3.0), (4, 3.0), (5, 3.0), (6, 3.0)]


def test_rate_matches_plain_extrapolation(spark):
    values, span, t = [0, 5, 9, 2, 7, 30], 300_000, 330_000
    got = metric(spark, series(spark, values), "increase(m[5m])", t, t)
    pts = [(k * 60_000, v) for k, v in enumerate(values) if t - span < k * 60_000 <= t]
    change = pts[-1][1] - pts[0][1] + sum(a for (_, a), (_, b) in zip(pts, pts[1:]) if b < a)
    sampled = (pts[-1][0] - pts[0][0]) / 1000
    gap, lo, hi = sampled / (len(pts) - 1), (pts[0][0] - (t - span)) / 1000, (t - pts[-1][0]) / 1000
    lo = gap / 2 if lo >= 1.1 * gap else lo
    lo = min(lo, sampled * pts[0][1] / change)
    hi = gap / 2 if hi >= 1.1 * gap else hi
    assert got[0][2] == pytest.approx(change * (sampled + lo + hi) / sampled)


def test_metric_edges(spark):
    rows = series(spark, [1, 2, float("nan")], {"a": "x"}) + series(spark, [4, 0, 1], {"a": "y"})
    assert [v for _, _, v in metric(spark, rows, "max(m)", 120_000, 120_000)] == [1.0]
    assert math.isinf(metric(spark, rows, '1 / m{a="y"}', 60_000, 60_000)[0][2])
    assert metric(spark, rows, 'absent(m{a="z"})', 0, 0) == [((("a", "z"),), 0, 1.0)]
    assert metric(spark, rows, "limitk(1, m)", 0, 0)[0][1] == 0
    with pytest.raises(ValueError):
        promql.Engine(spark.createDataFrame(rows, "labels map<string,string>, ts long, value double"), 0, 11_000 * 60_000, 60_000)


def test_histogram_quantile_interpolates(spark):
    rows = []
    for le, c in (("1", 2.0), ("2", 6.0), ("4", 8.0), ("+Inf", 10.0)):
        rows += series(spark, [c], {"le": le}, name="b")
    q = lambda x: metric(spark, rows, f"histogram_quantile({x}, b)", 0, 0)[0][2]
    assert q(0.4) == pytest.approx(1.5) and q(0.1) == pytest.approx(0.5) and q(0.95) == 4.0 and math.isinf(q(2))


def test_parser():
    p = promql_parser.parse('sum by (a) (rate(m{a="b",c!~"d"}[5m] offset 1h)) / on (a) group_left (z) n > bool 2 ^ 3')
    assert isinstance(p, promql_parser.Binary) and p.op == ">" and p.bool_
    assert promql_parser.parse("m[1h:5m]").step == 300_000 and promql_parser.duration("1h30m") == 5_400_000
    with pytest.raises(ValueError):
        promql_parser.parse("sum(m")


def test_log_units_and_ip(spark):
    rows = [({"app": "x"}, 1, "ip=10.0.0.7 took=1m2s size=3KB"), ({"app": "x"}, 2, "ip=192.168.1.1 took=5s size=900B")]
    df = spark.createDataFrame(rows, "labels map<string,string>, ts long, line string")
    assert [r.ts for r in logql.logs(df, '{app="x"} | logfmt | took > 1m').collect()] == [1]
    assert [r.ts for r in logql.logs(df, '{app="x"} | logfmt | size < 1KB or took > 2m').collect()] == [2]
    assert [r.ts for r in logql.logs(df, '{app="x"} |= ip("10.0.0.0/8")').collect()] == [1]


def test_nested_sets_survive_cycles(spark):
    rows = [("t", "a", None, "n", "s", 1, 5), ("t", "b", "a", "n", "s", 2, 5), ("t", "c", "b", "n", "s", 3, 5), ("u", "x", "y", "n", "s", 1, 5), ("u", "y", "x", "n", "s", 2, 5)]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, name string, service string, start long, duration long")
    got = {(r.trace_id, r.span_id): (r.lft, r.rgt, r.parent) for r in traceql.nested_sets(df).collect()}
    assert got["t", "a"] == (1, 6, -1) and got["t", "b"] == (2, 5, 1) and got["t", "c"] == (3, 4, 2)
    assert got["u", "x"] == (1, 4, -1) and got["u", "y"] == (2, 3, 1)


def test_sliding_windows_on_a_line(spark):
    df = spark.createDataFrame([("k", 0, 1.0), ("k", 5, 2.0), (None, 1, 9.0)], "k string, t long, v double")
    got = sorted((r.start, r["count"], r.total) for r in windows.sliding(df, "k", "t", 10, "v").collect())
    assert got == [(-10, 1, 1.0), (-5, 2, 3.0), (1, 1, 2.0)]


def test_suppression_in_a_stream(spark, tmp_path):
    schema = "k string, ms long, v double"
    for n, rows in enumerate([[("a", 0, 1.0), ("b", 0, 5.0)], [("a", 40, 2.0)], [("a", 120, 3.0), ("b", 10, 6.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    src = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = runtime.drain(stateful.suppress_until(src, "k", "ms", "v", 100)).collect()
    assert [tuple(r) for r in got] == [("a", 120, 3.0)]
    assert stateful.grace_join([("a", 5, 1), ("a", 50, 2), ("a", 30, 3)], [("a", 0, "x"), ("a", 40, "y")], 10) == [("a", 5, 1, "x"), ("a", 50, 2, "y")]


def test_functions_of_their_own(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(strings.chr_(F.lit(8364))) == "€" and one(strings.substr_(F.lit("abcdef"), 0, 2)) == "a"
    assert one(strings.regexp_replace_(F.lit("aXbX"), "X", "-")) == "a-bX" and one(strings.regexp_replace_(F.lit("aXbX"), "X", "-", "g")) == "a-b-"
    assert one(strings.regexp_match(F.lit("foo12"), "([a-z]+)([0-9]+)")) == ["foo", "12"]
    assert jsons.path_query({"a": [{"b": 1}, {"b": 5}]}, "$.a[*] ? (@.b > 2).b") == [5]
    assert one(dates.extract("isodow", F.lit("2024-01-07").cast("timestamp_ntz"))) == 7
    assert one(dates.to_char(F.lit("2024-01-07 15:04:05").cast("timestamp_ntz"), "YYYY-MM-DD HH24:MI:SS")) == "2024-01-07 15:04:05"


def test_grace_join_as_a_stream(spark, tmp_path):
    left = [("a", 5, "1"), ("a", 50, "2"), ("a", 30, "3"), ("a", 45, "4"), ("a", 70, "5")]
    right = [("a", 0, "x"), ("a", 40, "y"), ("b", 1, "z")]
    schema = "k string, ms long, v string"
    for n, row in enumerate(left):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{tmp_path}/left/{n}")
    spark.createDataFrame(right, schema).coalesce(1).write.parquet(f"{tmp_path}/right/0")
    read = lambda side: spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{side}/*")
    got = runtime.drain(stateful.stream_grace_join(read("left"), read("right"), "k", "ms", "v", 10)).collect()
    assert sorted(map(tuple, got)) == [("a", 5, "1", "x"), ("a", 45, "4", "y"), ("a", 50, "2", "y")]


def test_extended_windows(spark):
    rows = series(spark, [1, 2, 3, 4, 5, 9, 10, 11, 12, 13], step=15_000)
    at = lambda text, t: [v for *_, v in metric(spark, rows, text, t * 1000, t * 1000)]
    assert [at("increase(m[1m] anchored)", t) for t in (5, 20, 80, 125)] == [[0], [1], [7], [7]]
    assert [at("increase(m[1m] smoothed)", t) for t in (5, 65, 125)] == [[pytest.approx(1 / 3)], [pytest.approx(5)], [pytest.approx(6)]]
    with pytest.raises(ValueError, match="anchored modifier"):
        metric(spark, rows, "deriv(m[1m] anchored)", 0, 0)


def test_scalars_from_data(spark):
    rows = series(spark, [2, 4], {"a": "x"}) + series(spark, [3, 5], {"a": "y"})
    assert [v for *_, v in metric(spark, rows, 'm{a="x"} * scalar(m{a="y"})', 0, 60_000)] == [6.0, 20.0]
    assert math.isnan(metric(spark, rows, "vector(scalar(m) + 1)", 0, 0)[0][2])
    assert [v for *_, v in metric(spark, rows, '{a="x" or a="y",__name__="m"}', 0, 0)] == [2.0, 3.0]


def test_native_histograms(spark):
    from millrace.plans import histograms as h

    rows = [("one", (0, 0.0, 0.0, 4.0, 5.0, {0: 1.0, 1: 2.0, 2: 1.0}, {}, [])), ("none", (0, 0.0, 0.0, 0.0, 0.0, {}, {}, [])), ("both", (0, 0.001, 2.0, 6.0, 0.0, {1: 2.0}, {1: 2.0}, [])), ("custom", (-53, 0.0, 0.0, 4.0, 20.0, {0: 1.0, 1: 3.0}, {}, [5.0, 10.0]))]
    df = spark.createDataFrame(rows, f"k string, hist {h.TYPE}")
    x = F.col("hist")
    got = {r.k: r for r in df.select("k", h.quantile(0.5, x).alias("q"), h.fraction(1.0, 2.0, x).alias("f"), h.fraction(0.0, 8.0, x).alias("g"), h.average(x).alias("a"), h.variance(x).alias("v")).collect()}
    assert got["one"].q == pytest.approx(2**0.5) and got["one"].f == 0.5 and got["one"].g == 1 and got["one"].a == 1.25
    assert math.isnan(got["none"].q) and math.isnan(got["none"].f) and math.isnan(got["none"].a)
    assert got["both"].q == pytest.approx(0, abs=0.001) and got["both"].v == pytest.approx(4 * 2 / 6)
    assert got["custom"].q == pytest.approx(5 + 5 / 3) and got["custom"].a == 5
    total = h.merged(df.where("k = 'one'").unionByName(spark.createDataFrame([("one", (1, 0.0, 0.0, 2.0, 3.0, {2: 1.0, 3: 1.0}, {}, []))], df.schema)), ["k"]).first().hist
    assert (total.schema, total["count"], total.sum, dict(total.positive)) == (0, 6.0, 8.0, {0: 1.0, 1: 3.0, 2: 2.0})


def test_traces_that_span_batches(spark):
    rows = [(t, f"{k}", f"{k // 2}" if k else None, "n", "s", k, 5) for t in ("p", "q", None) for k in range(7)]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, name string, service string, start long, duration long")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, 2)
        small = sorted(map(repr, traceql.nested_sets(df).collect()))
    finally:
        spark.conf.set(key, before)
    assert small == sorted(map(repr, traceql.nested_sets(df).collect())) and len(small) == 21
    root = [r for r in traceql.nested_sets(df).collect() if r.span_id == "0"]
    assert all((r.lft, r.rgt, r.parent) == (1, 14, -1) for r in root) and len(root) == 3
    assert traceql.nested_sets(df.limit(0)).count() == 0


def test_double_exponential_smoothing(spark):
    values, sf, tf = [3.0, 5, 4, 8, 9], 0.4, 0.3
    s, b = values[0], values[1] - values[0]
    for y in values[1:]:
        last = s
        s = sf * y + (1 - sf) * (s + b)
        b = tf * (s - last) + (1 - tf) * b
    got = metric(spark, series(spark, values), f"double_exponential_smoothing(m[5m], {sf}, {tf})", 240_000, 240_000)
    assert got[0][2] == pytest.approx(s)


def test_histogram_quantiles_are_labelled(spark):
    rows = []
    for le, c in (("1", 2.0), ("2", 6.0), ("4", 8.0), ("+Inf", 10.0)):
        rows += series(spark, [c], {"le": le}, name="b")
    got = {dict(k)["q"]: v for k, _, v in metric(spark, rows, 'histogram_quantiles(b, "q", 0.4, 0.95)', 0, 0)}
    assert got == {"0.4": pytest.approx(1.5), "0.95": 4.0}
    assert metric(spark, rows, "histogram_fraction(1, 2, b)", 0, 0)[0][2] == pytest.approx(0.4)


def test_interval_left_join_with_nulls_and_repeated_rows(spark):
    from millrace.operators.joins import interval

    left = spark.createDataFrame([(1, 10, None), (1, 10, None), (2, 10, "x"), (2, 10, "x"), (None, 10, None), (1, None, None), (1, 90, "far")], "k int, t int, extra string")
    right = spark.createDataFrame([(1, 11), (1, 14), (None, 10), (1, None)], "j int, s int")
    got = interval(left, right, F.col("k") == F.col("j"), F.col("t"), F.col("s"), 2, 5, "left").collect()
    pairs = [(1, 10, None, 1, 11), (1, 10, None, 1, 14)] * 2
    lonely = [(2, 10, "x", None, None)] * 2 + [(None, 10, None, None, None), (1, None, None, None, None), (1, 90, "far", None, None)]
    assert sorted(map(tuple, got), key=repr) == sorted(pairs + lonely, key=repr)


def test_the_range_of_metric_queries_holds_all_events(spark):
    from millrace.plans.metric_queries import END, START

    for sf in ("sf0.001", "sf0.01"):
        t = spark.read.parquet(f"/root/testdata/{sf}/events.parquet").selectExpr("min(unix_millis(CAST(ts AS TIMESTAMP))) AS a", "max(unix_millis(CAST(ts AS TIMESTAMP))) AS z").first()
        assert START < t.a and t.z <= END


@pytest.mark.parametrize("chunk", [1, 16])
@pytest.mark.parametrize(("step", "span", "offset"), [(7000, 20_000, 0), (7000, 21_000, 0), (7000, 3000, 2000), (5000, 1, 0), (4000, 40_001, -6000), (10_000, 10_000, 0)])
def test_windows_rolled_from_panes(spark, monkeypatch, chunk, step, span, offset):
    """Sums, extremes, moments and lists of windows whose ends and widths do not fit the step, with long gaps between samples."""
    import random
    import statistics

    monkeypatch.setattr(promql, "CHUNK", chunk)
    rnd = random.Random(step + span)
    start, end = 100_000, 300_000
    samples = [(u, t, rnd.random() * 9) for u in "ab" for t in sorted({rnd.choice([rnd.randrange(50_000, 320_000), rnd.randrange(100, 140) * 1000]) for _ in range(90)}) if not 180_000 < t < 240_000]
    df = spark.createDataFrame([({"__name__": "v", "u": u}, t, x) for u, t, x in samples], "labels map<string,string>, ts long, value double")
    engine = promql.Engine(df, start, end, step)
    x = promql_parser.Selector((("__name__", "=", "v"),), range=span, offset=offset)
    inside = {}
    for u, t, v in samples:
        for q in range(start, end + 1, step):
            if q - offset - span < t <= q - offset:
                inside.setdefault((u, q), []).append((t, v))
    plain = {
        "sum": lambda w: sum(v for _, v in w), "avg": lambda w: sum(v for _, v in w) / len(w), "count": len, "min": lambda w: min(v for _, v in w), "max": lambda w: max(v for _, v in w),
        "last": lambda w: max(w)[1], "first": lambda w: min(w)[1], "present": lambda w: 1, "stdvar": lambda w: statistics.pvariance([v for _, v in w]), "ts_of_max": lambda w: max((v, t) for t, v in w)[1] / 1000,
    }
    for name in ("sum", "avg", "count", "last", "stdvar", "ts_of_max") if chunk > 1 else plain:
        got = {(r.labels["u"], r.step): r.value for r in engine.over(x, name).collect()}
        assert set(got) == set(inside)
        for k, w in inside.items():
            assert math.isclose(got[k], plain[name](w), rel_tol=1e-9, abs_tol=1e-9), (name, k)
    listed = {(r.labels["u"], r.step): [tuple(p) for p in r.w] for r in engine.arrays(x).collect()}
    assert listed == {k: sorted(w) for k, w in inside.items()}


def test_parts_of_a_range():
    from millrace.plans import frontend

    for start, end, step, split in ((0, 100, 7, 30), (13, 13, 5, 10), (5, 1000, 45, 20), (-50, 40, 10, 25)):
        got = [t for a, z in frontend.parts(start, end, step, split) for t in range(a, z + 1, step)]
        assert got == list(range(start, end + 1, step))
        assert all(a // split == z // split for a, z in frontend.parts(start, end, step, split))
    assert frontend.parts(5, 4, 1, 1) == []
    with pytest.raises(ValueError, match="positive"):
        frontend.parts(0, 1, 0, 1)
    with pytest.raises(ValueError, match="maximum resolution"):
        frontend.parts(0, 10**9, 1, 10)
    parse = promql_parser.parse
    assert frontend.shardable(parse("avg by (a) (rate(v[5m]))")) and frontend.shardable(parse("topk(2, v)"))
    assert not any(frontend.shardable(parse(t)) for t in ("v", "sum(a / b)", "sum(count by (a) (v))", "quantile(0.5, v)", "sum(histogram_quantile(0.9, v))"))


def test_results_are_kept_for_a_while():
    from millrace.plans import frontend

    now = [0.0]
    kept = frontend.Results(ttl=10, clock=lambda: now[0])
    kept.put("k", "path")
    assert kept.get("k") == "path" and kept.get("other") is None
    now[0] = 10.0
    assert kept.get("k") is None and not kept.known


def test_rule_groups_fall_due_on_their_own_grid():
    from millrace.plans.rules import Group

    groups = [Group(f"g{k}", 60_000, ()) for k in range(40)]
    for g in groups:
        times = g.due(1_000_000, 1_300_000)
        assert len(times) == 5 and all(1_000_000 < t <= 1_300_000 and t % 60_000 == g.offset() for t in times)
        assert sum(g.owned_by(s, 3) for s in (1, 2, 3)) == 1
    assert len({g.offset() for g in groups}) > 30
    with pytest.raises(ValueError, match="between 1 and 3"):
        groups[0].owned_by(4, 3)


def test_type_and_unit_go_with_the_name(spark):
    rows = [({"__name__": "v", "__type__": "counter", "__unit__": "s", "job": "a"}, 60_000, 4.0), ({"__name__": "v", "__type__": "gauge", "__unit__": "s", "job": "b"}, 60_000, 6.0)]
    df = spark.createDataFrame(rows, "labels map<string,string>, ts long, value double")
    run = lambda t, **more: sorted(((dict(r.labels), r.value) for r in promql.Engine(df, 60_000, 60_000, 1000, **more).query(t).collect()), key=repr)
    assert run('v{__type__="counter"}') == [({"__name__": "v", "__type__": "counter", "__unit__": "s", "job": "a"}, 4.0)]
    assert run("-v") == [({"job": "a"}, -4.0), ({"job": "b"}, -6.0)]
    assert run('sum({__unit__="s"})') == [({}, 10.0)]
    with pytest.raises(ValueError, match="more than 1 samples"):
        run("v", max_samples=1)
    assert len(promql.Engine(df, 60_000, 60_000, 1000, max_samples=2).query("v").collect()) == 2


@pytest.mark.parametrize("chunk", [None, 1, 7, 1000])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_as_of_by_pieces_of_time(spark, chunk, how):
    import random

    from millrace.operators.joins import as_of

    rnd = random.Random(3)
    left = [(rnd.choice(["hot", "hot", "a", "b", None]), rnd.choice([rnd.randrange(-30, 60), None]) if k % 9 == 0 else rnd.randrange(-30, 60), k) for k in range(150)]
    right = [(k, t, f"{k}@{t}") for k, t in {(rnd.choice(["hot", "a", None]), rnd.randrange(-30, 60)) for _ in range(60)}]
    a, b = spark.createDataFrame(left, "k string, t long, id int"), spark.createDataFrame(right, "k string, u long, v string")
    got = sorted(tuple(r) for r in as_of(a, b, ["k"], "t", "u", ["v"], how, chunk).select("id", "v").collect())
    want = []
    for k, t, i in left:
        known = [(u, v) for j, u, v in right if j == k and k is not None and t is not None and u <= t]
        if known or how == "left":
            want.append((i, max(known)[1] if known else None))
    assert got == sorted(want)


def test_annotations(spark):
    df = spark.createDataFrame([({"__name__": "v"}, 60_000, 4.0), ({"__name__": "v_total"}, 60_000, 4.0)], "labels map<string,string>, ts long, value double")
    e = promql.Engine(df, 60_000, 60_000, 1000)
    for text in ("quantile(1.5, v)", "rate(v[5m])", "rate(v_total[5m])", "sum(quantile_over_time(0.5, v[5m]))", "limit_ratio(2, v)"):
        e.query(text)
    assert e.annotations == ["PromQL warning: quantile value should be between 0 and 1, got 1.5", 'PromQL info: metric might not be a counter, name does not end in _total/_sum/_count/_bucket: "v"', "PromQL warning: ratio value should be between -1 and 1, got 2, capping to 1"]


def test_courses_of_windows_that_do_not_fit_the_step(spark):
    """Sums over neighbours across the borders of panes."""
    import random

    rnd = random.Random(9)
    samples = sorted({rnd.randrange(40_000, 200_000): float(rnd.randrange(5)) for _ in range(120)}.items())
    df = spark.createDataFrame([({"__name__": "v"}, t, v) for t, v in samples], "labels map<string,string>, ts long, value double")
    engine = promql.Engine(df, 60_000, 190_000, 7000)
    plain = {
        "changes": lambda w: sum(a != b for (_, a), (_, b) in zip(w, w[1:])), "resets": lambda w: sum(b < a for (_, a), (_, b) in zip(w, w[1:])),
        "idelta": lambda w: w[-1][1] - w[-2][1] if len(w) > 1 else None, "irate": lambda w: (w[-1][1] if w[-1][1] < w[-2][1] else w[-1][1] - w[-2][1]) / ((w[-1][0] - w[-2][0]) / 1000) if len(w) > 1 else None,
    }
    for span in (5000, 24_000, 33_000):
        for name, f in plain.items():
            want = {}
            for q in range(60_000, 190_001, 7000):
                w = [(t, v) for t, v in samples if q - span < t <= q]
                if w and f(w) is not None:
                    want[q] = f(w)
            got = {r.step: r.value for r in engine.query(f"{name}(v[{span}ms])").collect()}
            assert set(got) == set(want) and all(math.isclose(got[q], want[q], abs_tol=1e-9) for q in want), (name, span)


def test_slope_of_panes(spark):
    """The slope put together from the panes of a window is that of its samples, far from zero too."""
    values = [1e6 + (k * 7) % 11 for k in range(12)]
    at = [k * 60_000 for k in range(12)]
    rows = [({"__name__": "m"}, 1_700_000_000_000 + t, v) for t, v in zip(at, values)]
    end = 1_700_000_000_000 + 660_000
    got = metric(spark, rows, "deriv(m[7m])", end - 240_000, end, 120_000)
    assert len(got) == 3
    for _, step, v in got:
        own = [(t / 1000, y) for t, y in zip(at, values) if step - 420_000 < t + 1_700_000_000_000 <= step]
        mx, my = sum(t for t, _ in own) / len(own), sum(y for _, y in own) / len(own)
        slope = sum((t - mx) * (y - my) for t, y in own) / sum((t - mx) ** 2 for t, _ in own)
        assert v == pytest.approx(slope, rel=1e-9)
        ahead = metric(spark, rows, "predict_linear(m[7m], 60)", step, step)[0][2]
        assert ahead == pytest.approx(my + slope * ((step - 1_700_000_000_000) / 1000 + 60 - mx), rel=1e-9)
    df = spark.createDataFrame(rows, "labels map<string,string>, ts long, value double")
    assert "collect_list(struct(ts" not in promql.Engine(df, end, end, 60_000).query("deriv(m[7m])")._jdf.queryExecution().optimizedPlan().toString()


def test_alert_held_for_many_steps(spark, tmp_path):
    """Run numbers are long: an alert that holds at every step of the month is no overflow."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from millrace import catalog

    day = 86_400_000_000
    us = [1_704_067_200_000_000 + k * day // 2 for k in range(60)]
    n = len(us)
    pq.write_table(pa.table({"event_id": list(range(n)), "ts": pa.array(us, pa.timestamp("us")), "user_id": [1] * n, "event_type": ["click"] * n, "value": [5000.0] * n, "props": ["{}"] * n}), tmp_path / "events.parquet")
    rows = catalog.QUERIES["alerting_rule_for"](spark, str(tmp_path)).collect()
    assert len(rows) > 100 and sum(r.state == "pending" for r in rows) == 2


def test_two_values_of_one_time(spark):
    """Their rate is infinite, no error."""
    two = [*series(spark, [1, 5, 2, 9]), ({"__name__": "m"}, 180_000, 12.0)]
    assert [v for *_, v in metric(spark, two, "irate(m[5m])", 180_000, 180_000)] == [math.inf]


def test_sample_that_comes_again(spark):
    """A sample of the same time and value counts once."""
    once = series(spark, [1, 5, 2, 9])
    again = once + once[1:3]
    for name in ("increase", "irate", "changes"):
        assert metric(spark, again, f"{name}(m[5m])", 180_000, 180_000) == metric(spark, once, f"{name}(m[5m])", 180_000, 180_000)


def test_suppress_sorts_over_batches(spark, tmp_path):
    """A key's rows come in several Arrow batches and in no order; the updates are those of the sorted rows."""
    ms = [(k * 37) % 101 * 10 for k in range(101)]
    spark.createDataFrame([("a", t, float(t)) for t in ms], "k string, ms long, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    want, since = [], None
    for t in sorted(ms):
        since = t if since is None else since
        if t - since >= 95:
            want.append((t, float(t)))
            since = None
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        src = runtime.stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        rows = runtime.drain(stateful.suppress_until(src, "k", "ms", "v", 95)).collect()
    finally:
        spark.conf.set(key, old)
    assert sorted((r.ms, r.v) for r in rows) == want



def test_last_value_to_the_end(spark):
    """Frames that hold their row and go to the partition's end become the whole partition, others stay."""
    over = "last_value(v) OVER (PARTITION BY g ORDER BY k {} AND UNBOUNDED FOLLOWING)"
    whole = "BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    for start in ("ROWS BETWEEN CURRENT ROW", "ROWS BETWEEN 3 PRECEDING", "RANGE BETWEEN CURRENT ROW"):
        assert whole in dialect.rewrite(f"SELECT {over.format(start)} FROM t")
    assert whole not in dialect.rewrite(f"SELECT {over.format('ROWS BETWEEN 1 FOLLOWING')} FROM t")
    assert whole not in dialect.rewrite("SELECT sum(v) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(v, true) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) FROM t")
    text = f"SELECT k, {over.format('ROWS BETWEEN CURRENT ROW')} AS x FROM VALUES (1, 1, 10), (1, 2, CAST(NULL AS INT)), (2, 1, 5), (2, 2, 7) AS v(g, k, v)"
    assert sorted(tuple(r) for r in dialect.run_sql(spark, text).select("k", F.coalesce("x", F.lit(-1))).collect()) == [(1, -1), (1, 7), (2, -1), (2, 7)]


def test_limit_by_a_subquery(spark):
    run = lambda t: dialect.run_sql(spark, "SELECT id FROM range(100) ORDER BY id DESC " + t)
    assert [r.id for r in run("LIMIT (SELECT count(*) FROM range(3)) OFFSET (SELECT 1)").collect()] == [98, 97, 96]
    assert run("LIMIT (SELECT CAST(NULL AS INT))").count() == 100
    assert "TakeOrderedAndProject" in run("LIMIT (SELECT 3)")._jdf.queryExecution().executedPlan().toString()
    for wrong in ("LIMIT (SELECT id FROM range(2))", "LIMIT (SELECT -1)"):
        with pytest.raises(ValueError):
            run(wrong)


def test_offsets_of_a_long_part_are_dealt(spark):
    from millrace.sources.connectors import offsets_at

    n = 1 << 18
    synced = spark.createDataFrame([("a", 5, 50), ("a", n + 7, 60), ("b", 3 * n, 70)], "part string, source long, target long")
    wanted = spark.createDataFrame([("a", 4), ("a", 5), ("a", n + 6), ("a", 9 * n), ("b", 3 * n - 1), ("b", 3 * n)], "part string, source long")
    out = offsets_at(synced, wanted)
    assert sorted((r.part, r.source, r.target or 0) for r in out.collect()) == [("a", 4, 0), ("a", 5, 50), ("a", n + 6, 50), ("a", 9 * n, 60), ("b", 3 * n - 1, 0), ("b", 3 * n, 70)]
    assert "_c" in out._jdf.queryExecution().optimizedPlan().toString()


def test_groups_are_one_series_from_the_start(spark):
    rows = series(spark, [1, 9, 2], {"a": "x", "b": "1"}) + series(spark, [4, float("nan"), 3], {"a": "x", "b": "2"}) + series(spark, [float("nan")] * 3, {"a": "y", "b": "1"})
    got = lambda text: [(dict(k).get("a"), v) for k, _, v in metric(spark, rows, text, 120_000, 120_000)]
    (x, high), (y, none) = got("max by (a) (max_over_time(m[5m]))")
    assert (x, high, y) == ("x", 9.0, "y") and math.isnan(none)
    assert got('sum(sum_over_time(m{b="1",a="x"}[5m]))') == [(None, 12.0)]
    df = spark.createDataFrame(rows, "labels map<string,string>, ts long, value double")
    plan = promql.Engine(df, 0, 120_000, 60_000).query("max by (a) (max_over_time(m[5m]))")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_logfmt_is_read_once(spark):
    df = spark.createDataFrame([({"app": "s"}, 1, 'a=1 app=t b="x y" a=2 took=1m2.5s e= q=5"'), ({"app": "s"}, 2, "took=3q")], "labels map<string,string>, ts long, line string")
    out = logql.logs(df, '{app="s"} | logfmt | took != ""')
    assert sorted((dict(r.labels) for r in out.collect()), key=len) == [{"app": "s", "took": "3q"}, {"app": "s", "a": "2", "app_extracted": "t", "b": "x y", "took": "1m2.5s", "e": "", "q": "5"}]
    assert spark.createDataFrame([("1m2.5s",), ("3q",), ("1.2.3s",)], "x string").select(logql.seconds(F.col("x")).alias("x")).collect() == [(62.5,), (None,), (None,)]
    rows = logql.Pipeline('{app="s"} | logfmt | unwrap duration(took)').run(df)
    assert sum("regexp_extract_all" in x for x in rows.select("labels", "value")._jdf.queryExecution().optimizedPlan().toString().splitlines() if "([A-Za-z_]" in x) == 1
