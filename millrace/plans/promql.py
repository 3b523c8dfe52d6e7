"""The metrics query language on DataFrames.

An expression becomes one DataFrame over (labels, series, step, value); the step
grid is data, never a loop. The borders of all windows cut time into panes, two
for each step at most. Samples are aggregated by (series, pane), with partial
aggregation, and a window function rolls the panes of a series up to the steps:
there is no range join, and what is exchanged does not grow with range / step. Long
series are cut into chunks of time, so a hot one is dealt over tasks.

``samples`` has labels (map), ts (ms) and value; a null value is a stale marker.
A time of day or a number is a column of the step, so scalars cost no join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.plans import promql_parser as P

LOOKBACK = 300_000
#: Labels that tell what a metric is; an operation that makes another metric drops them.
META = ("__name__", "__type__", "__unit__")
MAX_POINTS = 11_000


def series_key(labels: Column) -> Column:
    """Canonical text of a label set; empty values count as absent."""
    entries = F.sort_array(F.map_entries(labels))
    return F.array_join(F.transform(F.filter(entries, lambda e: e["value"] != ""), lambda e: F.concat(e["key"], F.lit("\x01"), e["value"])), "\x02")


def matches(labels: Column, matchers) -> Column:
    """All matchers hold; an absent label is the empty string and expressions are anchored."""
    out = F.lit(True)
    for name, op, value in matchers:
        if op == "or":
            any_of = F.lit(False)
            for alternative in value:
                any_of |= matches(labels, alternative)
            out &= any_of
            continue
        have = F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit(""))
        test = have.rlike(f"^(?s:{value})$") if "~" in op else have == value
        out &= ~test if op.startswith("!") else test
    return out


@dataclass
class Scalar:
    """A number for each step: a column over ``step`` (ms)."""

    column: Column


@dataclass
class PerStep:
    """A number for each step that comes from data: rows (step, s)."""

    rows: DataFrame


def _only(labels: Column, names) -> Column:
    return F.map_filter(labels, lambda k, v: k.isin(list(names)) if names else F.lit(False))


def _less(labels: Column, names) -> Column:
    return F.map_filter(labels, lambda k, v: ~k.isin(list(names)))


def _nameless(df: DataFrame) -> DataFrame:
    return _relabel(df, _less(F.col("labels"), META))


def _relabel(df: DataFrame, labels: Column) -> DataFrame:
    df = df.withColumn("labels", labels)
    return df.withColumn("series", series_key(F.col("labels")))


def _nan(x: Column) -> Column:
    return F.coalesce(x, F.lit(float("nan")))


def _div(a: Column, b: Column) -> Column:
    """IEEE division: ANSI mode would raise."""
    inf = F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, inf).otherwise(F.try_divide(a, b))


def _log(f, x: Column) -> Column:
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(f(x))


_MATH = {"abs": F.abs, "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"), "sgn": F.signum, "sqrt": F.sqrt, "exp": F.exp, "ln": lambda x: _log(F.ln, x), "log2": lambda x: _log(F.log2, x), "log10": lambda x: _log(F.log10, x),
         "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh, "deg": F.degrees, "rad": F.radians}
_time = lambda x: F.timestamp_seconds(x)
_DATE = {"year": lambda x: F.year(_time(x)), "month": lambda x: F.month(_time(x)), "day_of_month": lambda x: F.dayofmonth(_time(x)), "day_of_week": lambda x: F.dayofweek(_time(x)) - 1, "day_of_year": lambda x: F.dayofyear(_time(x)), "days_in_month": lambda x: F.dayofmonth(F.last_day(_time(x))), "hour": lambda x: F.hour(_time(x)), "minute": lambda x: F.minute(_time(x))}
_ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": _div, "%": lambda a, b: F.when(b == 0, F.lit(float("nan"))).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b)), "^": F.pow, "atan2": F.atan2}
_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: (a < b) & ~F.isnan(b), "<=": lambda a, b: (a <= b) & ~F.isnan(b), ">": lambda a, b: (a > b) & ~F.isnan(a), ">=": lambda a, b: (a >= b) & ~F.isnan(a)}
_value = lambda: F.col("value")
_numbers = lambda: F.when(~F.isnan("value"), F.col("value"))
_point = lambda: F.struct("ts", "value")
_lowest, _highest = (lambda: F.struct((-_value()).alias("v"), "ts")), (lambda: F.struct(_value().alias("v"), "ts"))


def _same(agg, of, then=lambda c: c):
    """An aggregate of a window that is the same aggregate of its panes'."""
    return {"_a": agg(of())}, lambda over: then(over(agg("_a")))


def _spread_of(then):
    """Moments of the panes, put together pair by pair so that no digits cancel."""
    value = lambda p: (p["m2"], p["n"], p["mean"])

    def merged(a, p):
        (m2, n, mean), (q2, k, other) = value(a), value(p)
        both = n + k
        off = other - mean
        return F.struct((m2 + q2 + off * off * n * k / both).alias("m2"), both.alias("n"), (mean + off * k / both).alias("mean"))

    partial = {"_a": F.struct((F.var_pop(_value()) * F.count(_value())).alias("m2"), F.count(_value()).cast("double").alias("n"), F.avg(_value()).alias("mean"))}

    def final(over):
        panes = over(F.collect_list("_a"))
        whole = F.aggregate(F.slice(panes, 2, F.greatest(F.size(panes), F.lit(1))), F.element_at(panes, 1), merged)
        return then(whole["m2"] / whole["n"])

    return partial, final


#: For each function over a range: aggregates of a pane, and of a window over its panes.
_OVER = {
    "sum": lambda: _same(F.sum, _value),
    "avg": lambda: ({"_a": F.sum(_value()), "_n": F.count(_value())}, lambda over: over(F.sum("_a")) / over(F.sum("_n"))),
    "count": lambda: ({"_a": F.count("*")}, lambda over: over(F.sum("_a")).cast("double")),
    "min": lambda: _same(F.min, _numbers, _nan),
    "max": lambda: _same(F.max, _numbers, _nan),
    "stddev": lambda: _spread_of(F.sqrt),
    "stdvar": lambda: _spread_of(lambda c: c),
    "last": lambda: _same(F.max, _point, lambda c: c["value"]),
    "first": lambda: _same(F.min, _point, lambda c: c["value"]),
    "present": lambda: ({}, lambda over: F.lit(1.0)),
    "ts_of_first": lambda: _same(F.min, lambda: F.col("ts"), lambda c: c / 1000),
    "ts_of_last": lambda: _same(F.max, lambda: F.col("ts"), lambda c: c / 1000),
    "ts_of_min": lambda: _same(F.max, _lowest, lambda c: c["ts"] / 1000),
    "ts_of_max": lambda: _same(F.max, _highest, lambda c: c["ts"] / 1000),
}
def _steps(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Between two values that follow each other: what a counter lost in a reset, whether it was one, whether they differ."""
    fell = b < a
    return F.when(fell, a).otherwise(0.0), F.when(fell, 1.0).otherwise(0.0), F.when((a != b) & ~(F.isnan(a) & F.isnan(b)), 1.0).otherwise(0.0)


def _course(samples: Column) -> Column:
    """The course of a pane's samples: first, last and last but one, their number, and sums over neighbours."""
    w = F.sort_array(samples)
    n = F.size(w)
    pairs = F.zip_with(F.slice(w, 1, n - 1), F.slice(w, 2, n), lambda a, b: F.struct(a["value"].alias("a"), b["value"].alias("b")))
    pairs = F.filter(pairs, lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    total = lambda k: F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + _steps(p["a"], p["b"])[k])
    drops, falls, moves = map(total, range(3))
    first, last = F.get(w, F.lit(0)), F.element_at(w, -1)
    before = F.when(n >= 2, F.get(w, n - 2))
    return F.struct(first["ts"].alias("t0"), first["value"].alias("v0"), last["ts"].alias("t1"), last["value"].alias("v1"), before.alias("before"), n.alias("n"), drops.alias("drops"), falls.alias("falls"), moves.alias("moves"))


def _course_of_panes(courses: Column) -> Column:
    """The course of a window from those of its panes."""

    def joined(a: Column, p: Column) -> Column:
        drop, fall, move = _steps(a["v1"], p["v0"])
        before = F.when(p["n"] >= 2, p["before"]).otherwise(F.struct(a["t1"].alias("ts"), a["v1"].alias("value")))
        return F.struct(a["t0"].alias("t0"), a["v0"].alias("v0"), p["t1"].alias("t1"), p["v1"].alias("v1"), before.alias("before"), (a["n"] + p["n"]).alias("n"), (a["drops"] + p["drops"] + drop).alias("drops"), (a["falls"] + p["falls"] + fall).alias("falls"), (a["moves"] + p["moves"] + move).alias("moves"))

    ordered = F.sort_array(courses)
    return F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered), F.lit(1))), F.element_at(ordered, 1), joined)


def _line_of(start: int) -> tuple[dict, dict]:
    """Moments of (seconds since ``start``, value) of the panes, put together pair by pair so that no digits cancel."""
    x = (F.col("ts") - start) / 1000
    n = F.count(_value()).cast("double")
    partial = {"_a": F.struct(n.alias("n"), F.avg(x).alias("x"), F.avg(_value()).alias("y"), (F.var_pop(x) * n).alias("xx"), (F.covar_pop(x, _value()) * n).alias("xy"))}

    def merged(a: Column, p: Column) -> Column:
        both = a["n"] + p["n"]
        dx, dy, share = p["x"] - a["x"], p["y"] - a["y"], p["n"] / both
        return F.struct(both.alias("n"), (a["x"] + dx * share).alias("x"), (a["y"] + dy * share).alias("y"), (a["xx"] + p["xx"] + dx * dx * a["n"] * share).alias("xx"), (a["xy"] + p["xy"] + dx * dy * a["n"] * share).alias("xy"))

    def final(over) -> Column:
        panes = F.sort_array(over(F.collect_list("_a")))
        return F.aggregate(F.slice(panes, 2, F.greatest(F.size(panes), F.lit(1))), F.element_at(panes, 1), merged)

    return partial, {"m": final}


#: Ranges that a chunk of a series holds.
CHUNK = 16


class Engine:
    """Evaluates expressions over samples on the grid start, start + step, ..., end (ms)."""

    def __init__(self, samples: DataFrame, start: int, end: int, step: int, lookback: int = LOOKBACK, max_samples: int | None = None):
        if step <= 0 or (end - start) // step + 1 > MAX_POINTS:
            raise ValueError(f"exceeded maximum resolution of {MAX_POINTS} points per series")
        self.samples, self.start, self.end, self.step, self.lookback, self.max_samples = samples, start, end, step, lookback, max_samples
        #: Warnings and notes of the queries so far, which do not change a result.
        self.annotations: list[str] = []

    def query(self, text: str) -> DataFrame:
        """labels, step, value of the expression."""
        out = self.eval(P.parse(text))
        if isinstance(out, PerStep):
            out = self._vector(out)
        if isinstance(out, Scalar):
            out = self.grid().withColumn("value", out.column).withColumn("labels", F.create_map().cast("map<string,string>"))
        return out.select("labels", "step", F.col("value").cast("double").alias("value"))

    def grid(self) -> DataFrame:
        return self.samples.sparkSession.range(self.start, self.end + 1, self.step).select(F.col("id").alias("step"))

    # leaves

    def _rolled(self, df: DataFrame, span: int, offset: int, at, partial: dict[str, Column], final: dict, shrink=None) -> DataFrame:
        """labels, series, step, _t and final columns of each window (_t - span, _t] that holds a sample.

        ``partial``: aggregates of samples (ts, value); ``shrink``: what takes the place of
        the partial column _a of a pane; ``final``: for each name a function of ``over``,
        which makes an aggregate of partial columns one of the window.
        """
        labels = F.first("labels").alias("labels")
        partial = [c.alias(n) for n, c in partial.items()]
        if self.max_samples is not None and df.where((F.col("ts") > self.start - offset - span) & (F.col("ts") <= self.end - offset)).limit(self.max_samples + 1).count() > self.max_samples:
            raise ValueError(f"query processing would load more than {self.max_samples} samples")
        if at is not None:
            at = {"start": self.start, "end": self.end}.get(at, at)
            t = at - offset
            df = df.where((F.col("ts") > t - span) & (F.col("ts") <= t)).groupBy("series").agg(labels, *partial)
            df = df.withColumn("_a", shrink(F.col("_a"))) if shrink else df
            df = df.groupBy("series").agg(labels, *[f(lambda agg: agg).alias(n) for n, f in final.items()])
            steps = F.sequence(F.lit(self.start), F.lit(self.end), F.lit(self.step))
            return df.select("labels", "series", F.explode(steps).alias("step"), F.lit(t).alias("_t"), *final)
        step, start, steps = self.step, self.start, (self.end - self.start) // self.step
        ts = F.col("ts") + offset
        df = df.where((ts > start - span) & (ts <= start + steps * step))
        end = F.ceil((ts - start) / step).cast("long") * step + start
        cut = end - span % step  # where the windows that end later by a multiple of the step begin
        pane = F.when(ts <= cut, cut).otherwise(end)
        panes = df.groupBy("series", pane.alias("_p")).agg(labels, *partial)
        panes = panes.withColumn("_a", shrink(F.col("_a"))) if shrink else panes
        chunk = step * max(1, -(-CHUNK * span // step))
        number = lambda c: F.floor((c - start) / chunk)
        panes = panes.withColumn("_c", F.explode(F.sequence(number(F.col("_p")), number(F.col("_p") + (span - 1)))))
        # A pane opens the steps up to the next pane, as far as its chunk and the windows that hold it reach.
        following = F.lead("_p").over(W.partitionBy("series", "_c").orderBy("_p"))
        nth = F.ceil((F.col("_p") - start) / step).cast("long")
        low = F.greatest(nth, F.col("_c") * (chunk // step), F.lit(0).cast("long"))
        high = F.least(F.floor((F.col("_p") + (span - 1) - start) / step).cast("long"), (F.col("_c") + 1) * (chunk // step) - 1, F.lit(steps).cast("long"), F.ceil((following - start) / step).cast("long") - 1)
        panes = panes.withColumns({"_low": low, "_high": high})
        hit = (F.col("_low") <= F.col("_high")) & (F.col("_low") * step + start == F.col("_p"))
        row = lambda q, own, out: F.struct(q.cast("long").alias("q"), own.alias("own"), out.alias("out"))
        first = F.col("_low") + hit.cast("long")
        opened = F.when(first <= F.col("_high"), F.sequence(first, F.col("_high")))
        opened = F.transform(F.coalesce(opened, F.array().cast("array<bigint>")), lambda k: row(k * step + start, F.lit(False), F.lit(True)))
        rows = panes.withColumn("_r", F.explode(F.concat(F.array(row(F.col("_p"), F.lit(True), hit)), opened)))
        names = [c for c in panes.columns if c not in ("series", "labels", "_p", "_c", "_low", "_high")]
        rows = rows.select("series", "labels", "_c", "_r.q", "_r.out", *[F.when(F.col("_r.own"), F.col(n)).alias(n) for n in names])
        frame = W.partitionBy("series", "_c").orderBy("q").rangeBetween(-(span - 1), 0)
        rows = rows.select("labels", "series", "q", "out", *[f(lambda agg: agg.over(frame)).alias(n) for n, f in final.items()])
        return rows.where("out").select("labels", "series", F.col("q").alias("step"), (F.col("q") - offset).alias("_t"), *final)

    def _rows(self, x) -> tuple[DataFrame, int, int, object]:
        """Samples of a range selector or subquery, with its span, offset and fixed time."""
        if isinstance(x, P.Subquery):
            step = x.step or 60_000
            fixed = None if x.at is None else {"start": self.start, "end": self.end}.get(x.at, x.at)
            low, high = (self.start, self.end) if fixed is None else (fixed, fixed)
            low, high = low - x.offset - x.range, high - x.offset
            first = (low // step + 1) * step
            inner = Engine(self.samples, first, max(first, high), step, self.lookback)
            out = inner.eval(x.expr)
            df = inner.grid().select(F.create_map().cast("map<string,string>").alias("labels"), F.lit("").alias("series"), "step", out.column.alias("value")) if isinstance(out, Scalar) else out
            return df.select("labels", "series", F.col("step").alias("ts"), "value"), x.range, x.offset, x.at
        df = self.samples.where(matches(F.col("labels"), x.matchers)).where("value IS NOT NULL")
        return df.select("labels", series_key(F.col("labels")).alias("series"), "ts", "value"), x.range, x.offset, x.at

    def _vector(self, x: PerStep) -> DataFrame:
        return x.rows.select(F.create_map().cast("map<string,string>").alias("labels"), F.lit("").alias("series"), "step", F.col("s").alias("value"))

    def extended(self, x: P.Selector) -> DataFrame:
        """arrays() with the window's borders known: ``left`` is the value at its start, ``w`` its samples and ``t`` its end.

        Anchored, the start has the last sample at or before it; smoothed, both ends
        have values between the samples around them (``right`` at the end, if a sample
        follows). A window without samples of its own is left out.
        """
        df, span, offset, at = self._rows(x)
        after = self.lookback if x.mode == "smoothed" else 0
        df = self._rolled(df, span + self.lookback + after, offset - after, at, *self._listed("all")).withColumn("t", F.col("_t") - after)
        low = F.col("t") - span
        before, own, later = F.filter("all", lambda s: s["ts"] <= low), F.filter("all", lambda s: (s["ts"] > low) & (s["ts"] <= F.col("t"))), F.filter("all", lambda s: s["ts"] > F.col("t"))
        df = df.withColumns({"lo": F.try_element_at(before, F.lit(-1)), "w": own, "hi": F.get(later, F.lit(0)), "low": low})
        return df.where((F.size("w") > 0) | (F.col("hi").isNotNull() & F.col("lo").isNotNull() if after else F.lit(False)))

    def extended_function(self, name: str, x: P.Selector) -> DataFrame:
        allowed = {"anchored": ("resets", "changes", "rate", "increase", "delta"), "smoothed": ("rate", "increase", "delta")}[x.mode]
        if name not in allowed:
            raise ValueError(f"{x.mode} modifier can only be used with: {', '.join(allowed)} - not with {name}")
        df = self.extended(x)
        counter = name in ("rate", "increase")
        first, last = F.get(F.col("w"), F.lit(0)), F.try_element_at("w", F.lit(-1))
        point = lambda ts, v: F.struct(ts.alias("ts"), v.alias("value"))

        def between(a, b, t, left):
            y1, y2 = a["value"], b["value"]
            if counter:
                y1, y2 = (F.when(y2 < y1, 0.0).otherwise(y1), y2) if left else (y1, F.when(y2 < y1, y1 + y2).otherwise(y2))
            return y1 + (y2 - y1) * (t - a["ts"]) / (b["ts"] - a["ts"])

        if x.mode == "anchored":
            left = F.when(F.col("lo").isNotNull(), F.col("lo.value")).otherwise(first["value"])
            points = F.concat(F.array(point(F.col("low"), left)), F.col("w"))
        else:
            following, preceding = F.coalesce(first, F.col("hi")), F.coalesce(last, F.col("lo"))
            left = F.when(F.col("lo").isNull(), following["value"]).when(F.col("lo.ts") == F.col("low"), F.col("lo.value")).otherwise(between(F.col("lo"), following, F.col("low"), True))
            right = F.when(F.col("hi").isNull() | (preceding["ts"] == F.col("t")), preceding["value"]).otherwise(between(preceding, F.col("hi"), F.col("t"), False))
            points = F.concat(F.array(point(F.col("low"), left)), F.col("w"), F.array(point(F.col("t"), right)))
        df = df.withColumn("p", points)
        n = F.size("p")
        pairs = F.zip_with(F.slice("p", 1, n - 1), F.slice("p", 2, n), lambda a, b: F.struct(a["value"].alias("a"), b["value"].alias("b")))
        pairs = F.filter(pairs, lambda p: p["a"].isNotNull() & p["b"].isNotNull())
        add = lambda f: F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + f(p))
        if name == "changes":
            value = add(lambda p: F.when(p["a"] != p["b"], 1.0).otherwise(0.0))
        elif name == "resets":
            value = add(lambda p: F.when(p["b"] < p["a"], 1.0).otherwise(0.0))
        else:
            value = F.element_at("p", -1)["value"] - F.element_at("p", 1)["value"]
            if counter:
                value = value + add(lambda p: F.when(p["b"] < p["a"], p["a"]).otherwise(0.0))
            if name == "rate":
                value = value / (x.range / 1000)
        return _nameless(df.withColumn("value", value).select("labels", "series", "step", "value"))

    def instant(self, x: P.Selector) -> DataFrame:
        if x.mode:
            raise ValueError(f"{x.mode} modifier needs a range and a function over it")
        df = self.samples.where(matches(F.col("labels"), x.matchers)).select("labels", series_key(F.col("labels")).alias("series"), "ts", "value")
        out = self._rolled(df, self.lookback, x.offset, x.at, {"_a": F.max(_point())}, {"v": lambda over: over(F.max("_a"))})
        return out.select("labels", "series", "step", F.col("v.value").alias("value"), F.col("v.ts").alias("ts")).where("value IS NOT NULL")

    def over(self, x, name: str, keep_name: bool = False) -> DataFrame:
        if getattr(x, "mode", None):
            raise ValueError(f"{x.mode} modifier can only be used with rates, changes and resets")
        partial, final = _OVER[name]()
        df = self._rolled(*self._rows(x), partial, {"value": final}).drop("_t").where("value IS NOT NULL")
        return df if keep_name else _nameless(df)

    @staticmethod
    def _listed(name: str) -> tuple[dict, dict]:
        """Samples of a window in time order, from those of its panes."""
        return {"_a": F.collect_list(_point())}, {name: lambda over: F.sort_array(F.flatten(over(F.collect_list("_a"))))}

    def arrays(self, x) -> DataFrame:
        """w: the window's samples in time order; t: its end."""
        return self._rolled(*self._rows(x), *self._listed("w")).withColumnRenamed("_t", "t")

    # expressions

    def _note(self, x) -> None:
        """What can be said of a call or aggregate before it runs."""
        name, args = (x.op, (x.param, x.expr)) if isinstance(x, P.Aggregate) else (x.name, x.args)
        quantiles = {"quantile": args[:1], "quantile_over_time": args[:1], "histogram_quantile": args[:1], "histogram_quantiles": args[2:]}.get(name, ())
        for q in quantiles:
            if isinstance(q, P.Number) and not 0 <= q.value <= 1:
                self._say(f"PromQL warning: quantile value should be between 0 and 1, got {q.value:g}")
        if name == "limit_ratio" and isinstance(args[0], P.Number) and not -1 <= args[0].value <= 1:
            self._say(f"PromQL warning: ratio value should be between -1 and 1, got {args[0].value:g}, capping to {max(-1.0, min(1.0, args[0].value)):g}")
        if name in ("rate", "increase", "irate") and isinstance(args[0], P.Selector):
            metric = next((v for n, op, v in args[0].matchers if (n, op) == ("__name__", "=")), "")
            if metric and not metric.endswith(("_total", "_sum", "_count", "_bucket")):
                self._say(f'PromQL info: metric might not be a counter, name does not end in _total/_sum/_count/_bucket: "{metric}"')

    def _say(self, text: str) -> None:
        if text not in self.annotations:
            self.annotations.append(text)

    def eval(self, x):
        if isinstance(x, (P.Call, P.Aggregate)):
            self._note(x)
        if isinstance(x, P.Number):
            return Scalar(F.lit(x.value))
        if isinstance(x, P.Selector):
            return self.instant(x).drop("ts")
        if isinstance(x, P.Call):
            return self.call(x)
        if isinstance(x, P.Aggregate):
            return self.aggregate(x)
        if isinstance(x, P.Binary):
            return self.binary(x)
        raise ValueError(f"cannot evaluate {x}")

    def _map(self, x, f, drop: bool = True):
        v = self.eval(x)
        if isinstance(v, Scalar):
            return Scalar(f(v.column))
        if isinstance(v, PerStep):
            return PerStep(v.rows.withColumn("s", f(F.col("s")).cast("double")))
        v = v.withColumn("value", f(F.col("value")).cast("double"))
        return _nameless(v) if drop else v

    def _number(self, x) -> Column:
        v = self.eval(x)
        if not isinstance(v, Scalar):
            raise ValueError("a scalar is needed here")
        return v.column

    def call(self, x: P.Call):
        name, args = x.name, x.args
        if name in _MATH:
            return self._map(args[0], _MATH[name])
        if name in _DATE:
            return self._map(args[0], _DATE[name]) if args else Scalar(_DATE[name](F.col("step") / 1000).cast("double"))
        if name.endswith("_over_time"):
            return self.over_time(name.removesuffix("_over_time"), args)
        if name in ("rate", "increase", "delta", "irate", "idelta", "changes", "resets", "deriv", "predict_linear", "double_exponential_smoothing", "holt_winters"):
            return self.range_function(name, args)
        own = getattr(self, "fn_" + name, None)
        if own is None:
            raise ValueError(f"unknown function {name}")
        return own(*args)

    def over_time(self, name: str, args):
        if name == "quantile":
            df = self.arrays(args[1])
            return _nameless(df.withColumn("value", self._quantile_of(F.transform("w", lambda s: s["value"]), self._const(args[0]))).select("labels", "series", "step", "value"))
        if name == "absent":
            return self.fn_absent(args[0], self._rolled(*self._rows(args[0]), {}, {}))
        if name == "mad":
            df = self.arrays(args[0])
            med = lambda a: self._median(a)
            m = med(F.transform("w", lambda s: s["value"]))
            df = df.withColumn("m", m)
            df = df.withColumn("value", med(F.transform("w", lambda s: F.abs(s["value"] - F.col("m")))))
            return _nameless(df.select("labels", "series", "step", "value"))
        return self.over(args[0], name, keep_name=name in ("last", "first"))

    @staticmethod
    def _median(a: Column) -> Column:
        s = F.sort_array(a)
        n = F.size(s)
        return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2

    @classmethod
    def _quantile_of(cls, a: Column, q: float) -> Column:
        if q < 0 or q > 1 or math.isnan(q):
            return cls._quantile(q)
        s = F.sort_array(a)
        at = (F.size(s) - 1) * F.lit(q)
        low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
        return F.when(low == high, F.get(s, low)).otherwise((high - at) * F.get(s, low) + (at - low) * F.get(s, high))

    def _const(self, x) -> float:
        if isinstance(x, P.Binary):
            a, b = self._const(x.left), self._const(x.right)
            return {"+": a + b, "-": a - b, "*": a * b, "/": a / b if b else math.nan}[x.op]
        return x.value

    @staticmethod
    def _quantile(q: float) -> Column:
        if q < 0 or q > 1 or math.isnan(q):
            return F.lit(math.nan if math.isnan(q) else (-math.inf if q < 0 else math.inf))
        return F.percentile(F.col("value"), F.lit(q))

    def range_function(self, name: str, args) -> DataFrame:
        x = args[0]
        if getattr(x, "mode", None):
            return self.extended_function(name, x)
        if name in ("rate", "increase", "delta", "irate", "idelta", "changes", "resets"):
            # A series has one sample of a value at a time: one that comes again adds nothing.
            df = self._rolled(*self._rows(x), {"_a": F.collect_set(_point())}, {"c": lambda over: _course_of_panes(over(F.collect_list("_a")))}, _course).withColumn("t", F.col("_t"))
            c = F.col("c")
            if name in ("irate", "idelta"):
                value = c["v1"] - c["before"]["value"]
                if name == "irate":
                    value = _div(F.when(c["v1"] < c["before"]["value"], c["v1"]).otherwise(value), (c["t1"] - c["before"]["ts"]) / 1000)
                value = F.when(c["n"] >= 2, value)
            elif name in ("changes", "resets"):
                value = c["moves" if name == "changes" else "falls"]
            else:
                first, last = {"ts": c["t0"], "value": c["v0"]}, {"ts": c["t1"], "value": c["v1"]}
                value = F.when(c["n"] >= 2, self._extrapolated(name, x.range, c["drops"], first, last, c["n"]))
            return _nameless(df.withColumn("value", value).where("value IS NOT NULL").select("labels", "series", "step", "value"))
        if name in ("deriv", "predict_linear"):
            df = self._rolled(*self._rows(x), *_line_of(self.start))
            m = F.col("m")
            slope = m["xy"] / F.nullif(m["xx"], F.lit(0.0))
            value = F.when(m["n"] >= 2, slope if name == "deriv" else slope * self._number(args[1]) + m["y"] + slope * ((F.col("_t") - self.start) / 1000 - m["x"]))
        else:
            df = self.arrays(x)
            w, n = F.col("w"), F.size("w")
            sf, tf = self._number(args[1]), self._number(args[2])
            v = F.transform(w, lambda s: s["value"])
            start = F.struct(F.get(v, F.lit(0)).alias("s"), (F.get(v, F.lit(1)) - F.get(v, F.lit(0))).alias("b"))
            step = lambda acc, y: F.struct((sf * y + (1 - sf) * (acc["s"] + acc["b"])).alias("s"), (tf * (sf * y + (1 - sf) * (acc["s"] + acc["b"]) - acc["s"]) + (1 - tf) * acc["b"]).alias("b"))
            value = F.when(n >= 2, F.aggregate(F.slice(v, 2, F.greatest(n, F.lit(1))), start, step, lambda acc: acc["s"]))
        return _nameless(df.withColumn("value", value).where("value IS NOT NULL").select("labels", "series", "step", "value"))

    def _extrapolated(self, name: str, span: int, drops: Column, first: dict[str, Column], last: dict[str, Column], n: Column) -> Column:
        """Change over the window, carried to its ends unless they are more than 1.1 mean gaps away; counters stop at zero."""
        counter = name != "delta"
        change = last["value"] - first["value"]
        if counter:
            change = change + drops
        sampled = (last["ts"] - first["ts"]) / 1000
        gap = sampled / (n - 1)
        to_start, to_end = (first["ts"] - (F.col("t") - span)) / 1000, (F.col("t") - last["ts"]) / 1000
        to_start = F.when(to_start >= gap * 1.1, gap / 2).otherwise(to_start)
        if counter:
            zero = sampled * first["value"] / F.nullif(change, F.lit(0.0))
            to_start = F.when((change > 0) & (first["value"] >= 0) & (zero < to_start), zero).otherwise(to_start)
        to_end = F.when(to_end >= gap * 1.1, gap / 2).otherwise(to_end)
        out = change * _div(sampled + to_start + to_end, sampled)
        return out / (span / 1000) if name == "rate" else out

    # functions of their own

    def fn_time(self):
        return Scalar(F.col("step") / 1000)

    def fn_pi(self):
        return Scalar(F.lit(math.pi))

    def fn_step(self):
        return Scalar(F.lit(self.step / 1000))

    def fn_range(self):
        return Scalar(F.lit((self.end - self.start) / 1000))

    def fn_vector(self, x):
        own = self.eval(x)
        if isinstance(own, PerStep):
            return self._vector(own)
        df = self.grid().withColumn("value", self._number(x).cast("double"))
        return df.select(F.create_map().cast("map<string,string>").alias("labels"), F.lit("").alias("series"), "step", "value")

    def fn_scalar(self, x):
        """The value where a step has exactly one series, else NaN."""
        one = self.eval(x).groupBy("step").agg(F.when(F.count("*") == 1, F.first("value")).alias("s"))
        return PerStep(self.grid().join(one, "step", "left").select("step", _nan(F.col("s")).alias("s")))

    def fn_timestamp(self, x):
        if isinstance(x, P.Selector):
            return _nameless(self.instant(x).withColumn("value", F.col("ts") / 1000).drop("ts"))
        return self._map(x, lambda v: F.col("step") / 1000)

    def fn_min_of(self, a, b):
        return Scalar(F.least(self._number(a), self._number(b)))

    def fn_max_of(self, a, b):
        return Scalar(F.greatest(self._number(a), self._number(b)))

    def fn_clamp(self, x, lo, hi):
        return self._map(x, lambda v: F.greatest(self._number(lo), F.least(self._number(hi), v)))

    def fn_clamp_min(self, x, lo):
        return self._map(x, lambda v: F.greatest(self._number(lo), v))

    def fn_clamp_max(self, x, hi):
        return self._map(x, lambda v: F.least(self._number(hi), v))

    def fn_round(self, x, to=P.Number(1.0)):
        to = self._const(to)
        return self._map(x, lambda v: F.floor(v * (1 / to) + 0.5) / (1 / to))

    def fn_sort(self, x):
        return self.eval(x)

    fn_sort_desc = fn_sort

    def fn_sort_by_label(self, x, *names):
        return self.eval(x)

    fn_sort_by_label_desc = fn_sort_by_label

    def fn_label_replace(self, x, dst, to, src, pattern):
        old = F.coalesce(F.try_element_at("labels", F.lit(src.value)), F.lit(""))
        import re

        whole = f"^(?s:{pattern.value})$"
        new = F.regexp_replace(old, whole, re.sub(r"\$\{(\w+)\}", r"$\1", to.value))
        labels = F.map_filter(F.map_concat(_less(F.col("labels"), [dst.value]), F.create_map(F.lit(dst.value), new)), lambda k, v: v != "")
        return _relabel(self.eval(x), F.when(old.rlike(whole), labels).otherwise(F.col("labels")))

    def fn_label_join(self, x, dst, sep, *sources):
        new = F.concat_ws(sep.value, *[F.coalesce(F.try_element_at("labels", F.lit(s.value)), F.lit("")) for s in sources])
        return _relabel(self.eval(x), F.map_filter(F.map_concat(_less(F.col("labels"), [dst.value]), F.create_map(F.lit(dst.value), new)), lambda k, v: v != ""))

    def fn_absent(self, x, found=None):
        found = (self.eval(x) if found is None else found).select("step").distinct()
        keep = {n: v for n, op, v in getattr(x, "matchers", ()) if op == "=" and n != "__name__"}
        labels = F.create_map(*[F.lit(y) for kv in keep.items() for y in kv]).cast("map<string,string>")
        df = self.grid().join(found, "step", "left_anti").withColumn("value", F.lit(1.0)).withColumn("labels", labels)
        return df.withColumn("series", series_key(F.col("labels")))

    def fn_histogram_quantile(self, q, x):
        q = self._number(q)
        df = self.eval(x).withColumn("le", F.try_element_at("labels", F.lit("le")))
        le = F.when(F.col("le").isin("+Inf", "Inf"), F.lit(float("inf"))).otherwise(F.col("le").try_cast("double"))
        df = df.withColumn("le", le).where("le IS NOT NULL")
        df = _relabel(df, _less(F.col("labels"), ["le", *META]))
        df = df.groupBy("series", "step").agg(F.first("labels").alias("labels"), F.sort_array(F.collect_list(F.struct("le", "value"))).alias("b"))
        # Counts are made monotonic, then the bucket of the rank is found and interpolated.
        rise = F.aggregate("b", F.struct(F.lit(0.0).alias("m"), F.slice(F.col("b"), 1, 0).alias("out")), lambda acc, e: F.struct(F.greatest(acc["m"], e["value"]).alias("m"), F.concat(acc["out"], F.array(F.struct(e["le"].alias("le"), F.greatest(acc["m"], e["value"]).alias("value")))).alias("out")), lambda acc: acc["out"])
        df = df.withColumn("b", rise).withColumn("total", F.element_at("b", -1)["value"]).withColumn("rank", q * F.col("total"))
        at = F.size(F.filter("b", lambda e: e["value"] < F.col("rank")))
        df = df.withColumn("at", F.least(at, F.size("b") - 1))
        hi, lo = F.get(F.col("b"), F.col("at")), F.when(F.col("at") > 0, F.get(F.col("b"), F.col("at") - 1))
        low, count = F.when(F.col("at") > 0, lo["le"]).otherwise(F.lit(0.0)), F.coalesce(lo["value"], F.lit(0.0))
        inside = low + (hi["le"] - low) * _div(F.col("rank") - count, hi["value"] - count)
        last = F.get(F.col("b"), F.size("b") - 2)["le"]
        value = (F.when((F.size("b") < 2) | (F.element_at("b", -1)["le"] != float("inf")) | (F.col("total") == 0), F.lit(float("nan"))).when(q < 0, F.lit(float("-inf"))).when(q > 1, F.lit(float("inf")))
                 .when(F.col("at") == F.size("b") - 1, last).when((F.col("at") == 0) & (hi["le"] <= 0), hi["le"]).otherwise(inside))
        return df.select("labels", "series", "step", value.alias("value"))

    def fn_histogram_quantiles(self, x, label, *qs):
        """A series for each quantile, told apart by a label."""
        out = None
        for q in qs:
            part = self.fn_histogram_quantile(q, x)
            text = f"{self._const(q):g}"
            part = _relabel(part, F.map_concat(_less(F.col("labels"), [label.value]), F.create_map(F.lit(label.value), F.lit(text)))).select("labels", "series", "step", "value")
            out = part if out is None else out.unionByName(part)
        return out

    def fn_histogram_fraction(self, lower, upper, x):
        """Share of observations between the bounds, with counts interpolated inside classic buckets."""
        lower, upper = self._number(lower), self._number(upper)
        df = self.eval(x).withColumn("le", F.try_element_at("labels", F.lit("le")))
        le = F.when(F.col("le").isin("+Inf", "Inf"), F.lit(math.inf)).otherwise(F.col("le").try_cast("double"))
        df = df.withColumn("le", le).where("le IS NOT NULL")
        df = _relabel(df, _less(F.col("labels"), ["le", *META]))
        df = df.groupBy("series", "step").agg(F.first("labels").alias("labels"), F.sort_array(F.collect_list(F.struct("le", "value"))).alias("b"))
        df = df.withColumn("total", F.element_at("b", -1)["value"])

        def rank(bound: Column) -> Column:
            at = F.size(F.filter("b", lambda e: e["le"] < bound))
            hi, lo = F.get(F.col("b"), at), F.when(at > 0, F.get(F.col("b"), at - 1))
            low = F.when(at > 0, lo["le"]).otherwise(F.when(hi["le"] > 0, 0.0).otherwise(F.lit(-math.inf)))
            count = F.coalesce(lo["value"], F.lit(0.0))
            inside = count + (hi["value"] - count) * _div(bound - low, hi["le"] - low)
            return F.when(bound == math.inf, F.col("total")).when((at == 0) & (bound <= low), 0.0).when(hi["le"] == bound, hi["value"]).when(hi["le"] == math.inf, count).otherwise(inside)

        value = F.when((F.col("total") == 0) | F.isnan(lower) | F.isnan(upper) | (F.element_at("b", -1)["le"] != math.inf), F.lit(math.nan)).when(lower >= upper, 0.0).otherwise((rank(upper) - rank(lower)) / F.col("total"))
        return df.select("labels", "series", "step", value.alias("value"))

    def fn_info(self, x, selector=None):
        """Labels of the latest *_info series with the same job and instance."""
        name = (("__name__", "=", "target_info"),)
        info = self.instant(selector if selector is not None and any(n == "__name__" for n, _, _ in selector.matchers) else P.Selector(name + (selector.matchers if selector else ())))
        key = lambda: [F.coalesce(F.try_element_at("labels", F.lit(k)), F.lit("")) for k in ("job", "instance")]
        info = info.select(*[c.alias(n) for c, n in zip(key(), ("_j", "_i"))], "step", F.col("labels").alias("more"), "ts").groupBy("_j", "_i", "step").agg(F.max_by("more", "ts").alias("more"))
        out = self.eval(x).withColumns(dict(zip(("_j", "_i"), key()))).join(info, ["_j", "_i", "step"], "left")
        extra = F.map_filter(F.coalesce("more", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys("labels"), k) & (k != "__name__"))
        return _relabel(out, F.map_concat("labels", extra)).select("labels", "series", "step", "value")

    # aggregation and binary operators

    @staticmethod
    def _group(x: P.Aggregate, labels: Column) -> Column:
        if x.by is not None:
            return _only(labels, x.by)
        return _less(labels, [*x.without, *META]) if x.without is not None else F.create_map().cast("map<string,string>")

    def grouped(self, x: P.Aggregate) -> DataFrame:
        """The rows of an aggregate's expression with the labels g of their group, and gk, their text."""
        return self.eval(x.expr).withColumn("g", self._group(x, F.col("labels"))).withColumn("gk", series_key(F.col("g")))

    def _over_groups(self, x: P.Aggregate) -> DataFrame | None:
        """A sum of sums over time, and so for min and max: the samples of a group are one series from the start, however
        many series it has."""
        call = x.expr
        if x.op not in ("sum", "min", "max") or not isinstance(call, P.Call) or call.name != f"{x.op}_over_time" or getattr(call.args[0], "mode", None):
            return None
        df, *window = self._rows(call.args[0])
        df = _relabel(df, self._group(x, _less(F.col("labels"), META)))
        partial, final = _OVER[x.op]()
        return self._rolled(df, *window, partial, {"value": final}).where("value IS NOT NULL").select("labels", "series", "step", "value")

    def aggregate(self, x: P.Aggregate) -> DataFrame:
        own = self._over_groups(x)
        if own is not None:
            return own
        v = self.grouped(x)
        op = x.op
        if op in ("topk", "bottomk", "limitk"):
            order = {"topk": [F.isnan("value"), F.col("value").desc()], "bottomk": [F.isnan("value"), F.col("value")], "limitk": [F.xxhash64("series")]}[op]
            n = F.row_number().over(W.partitionBy("gk", "step").orderBy(*order, "series"))
            return v.withColumn("n", n).where(F.col("n") <= self._number(x.param)).select("labels", "series", "step", "value")
        if op == "limit_ratio":
            r = self._const(x.param)
            place = F.pmod(F.xxhash64("series"), F.lit(1_000_000)) / 1_000_000
            return v.where(place < r if r >= 0 else place >= 1 + r).select("labels", "series", "step", "value")
        if op == "count_values":
            text = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
            v = v.withColumn("g", F.map_concat(_less(F.col("g"), [x.param.value]), F.create_map(F.lit(x.param.value), text))).withColumn("gk", series_key(F.col("g")))
        value = {"sum": lambda: F.sum(_value()), "avg": lambda: F.avg(_value()), "count": lambda: F.count("*"), "count_values": lambda: F.count("*"), "min": lambda: _nan(F.min(_numbers())), "max": lambda: _nan(F.max(_numbers())), "stddev": lambda: F.stddev_pop(_value()), "stdvar": lambda: F.var_pop(_value()), "group": lambda: F.lit(1.0), "quantile": lambda: self._quantile(self._const(x.param))}[op]()
        return v.groupBy("gk", "step").agg(F.first("g").alias("labels"), value.cast("double").alias("value")).withColumnRenamed("gk", "series").select("labels", "series", "step", "value")

    def _with_steps(self, x: P.Binary, a, b):
        """An operator with numbers that come from data on one side or both."""
        op = _ARITHMETIC.get(x.op) or (lambda l, r: _COMPARE[x.op](l, r).cast("int").cast("double"))
        if not isinstance(a, DataFrame) and not isinstance(b, DataFrame):
            rows = a.rows if isinstance(a, PerStep) else b.rows
            if isinstance(a, PerStep) and isinstance(b, PerStep):
                rows = rows.join(b.rows.withColumnRenamed("s", "s2"), "step")
            left = F.col("s") if isinstance(a, PerStep) else a.column
            right = b.column if isinstance(b, Scalar) else F.col("s2" if isinstance(a, PerStep) else "s")
            return PerStep(rows.select("step", op(left, right).cast("double").alias("s")))
        v, rows = (a, b.rows) if isinstance(a, DataFrame) else (b, a.rows)
        v = v.join(rows, "step")
        left, right = (F.col("value"), F.col("s")) if isinstance(a, DataFrame) else (F.col("s"), F.col("value"))
        if x.op in _ARITHMETIC or x.bool_:
            return _nameless(v.withColumn("value", op(left, right).cast("double"))).drop("s")
        return v.where(_COMPARE[x.op](left, right)).drop("s")

    def binary(self, x: P.Binary):
        a, b = self.eval(x.left), self.eval(x.right)
        if isinstance(a, PerStep) or isinstance(b, PerStep):
            return self._with_steps(x, a, b)
        if isinstance(a, Scalar) and isinstance(b, Scalar):
            return Scalar(_ARITHMETIC[x.op](a.column, b.column) if x.op in _ARITHMETIC else _COMPARE[x.op](a.column, b.column).cast("int").cast("double"))
        if isinstance(a, Scalar) or isinstance(b, Scalar):
            v = b if isinstance(a, Scalar) else a
            left = a.column if isinstance(a, Scalar) else F.col("value")
            right = b.column if isinstance(b, Scalar) else F.col("value")
            if x.op in _ARITHMETIC:
                return _nameless(v.withColumn("value", _ARITHMETIC[x.op](left, right).cast("double")))
            test = _COMPARE[x.op](left, right)
            return _nameless(v.withColumn("value", test.cast("int").cast("double"))) if x.bool_ else v.where(test)
        match = lambda: _only(F.col("labels"), x.on) if x.on is not None else _less(F.col("labels"), [*(x.ignoring or ()), *META])
        a, b = (v.withColumn("m", series_key(match())) for v in (a, b))
        if x.op == "and":
            return a.join(b.select("m", "step").distinct(), ["m", "step"], "left_semi").drop("m")
        if x.op == "unless":
            return a.join(b.select("m", "step").distinct(), ["m", "step"], "left_anti").drop("m")
        if x.op == "or":
            more = b.join(a.select("m", "step").distinct(), ["m", "step"], "left_anti")
            return a.unionByName(more).drop("m")
        one = b.withColumnsRenamed({"labels": "labels2", "series": "series2", "value": "value2"}) if x.group != "group_right" else a.withColumnsRenamed({"labels": "labels2", "series": "series2", "value": "value2"})
        many = b if x.group == "group_right" else a
        single = lambda v, c: v.groupBy("m", "step").agg(F.when(F.count("*") > 1, F.raise_error(F.lit("many-to-many matching: more than one series of one side matches"))).otherwise(F.first(F.struct(*c))).alias("s")).select("m", "step", "s.*")
        one = single(one, ["labels2", "value2"])
        if x.group is None:
            many = single(many, ["labels", "value"])
        j = many.join(one, ["m", "step"])
        left, right = (F.col("value2"), F.col("value")) if x.group == "group_right" else (F.col("value"), F.col("value2"))
        if x.group:
            extra = _only(F.col("labels2"), x.include) if x.include else F.create_map().cast("map<string,string>")
            labels = F.map_concat(_less(F.col("labels"), [*META, *x.include] if x.op in _ARITHMETIC or x.bool_ else list(x.include)), extra)
        elif x.op in _ARITHMETIC or x.bool_:
            labels = match()
        else:
            labels = F.col("labels")
        if x.op in _ARITHMETIC:
            j = j.withColumn("value", _ARITHMETIC[x.op](left, right))
        elif x.bool_:
            j = j.withColumn("value", _COMPARE[x.op](left, right).cast("int").cast("double"))
        else:
            j = j.where(_COMPARE[x.op](left, right)).withColumn("value", left)
        return _relabel(j, labels).select("labels", "series", "step", "value")
