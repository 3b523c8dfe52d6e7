"""The log query language on DataFrames.

Rows have labels (map), ts (ns) and line. A stream selector and its pipeline become
filters and map expressions in one projection. A range aggregation becomes samples
of the metric engine (one for each line or unwrapped value), so vector aggregation,
matching and arithmetic are the metric language's own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans import promql_parser as P
from millrace.plans.promql import Engine, matches

_TOKEN = re.compile(r"\s+|(?P<str>\"(?:[^\"\\]|\\.)*\"|`[^`]*`)|(?P<num>\d+(?:\.\d+)?(?:ns|us|ms|s|m|h|d|[KMGT]i?B|B|b)?)|(?P<id>[A-Za-z_]\w*)|(?P<op>\|=|!=|\|~|!~|\|>|!>|==|=~|>=|<=|[|{}(),=<>.])")
_DURATION = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0}
_BYTES = {"B": 1, "b": 1, "KB": 1e3, "MB": 1e6, "GB": 1e9, "TB": 1e12, "KiB": 1024, "MiB": 1 << 20, "GiB": 1 << 30, "TiB": 1 << 40}
RANGES = ("rate", "count_over_time", "bytes_rate", "bytes_over_time", "sum_over_time", "avg_over_time", "min_over_time", "max_over_time", "stddev_over_time", "stdvar_over_time", "quantile_over_time", "first_over_time", "last_over_time", "absent_over_time")


def _unit(x: Column, units: dict[str, float]) -> Column:
    """A number with a unit in base units, null if it is none."""
    part = F.regexp_extract(x, r"^\s*(-?[0-9.]+)\s*([A-Za-z]*)$", 1).try_cast("double")
    name = F.regexp_extract(x, r"^\s*(-?[0-9.]+)\s*([A-Za-z]*)$", 2)
    scale = F.lit(None).cast("double")
    for u, f in units.items():
        scale = F.when(name == u, F.lit(float(f))).otherwise(scale)
    return part * scale


def seconds(x: Column) -> Column:
    """Seconds of a duration such as 1h2m3.5s, null if it is none."""
    part = F.lit(r"([0-9.]+)(ns|us|ms|h|m|s|d)")
    scale = F.create_map(*[F.lit(y) for kv in _DURATION.items() for y in kv])
    each = F.zip_with(F.regexp_extract_all(x, part, F.lit(1)), F.regexp_extract_all(x, part, F.lit(2)), lambda n, u: n.try_cast("double") * F.try_element_at(scale, u))
    return F.when(x.rlike(r"^([0-9.]+(ns|us|ms|h|m|s|d))+$"), F.aggregate(each, F.lit(0.0), lambda acc, v: acc + v))


def size(x: Column) -> Column:
    return _unit(x, _BYTES)


def _merge(labels: Column, new: Column) -> Column:
    """Labels and extracted ones; a clash keeps the stream's and adds name_extracted."""
    fresh = F.transform_keys(new, lambda k, v: F.when(F.array_contains(F.map_keys(labels), k), F.concat(k, F.lit("_extracted"))).otherwise(k))
    return F.map_concat(labels, F.map_filter(fresh, lambda k, v: ~F.array_contains(F.map_keys(labels), k)))


class Pipeline:
    """Parses a selector with its pipeline and applies it."""

    def __init__(self, text: str):
        self.t, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at:]!r}")
            at = m.end()
            if m.lastgroup:
                self.t.append((m.lastgroup, m[0]))
        self.k = 0
        self.unwrap: str | None = None

    def peek(self, n: int = 0) -> str:
        return self.t[self.k + n][1] if self.k + n < len(self.t) else ""

    def take(self) -> str:
        self.k += 1
        return self.t[self.k - 1][1]

    def text(self) -> str:
        return P._plain(self.take())

    def run(self, rows: DataFrame) -> DataFrame:
        if self.take() != "{":
            raise ValueError("a stream selector must come first")
        test = []
        while self.peek() != "}":
            name, op = self.take(), self.take()
            test.append((name, op, self.text()))
            if self.peek() == ",":
                self.take()
        self.take()
        df = rows.where(matches(F.col("labels"), test))
        while self.k < len(self.t):
            df = self.stage(df)
        return df

    def stage(self, df: DataFrame) -> DataFrame:
        op = self.take()
        line = F.col("line")
        if op in ("|=", "!=", "|~", "!~", "|>", "!>"):
            if self.peek() == "ip":
                self.take(), self.take()
                want = self.text()
                self.take()
                hit = self._ip(line, want)
            else:
                want = self.text()
                hit = line.contains(want) if op[1] == "=" else line.rlike(self._pattern(want, False)[0] if op[1] == ">" else want)
            return df.where(~hit if op[0] == "!" else hit)
        word = self.take()
        labels = F.col("labels")
        if word == "json":
            found = F.map_filter(F.from_json(line, "map<string,string>"), lambda k, v: v.isNotNull())
            if self.t[self.k : self.k + 1] and self.t[self.k][0] == "id":
                pairs = []
                while True:
                    name = self.take()
                    self.take()
                    pairs += [F.lit(name), F.coalesce(F.get_json_object(line, "$." + self.text()), F.lit(""))]
                    if self.peek() != ",":
                        break
                    self.take()
                found = F.create_map(*pairs)
            return self._once(df, F.when(found.isNotNull(), _merge(labels, found)).otherwise(labels))
        if word == "logfmt":
            pair = F.lit(r'([A-Za-z_][\w.]*)=("[^"]*"|\S*)')
            names = F.regexp_extract_all(line, pair, F.lit(1))
            values = F.transform(F.regexp_extract_all(line, pair, F.lit(2)), lambda v: F.when(v.contains('"'), F.regexp_replace(v, '^"|"$', "")).otherwise(v))
            last = lambda n: F.element_at(F.filter(F.zip_with(names, values, lambda k, v: F.struct(k.alias("k"), v.alias("v"))), lambda e: e["k"] == n), -1)["v"]
            again = F.map_from_arrays(F.array_distinct(names), F.transform(F.array_distinct(names), last))
            found = F.when(F.size(F.array_distinct(names)) == F.size(names), F.map_from_arrays(names, values)).otherwise(again)
            return self._once(df, _merge(labels, found))
        if word in ("regexp", "pattern"):
            want, names = self._pattern(self.text(), word == "regexp")
            found = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.regexp_extract(line, want, i + 1))])
            return df.withColumn("labels", F.when(line.rlike(want), _merge(labels, found)).otherwise(labels))
        if word == "line_format":
            return df.withColumn("line", self._template(self.text()))
        if word == "label_format":
            while True:
                dst = self.take()
                self.take()
                new = self._template(self.text()) if self.t[self.k][0] == "str" else None
                drop = [dst]
                if new is None:
                    src = self.take()
                    new, drop = F.coalesce(F.try_element_at(labels, F.lit(src)), F.lit("")), [dst, src]
                df = df.withColumn("labels", F.map_concat(F.map_filter(labels, lambda k, v: ~k.isin(drop)), F.create_map(F.lit(dst), new)))
                if self.peek() != ",":
                    return df
                self.take()
        if word in ("keep", "drop"):
            names = [self.take()]
            while self.peek() == ",":
                self.take()
                names.append(self.take())
            return df.withColumn("labels", F.map_filter(labels, lambda k, v: k.isin(names) if word == "keep" else ~k.isin(names)))
        if word == "unwrap":
            name, read = self.take(), lambda x: x.try_cast("double")
            if name in ("duration", "duration_seconds", "bytes") and self.peek() == "(":
                read = size if name == "bytes" else seconds
                self.take()
                name = self.take()
                self.take()
            self.unwrap = name
            return df.withColumn("value", read(F.try_element_at(labels, F.lit(name)))).where("value IS NOT NULL").withColumn("labels", F.map_filter(labels, lambda k, v: k != name))
        self.k -= 1
        return df.where(self.either())

    @staticmethod
    def _once(df: DataFrame, labels: Column) -> DataFrame:
        """New labels that a line is parsed for once: a projection would be repeated in each filter that is pushed below it."""
        return df.select(*[c for c in df.columns if c != "labels"], F.explode(F.array(labels)).alias("labels"))

    def either(self) -> Column:
        out = self.both()
        while self.peek() == "or":
            self.take()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.test()
        while self.peek() in ("and", ","):
            self.take()
            out = out & self.test()
        return out

    def test(self) -> Column:
        if self.peek() == "(":
            self.take()
            out = self.either()
            self.take()
            return out
        have = F.coalesce(F.try_element_at(F.col("labels"), F.lit(self.take())), F.lit(""))
        op = self.take()
        if self.t[self.k][0] == "str":
            want = self.text()
            hit = have.rlike(f"^(?s:{want})$") if "~" in op else have == want
            return ~hit if op.startswith("!") else hit
        m = re.fullmatch(r"([\d.]+)([A-Za-z]*)", self.take())
        unit = m[2]
        number = float(m[1]) * (_DURATION.get(unit) or _BYTES.get(unit) or 1)
        x = seconds(have) if unit in _DURATION else size(have) if unit in _BYTES else have.try_cast("double")
        hit = {"=": x == number, "==": x == number, "!=": x != number, ">": x > number, ">=": x >= number, "<": x < number, "<=": x <= number}[op]
        return F.coalesce(hit, F.lit(False))

    @staticmethod
    def _pattern(text: str, is_regexp: bool) -> tuple[str, list[str]]:
        if is_regexp:
            return re.sub(r"\(\?P<\w+>", "(", text), re.findall(r"\(\?P<(\w+)>", text)
        names = [n for n in re.findall(r"<(\w+)>", text) if n != "_"]
        parts = re.split(r"(<\w+>)", text)
        return "^" + "".join(re.escape(p) if not re.fullmatch(r"<\w+>", p) else (".*?" if p == "<_>" else "(.*?)") for p in parts) + "$", names

    @staticmethod
    def _ip(line: Column, want: str) -> Column:
        """The line holds an IPv4 address of an address, a network or a range a-b."""
        import ipaddress

        if "-" in want:
            low, high = (int(ipaddress.IPv4Address(x.strip())) for x in want.split("-"))
        else:
            net = ipaddress.IPv4Network(want, strict=False)
            low, high = int(net.network_address), int(net.broadcast_address)
        octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
        found = F.regexp_extract_all(line, F.lit(r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"), F.lit(1))
        number = lambda x: F.aggregate(F.split(x, r"\."), F.lit(0).cast("long"), lambda n, o: n * 256 + o.cast("long"))
        return F.exists(F.filter(found, lambda x: x.rlike(rf"^{octet}(\.{octet}){{3}}$")), lambda x: number(x).between(low, high))

    @staticmethod
    def _template(text: str) -> Column:
        """{{.name}} and {{ .name | upper }}-like one-step templates."""
        steps = {"ToUpper": F.upper, "ToLower": F.lower, "upper": F.upper, "lower": F.lower, "trim": F.trim}
        out = []
        for part in re.split(r"(\{\{.*?\}\})", text):
            m = re.fullmatch(r"\{\{\s*(?:(\w+)\s+)?\.(\w+)\s*(?:\|\s*(\w+)\s*)?\}\}", part)
            if not m:
                out.append(F.lit(part))
                continue
            value = F.col("line") if m[2] == "__line__" else F.coalesce(F.try_element_at(F.col("labels"), F.lit(m[2])), F.lit(""))
            f = steps.get(m[1] or m[3] or "")
            out.append(f(value) if f else value)
        return F.concat(*out)


def logs(rows: DataFrame, text: str) -> DataFrame:
    """Lines of a log query."""
    return Pipeline(text).run(rows).select("labels", "ts", "line")


def _inner(text: str, at: int) -> int:
    """Where the bracket opened before ``at`` closes, strings aside."""
    depth, k = 1, at
    while depth:
        if text[k] in "\"`":
            q = text[k]
            k += 1
            while text[k] != q:
                k += 2 if text[k] == "\\" else 1
        depth += (text[k] == "(") - (text[k] == ")")
        k += 1
    return k - 1


def metric(rows: DataFrame, text: str, start: int, end: int, step: int) -> DataFrame:
    """labels, step (ms), value of a metric query over log rows."""
    parts, out, at, n = [], "", 0, 0
    for m in re.finditer(r"\b(" + "|".join(RANGES) + r")\s*\(", text):
        if m.start() < at:
            continue
        z = _inner(text, m.end())
        body = text[m.end() : z]
        lead = re.match(r"\s*([\d.]+)\s*,", body)
        body = body[lead.end() :] if lead else body
        span = re.search(r"\[([^\]]+)\]", body)
        rest = body[span.end() :].strip()
        offset = re.match(r"offset\s+(\w+)", rest)
        after = rest[offset.end() :] if offset else rest
        p = Pipeline(body[: span.start()] + " " + after)
        df = p.run(rows)
        f = m[1]
        if p.unwrap is None:
            df = df.withColumn("value", F.octet_length("line").cast("double") if f.startswith("bytes") else F.lit(1.0))
        parts.append(df.select(F.map_concat("labels", F.create_map(F.lit("__name__"), F.lit(f"lr{n}"))).alias("labels"), F.floor(F.col("ts") / 1_000_000).cast("long").alias("ts"), "value"))
        src = f"lr{n}[{span[1]}]" + (f" offset {offset[1]}" if offset else "")
        secs = P.duration(span[1]) / 1000
        new = {"rate": f"(sum_over_time({src}) / {secs})", "count_over_time": f"count_over_time({src})", "bytes_rate": f"(sum_over_time({src}) / {secs})", "bytes_over_time": f"sum_over_time({src})", "quantile_over_time": f"quantile_over_time({lead[1] if lead else 0}, {src})"}.get(f, f"{f}({src})")
        out, at, n = out + text[at : m.start()] + new, z + 1, n + 1
    samples = parts[0]
    for p in parts[1:]:
        samples = samples.unionByName(p)
    return Engine(samples, start, end, step).query(out + text[at:])
