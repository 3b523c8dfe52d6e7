"""The trace query language on span rows.

Spans have trace_id, span_id, parent_id, name, service, kind, status (strings),
start and duration (ns), attrs and resource (maps of strings), and the nested set
(lft, rgt, parent number). A structural operator is an equi-join on the trace with a
condition on the nested set or the parent, and its result are the right-hand spans
(with & both sides'), so the work of one trace stays together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s+|(?P<str>\"(?:[^\"\\]|\\.)*\"|`[^`]*`)|(?P<num>-?\d+(?:\.\d+)?(?:ns|us|ms|s|m|h)?)|(?P<id>[A-Za-z_.][\w.:/-]*)|(?P<op>&>>|&<<|!>>|!<<|&&|\|\||&>|&<|&~|!>|!<|!~|>>|<<|>=|<=|!=|=~|[|{}(),=<>~!+*/%-])")
_NS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
_INTRINSIC = {
    "name": "name", "duration": "duration", "kind": "kind", "status": "status", "statusMessage": "status_message", "childCount": "child_count", "nestedSetLeft": "lft", "nestedSetRight": "rgt", "nestedSetParent": "parent",
    "traceDuration": "trace_duration", "rootName": "root_name", "rootServiceName": "root_service", "span:id": "span_id", "span:parentID": "parent_id", "span:name": "name", "span:duration": "duration", "span:kind": "kind", "span:status": "status", "span:statusMessage": "status_message",
    "span:childCount": "child_count", "trace:id": "trace_id", "trace:duration": "trace_duration", "trace:rootName": "root_name", "trace:rootService": "root_service", "instrumentation:name": "scope", "instrumentation:version": "scope_version",
}
#: Intrinsics that a table of spans may lack; they are null there.
_OPTIONAL = {"status_message", "scope", "scope_version"}
_STRUCTURAL = {">>", "<<", ">", "<", "~", "!>>", "!<<", "!>", "!<", "!~", "&>>", "&<<", "&>", "&<", "&~"}


def _preorder(spans: list, parents: list) -> tuple[list[int], list[int], list[int]]:
    """lft, rgt, parent of the spans of one trace, which come in order of start."""
    at = {s: i for i, s in enumerate(spans)}
    children: dict[int, list[int]] = {}
    roots = []
    for i, p in enumerate(parents):
        if p is not None and at.get(p, i) != i:
            children.setdefault(at[p], []).append(i)
        else:
            roots.append(i)
    size = len(spans)
    lft, rgt, up, n = [0] * size, [0] * size, [-1] * size, 0
    for root in [*roots, *range(size)]:
        stack = [] if lft[root] else [(root, -1)]
        while stack:
            i, p = stack.pop()
            if i < 0:
                n += 1
                rgt[~i] = n
            elif not lft[i]:
                n += 1
                lft[i], up[i] = n, p
                stack.append((~i, 0))
                stack += [(c, n) for c in reversed(children.get(i, ()))]
    return lft, rgt, up


def nested_sets(spans: DataFrame) -> DataFrame:
    """lft, rgt, parent of each span by preorder of its trace; roots have parent -1, cycles are cut at their first span.

    Traces are dealt by id and sorted once; a task streams over them and holds one
    batch and one trace, so a giant trace is the work and the memory of one task.
    """
    df = spans.drop("lft", "rgt", "parent")
    names = df.columns
    t, s, p = (names.index(c) for c in ("trace_id", "span_id", "parent_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # batches of the trace that is open

        def numbered(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            trace, span, parent = (rows.column(k).to_pylist() for k in (t, s, p))
            out: tuple[list, list, list] = ([], [], [])
            start = 0
            for k in range(1, len(trace) + 1):
                if k == len(trace) or trace[k] != trace[start]:
                    for whole, part in zip(out, _preorder(span[start:k], parent[start:k])):
                        whole += part
                    start = k
            for name, values in zip(("lft", "rgt", "parent"), out):
                rows = rows.append_column(name, pa.array(values, pa.int64()))
            yield from rows.combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            trace = batch.column(t).to_pylist()
            cut = len(trace) - 1
            while cut and trace[cut - 1] == trace[-1]:
                cut -= 1
            if held and (cut or held[-1].column(t)[-1].as_py() != trace[0]):
                yield from numbered(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from numbered(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield from numbered(pa.Table.from_batches(held))

    order = [F.col("trace_id"), F.col("start").asc_nulls_last(), F.col("span_id").asc_nulls_last()]
    out = df.schema.add("lft", "long").add("rgt", "long").add("parent", "long")
    return df.repartition("trace_id").sortWithinPartitions(*order).mapInArrow(run, out)


def enriched(spans: DataFrame) -> DataFrame:
    """Adds child_count, trace_duration, root_name and root_service."""
    w = W.partitionBy("trace_id")
    kids = spans.where("parent_id IS NOT NULL").groupBy("trace_id", F.col("parent_id").alias("span_id")).agg(F.count("*").alias("child_count"))
    root = F.struct(F.col("start"), F.col("span_id"), F.col("name"), F.col("service"))
    df = spans.join(kids, ["trace_id", "span_id"], "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))
    df = df.withColumn("trace_duration", F.max(F.col("start") + F.col("duration")).over(w) - F.min("start").over(w)).withColumn("_r", F.min(F.when(F.col("parent") == -1, root)).over(w))
    return df.withColumn("root_name", F.col("_r.name")).withColumn("root_service", F.col("_r.service")).drop("_r")


class Traces:
    """Evaluates queries over enriched spans with nested sets."""

    def __init__(self, spans: DataFrame):
        self.spans = spans

    def search(self, text: str) -> DataFrame:
        """Matching spans; a by() stage adds ``group``, select() keeps its columns beside the ids."""
        self._lex(text)
        df = self.either()
        while self.peek() == "|":
            self.take()
            df = self.stage(df)
        return df

    def _lex(self, text: str) -> None:
        self.t, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at:]!r}")
            at = m.end()
            if m.lastgroup:
                self.t.append((m.lastgroup, m[0]))
        self.k = 0

    def peek(self) -> str:
        return self.t[self.k][1] if self.k < len(self.t) else ""

    def take(self, want: str | None = None) -> str:
        if want and self.peek() != want:
            raise ValueError(f"expected {want!r}, found {self.peek()!r}")
        self.k += 1
        return self.t[self.k - 1][1]

    # spansets

    def either(self) -> DataFrame:
        out = self.both()
        while self.peek() == "||":
            self.take()
            out = self._distinct(out.unionByName(self.both()))
        return out

    def both(self) -> DataFrame:
        out = self.structural()
        while self.peek() == "&&":
            self.take()
            right = self.structural()
            a, b = out.select("trace_id").distinct(), right.select("trace_id").distinct()
            out = self._distinct(out.join(b, "trace_id", "left_semi").unionByName(right.join(a, "trace_id", "left_semi")))
        return out

    @staticmethod
    def _distinct(df: DataFrame) -> DataFrame:
        return df.dropDuplicates(["trace_id", "span_id"])

    def structural(self) -> DataFrame:
        left = self.spanset()
        while self.peek() in _STRUCTURAL:
            op = self.take()
            left = self.related(left, op, self.spanset())
        return left

    def related(self, left: DataFrame, op: str, right: DataFrame) -> DataFrame:
        """Right spans with a left span that is their ancestor (>>), descendant (<<), parent (>), child (<) or sibling (~)."""
        a, b = left.select("trace_id", *[F.col(c).alias("a_" + c) for c in ("span_id", "parent_id", "lft", "rgt")]), right
        kind = op.lstrip("!&")
        on = {
            ">>": (F.col("a_lft") < b["lft"]) & (b["rgt"] < F.col("a_rgt")),
            "<<": (b["lft"] < F.col("a_lft")) & (F.col("a_rgt") < b["rgt"]),
            ">": F.col("a_span_id") == b["parent_id"],
            "<": F.col("a_parent_id") == b["span_id"],
            "~": (F.col("a_parent_id") == b["parent_id"]) & (F.col("a_span_id") != b["span_id"]),
        }[kind]
        test = (b["trace_id"] == a["trace_id"]) & on
        if op[0] == "!":
            return b.join(a, test, "left_anti")
        found = b.join(a, test, "left_semi")
        if op[0] != "&":
            return found
        back = {">>": "<<", "<<": ">>", ">": "<", "<": ">", "~": "~"}[kind]
        return self._distinct(found.unionByName(self.related(right, back, left)))

    def spanset(self) -> DataFrame:
        if self.peek() == "(":
            self.take()
            out = self.either()
            self.take(")")
            return out
        self.take("{")
        if self.peek() == "}":
            self.take()
            return self.spans
        self.with_parents = False
        test = self.condition()
        self.take("}")
        if not self.with_parents:
            return self.spans.where(test)
        s = self.spans
        up = s.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_p"), F.struct(*s.columns).alias("up"))
        return s.join(up, (s["trace_id"] == up["_t"]) & (s["parent_id"] == up["_p"]), "left").where(test).select(*[s[c] for c in s.columns])

    # conditions

    def condition(self) -> Column:
        out = self.conjunction()
        while self.peek() == "||":
            self.take()
            out = out | self.conjunction()
        return out

    def conjunction(self) -> Column:
        out = self.comparison()
        while self.peek() == "&&":
            self.take()
            out = out & self.comparison()
        return out

    def field(self, name: str) -> Column:
        if name in _INTRINSIC:
            column = _INTRINSIC[name]
            return F.lit(None).cast("string") if column in _OPTIONAL and column not in self.spans.columns else F.col(column)
        scope, _, key = name.partition(".")
        at = lambda m, k: F.try_element_at(F.col(m), F.lit(k))
        if scope == "resource":
            return F.coalesce(at("resource", key), F.col("service")) if key == "service.name" else at("resource", key)
        if scope == "span":
            return at("attrs", key)
        if scope == "parent":
            self.with_parents = True
            return F.col("up." + _INTRINSIC[key]) if key in _INTRINSIC else F.coalesce(at("up.attrs", key), at("up.resource", key))
        return F.coalesce(at("attrs", key), F.col("service") if key == "service.name" else at("resource", key))

    def comparison(self) -> Column:
        if self.peek() == "(":
            self.take()
            out = self.condition()
            self.take(")")
            return out
        if self.peek() == "!":
            self.take()
            return ~self.comparison()
        word = self.take()
        if word in ("true", "false"):
            return F.lit(word == "true")
        op = self.take()
        kind, text = self.t[self.k]
        self.take()
        nested = re.fullmatch(r"(event|link)(?:\.|:)(.+)", word)
        if nested:
            key = nested[2]
            if word == "event:timeSinceStart":
                return F.coalesce(F.exists("events", lambda e: self._compare(e["time"] - F.col("start"), op, kind, text)), F.lit(False))
            get = lambda e: e[{"name": "name", "traceID": "trace_id", "spanID": "span_id"}[key]] if word[len(nested[1])] == ":" else F.try_element_at(e["attrs"], F.lit(key))
            return F.coalesce(F.exists(nested[1] + "s", lambda e: self._compare(get(e), op, kind, text)), F.lit(False))
        return self._compare(self.field(word), op, kind, text)

    @staticmethod
    def _compare(have: Column, op: str, kind: str, text: str) -> Column:
        if text == "nil":
            return have.isNull() if op == "=" else have.isNotNull()
        if kind == "str":
            want = text[1:-1]
            if op in ("=~", "!~"):
                hit = have.rlike(f"^(?:{want})$")
                return F.coalesce(~hit if op == "!~" else hit, F.lit(False))
            value: Column = F.lit(want)
        elif kind == "num":
            m = re.fullmatch(r"(-?[\d.]+)([a-z]*)", text)
            value, have = F.lit(float(m[1]) * _NS.get(m[2], 1)), have.try_cast("double")
        else:
            value = F.lit(text)
        hit = {"=": have == value, "!=": have != value, ">": have > value, ">=": have >= value, "<": have < value, "<=": have <= value}[op]
        return F.coalesce(hit, F.lit(False))

    # pipeline

    def stage(self, df: DataFrame) -> DataFrame:
        word = self.take()
        if word == "by":
            self.take("(")
            key = self.field(self.take())
            self.take(")")
            return df.withColumn("group", key.cast("string"))
        if word == "coalesce":
            self.take("("), self.take(")")
            return df.drop("group")
        if word == "select":
            self.take("(")
            names = [self.take()]
            while self.peek() == ",":
                self.take()
                names.append(self.take())
            self.take(")")
            return df.select("trace_id", "span_id", *[self.field(n).alias(n.split(".")[-1]) for n in names])
        if word == "{":
            self.k -= 1
            own = self.spanset().select("trace_id", "span_id")
            return df.join(own, ["trace_id", "span_id"], "left_semi")
        self.take("(")
        arg = None if self.peek() == ")" else self.field(self.take()).try_cast("double")
        self.take(")")
        op, text = self.take(), self.take()
        m = re.fullmatch(r"(-?[\d.]+)([a-z]*)", text)
        want = float(m[1]) * _NS.get(m[2], 1)
        keys = ["trace_id", *(["group"] if "group" in df.columns else [])]
        value = (F.count("*") if word == "count" else getattr(F, word)(arg)).over(W.partitionBy(*keys))
        df = df.withColumn("_v", value)
        v = F.col("_v")
        return df.where({"=": v == want, "!=": v != want, ">": v > want, ">=": v >= want, "<": v < want, "<=": v <= want}[op]).drop("_v")

    def metrics(self, text: str, step_ns: int) -> DataFrame:
        """step (ns), group, value of ``spanset | f(...) [by (field)] [| topk(n)]``."""
        head, _, tail = text.rpartition("} |") if text.count("} |") else (text, "", "")
        df = self.search(head + "}")
        m = re.match(r"\s*(\w+)\(([^)]*)\)\s*(?:by\s*\(([^)]*)\))?\s*(?:\|\s*(topk|bottomk)\((\d+)\))?\s*$", tail)
        f, args, by = m[1], [a.strip() for a in m[2].split(",") if a.strip()], m[3]
        df = df.withColumn("step", F.floor(F.col("start") / step_ns) * step_ns).withColumn("group", self.field(by.strip()).cast("string") if by else F.lit(""))
        x = self.field(args[0]).try_cast("double") if args else None
        if f == "quantile_over_time":
            df = df.withColumn("x", x)
            parts = [df.groupBy("step", "group").agg(F.percentile("x", F.lit(float(q))).alias("value")).withColumn("p", F.lit(q)) for q in args[1:]]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return out
        if f == "histogram_over_time":
            bucket = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(x, F.lit(1.0)))))
            return df.withColumn("bucket", bucket).groupBy("step", "group", "bucket").agg(F.count("*").cast("double").alias("value"))
        value = {"rate": lambda: F.count("*") / (step_ns / 1e9), "count_over_time": lambda: F.count("*").cast("double"), "sum_over_time": lambda: F.sum(x), "avg_over_time": lambda: F.avg(x), "min_over_time": lambda: F.min(x), "max_over_time": lambda: F.max(x)}[f]()
        out = df.groupBy("step", "group").agg(value.alias("value"))
        if m[4]:
            v = F.col("value").desc() if m[4] == "topk" else F.col("value").asc()
            out = out.withColumn("_n", F.row_number().over(W.partitionBy("step").orderBy(v, "group"))).where(F.col("_n") <= int(m[5])).drop("_n")
        return out

    def compare(self, selection: str, top: int = 10) -> DataFrame:
        """Attribute values by how often they occur in the selection and in the rest, ``top`` for each attribute."""
        chosen = self.search(selection).select("trace_id", "span_id", F.lit(True).alias("_s"))
        df = self.spans.join(chosen, ["trace_id", "span_id"], "left")
        facts = F.map_concat("attrs", F.create_map(F.lit("name"), "name", F.lit("service"), "service", F.lit("status"), "status"))
        df = df.select(F.coalesce("_s", F.lit(False)).alias("s"), F.explode(facts).alias("attribute", "v"))
        out = df.groupBy("attribute", "v").agg(F.count_if("s").alias("selected"), F.count_if(~F.col("s")).alias("baseline"))
        n = F.row_number().over(W.partitionBy("attribute").orderBy(F.col("selected").desc(), F.col("baseline").desc(), "v"))
        return out.withColumn("_n", n).where(F.col("_n") <= top).drop("_n")


def span_metrics(spans: DataFrame, bounds_ns: list[int]) -> DataFrame:
    """Calls and cumulative latency buckets for each (service, name, kind, status)."""
    keys = ["service", "name", "kind", "status"]
    buckets = [F.count_if(F.col("duration") <= b).alias(f"le_{b}") for b in bounds_ns]
    return spans.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum("duration").alias("total_ns"), *buckets)


def service_graph(spans: DataFrame) -> DataFrame:
    """Calls from client to server service over parent links; spans without a partner are edges to or from ''."""
    a = spans.select("trace_id", F.col("span_id").alias("parent_id"), F.col("service").alias("client"))
    b = spans.where("parent_id IS NOT NULL").select("trace_id", "parent_id", F.col("service").alias("server"))
    pairs = b.join(a, ["trace_id", "parent_id"], "left").withColumn("client", F.coalesce("client", F.lit("")))
    return pairs.where("client <> server").groupBy("client", "server").agg(F.count("*").alias("calls"))
