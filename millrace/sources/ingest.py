"""Ingestion of metrics, traces, profiles and framed payloads: JSON forms with built-in functions, binary profiles in Arrow batches."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.registry import query, views
from millrace.sources.connectors import copy_in, copy_out, copy_text_in, copy_text_out, read_blocks, write_blocks
from millrace.storage import scratch

_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
_SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,status:struct<code:int>,attributes:{_ATTRIBUTES}>"
OTLP_TRACES = f"resourceSpans array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeSpans:array<struct<scope:struct<name:string>,spans:array<{_SPAN}>>>>>"
ZIPKIN = "array<struct<traceId:string,id:string,parentId:string,name:string,kind:string,timestamp:bigint,duration:bigint,localEndpoint:struct<serviceName:string>,tags:map<string,string>>>"
REMOTE_WRITE = "timeseries array<struct<labels:array<struct<name:string,value:string>>,samples:array<struct<value:double,timestamp:bigint>>>>"


def _attributes(a: Column) -> Column:
    """Attribute lists as a map of strings; the last of equal keys counts."""
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    pairs = F.coalesce(F.transform(a, lambda x: F.struct(x["key"].alias("key"), text(x["value"]).alias("value"))).cast("array<struct<key:string,value:string>>"), F.array().cast("array<struct<key:string,value:string>>"))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]) & x["key"].isNotNull())
    return F.map_from_entries(last)


def otlp_spans(df: DataFrame, body: str) -> DataFrame:
    """A row for each span of OTLP trace requests in JSON."""
    r = df.select(F.explode(F.from_json(body, OTLP_TRACES)["resourceSpans"]).alias("r"))
    s = r.select(_attributes(F.col("r.resource.attributes")).alias("resource"), F.explode("r.scopeSpans").alias("s")).select("resource", F.col("s.scope.name").alias("scope"), F.explode("s.spans").alias("x"))
    start, end = F.col("x.startTimeUnixNano").cast("long"), F.col("x.endTimeUnixNano").cast("long")
    parent = F.nullif(F.coalesce("x.parentSpanId", F.lit("")), F.lit(""))
    return s.select(F.lower("x.traceId").alias("trace_id"), F.lower("x.spanId").alias("span_id"), F.lower(parent).alias("parent_id"), F.col("x.name").alias("name"), F.try_element_at("resource", F.lit("service.name")).alias("service"), "scope", F.coalesce("x.kind", F.lit(0)).alias("kind"), start.alias("start"), (end - start).alias("duration"), F.coalesce("x.status.code", F.lit(0)).alias("status"), _attributes(F.col("x.attributes")).alias("attributes"), "resource")


def zipkin_spans(df: DataFrame, body: str) -> DataFrame:
    """A row for each span of Zipkin v2 lists in JSON; microseconds become nanoseconds."""
    x = df.select(F.explode(F.from_json(body, ZIPKIN)).alias("x"))
    kinds = {"SERVER": 2, "CLIENT": 3, "PRODUCER": 4, "CONSUMER": 5}
    kind = F.coalesce(F.create_map(*[F.lit(y) for kv in kinds.items() for y in kv])[F.col("x.kind")], F.lit(1))
    return x.select(F.lower("x.traceId").alias("trace_id"), F.lower("x.id").alias("span_id"), F.lower("x.parentId").alias("parent_id"), F.col("x.name").alias("name"), F.col("x.localEndpoint.serviceName").alias("service"), kind.alias("kind"), (F.col("x.timestamp") * 1000).alias("start"), (F.col("x.duration") * 1000).alias("duration"), F.col("x.tags").alias("attributes"))


def remote_write(df: DataFrame, body: str) -> DataFrame:
    """labels, ts, value of each sample of write requests in JSON."""
    t = df.select(F.explode(F.from_json(body, REMOTE_WRITE)["timeseries"]).alias("t"))
    labels = F.map_from_entries(F.transform("t.labels", lambda x: F.struct(x["name"], x["value"])))
    return t.select(labels.alias("labels"), F.inline("t.samples")).select("labels", F.col("timestamp").alias("ts"), "value")


def framed(df: DataFrame, payload: str, schemas: dict[int, str]) -> DataFrame:
    """All columns, schema_id and, for each registered id, a column v<id> of payloads framed as 0, id (4 bytes), JSON."""
    raw = F.col(payload)
    good = (F.octet_length(raw) >= 5) & (F.hex(F.substring(raw, 1, 1)) == "00")
    number = F.when(good, F.conv(F.hex(F.substring(raw, 2, 4)), 16, 10).cast("int"))
    body = F.substring(raw, 6, 1 << 30).cast("string")
    out = df.withColumn("schema_id", number)
    return out.withColumns({f"v{k}": F.when(F.col("schema_id") == k, F.from_json(body, s)) for k, s in schemas.items()})


def collapsed_stacks(df: DataFrame, line: str) -> DataFrame:
    """stack (root first) and value of lines ``a;b;c 12``."""
    cut = F.regexp_extract(line, r"^(.*) (\d+)\s*$", 1)
    return df.where(F.col(line).rlike(r" \d+\s*$")).select(F.split(cut, ";").alias("stack"), F.regexp_extract(line, r" (\d+)\s*$", 1).cast("long").alias("value"))


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, integer or bytes) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, data[at : at + n]
            at += n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            yield tag >> 3, int.from_bytes(data[at : at + n], "little")
            at += n
        else:
            raise ValueError(f"wire type {kind} is not used in profiles")


def _packed(value) -> list[int]:
    if isinstance(value, int):
        return [value]
    return [v for _, v in _fields(b"".join(b"\x08" + x for x in _varints(value)))]


def _varints(data: bytes) -> Iterator[bytes]:
    start = 0
    for k, b in enumerate(data):
        if b < 128:
            yield data[start : k + 1]
            start = k + 1


def pprof_samples(data: bytes) -> list[tuple[str, str, list[str], int]]:
    """(type, unit, stack with its root first, value) of a pprof profile, gzipped or not."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    types, samples, strings = [], [], []
    lines: dict[int, list[int]] = {}
    functions: dict[int, int] = {}
    for field, value in _fields(data):
        if field == 1:
            x = dict(_fields(value))
            types.append((x.get(1, 0), x.get(2, 0)))
        elif field == 2:
            places, values = [], []
            for f, v in _fields(value):
                (places if f == 1 else values if f == 2 else []).extend(_packed(v) if f in (1, 2) else [])
            samples.append((places, values))
        elif field == 4:
            own, calls = 0, []
            for f, v in _fields(value):
                if f == 1:
                    own = v
                elif f == 4:
                    calls.append(dict(_fields(v)).get(1, 0))
            lines[own] = calls
        elif field == 5:
            x = dict(_fields(value))
            functions[x.get(1, 0)] = x.get(2, 0)
        elif field == 6:
            strings.append(value.decode())
    out = []
    for places, values in samples:
        stack = [strings[functions[f]] for place in places for f in lines.get(place, [])][::-1]
        out += [(strings[t], strings[u], stack, v - (1 << 64) if v >> 63 else v) for (t, u), v in zip(types, values)]
    return out


def pprof(df: DataFrame, body: str) -> DataFrame:
    """type, unit, stack, value of each sample of binary profiles; broken ones raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = pprof_samples(data) if data else []
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.int64())], ["type", "unit", "stack", "value"])

    return df.select(F.col(body).cast("binary")).mapInArrow(run, "type string, unit string, stack array<string>, value long")


def _message(*fields: tuple[int, object]) -> bytes:
    """A protobuf message of (number, integer or bytes) fields."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    return b"".join(varint(k << 3 | (2 if isinstance(v, bytes) else 0)) + (varint(len(v)) + v if isinstance(v, bytes) else varint(v)) for k, v in fields)


@query("copy_csv_latin1", "SELECT p_partkey, p_name || 'é, \"x\"' AS name, CASE WHEN p_size % 2 = 0 THEN p_size END AS size FROM part")
def copy_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COPY out and in again with LATIN1, quotes and NULL marks."""
    df = views(spark, sf_dir, "part").sql("SELECT p_partkey, p_name || 'é, \"x\"' AS name, CASE WHEN p_size % 2 = 0 THEN p_size END AS size FROM part")
    at = scratch(spark, "copy")
    copy_out(df, at, delimiter="|", null="\\N", encoding="LATIN1")
    return copy_in(spark, at, df.schema, delimiter="|", null="\\N", encoding="LATIN1")


@query("copy_text", "SELECT p_partkey, p_name || chr(9) || 'a' || chr(92) || 'b' || chr(10) || chr(92) || chr(92) || 'n' || CASE WHEN p_size % 3 = 0 THEN chr(92) ELSE '' END AS name, CASE WHEN p_size % 2 = 0 THEN p_size END AS size, CASE WHEN p_size % 5 > 0 THEN '' END AS empty FROM part")
def copy_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COPY out and in again in text format: tabs, line ends, backslashes, empty texts and NULL marks."""
    name = F.concat(F.col("p_name"), F.lit("\ta\\b\n\\\\n"), F.when(F.col("p_size") % 3 == 0, "\\").otherwise(""))
    df = views(spark, sf_dir, "part").table("part").select("p_partkey", name.alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("size"), F.when(F.col("p_size") % 5 > 0, "").alias("empty"))
    at = scratch(spark, "copy")
    copy_text_out(df, at)
    return copy_text_in(spark, at, df.schema)


@query("copy_csv_quoted", "SELECT p_partkey, 'a\"' || p_name || chr(39) || chr(10) || 'x' AS name FROM part")
def copy_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COPY with another quote and escape, and line ends inside fields; EUC_JP."""
    df = views(spark, sf_dir, "part").table("part").select("p_partkey", F.concat(F.lit('a"'), F.col("p_name"), F.lit("'\nx")).alias("name"))
    at = scratch(spark, "copy")
    copy_out(df, at, quote="'", escape="\\", encoding="EUC_JP")
    return copy_in(spark, at, df.schema, quote="'", escape="\\", encoding="EUC_JP", multiline=True)


@query("tenant_blocks", "SELECT event_id, value FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-06'")
def tenant_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by tenant and day; the reader opens those of one tenant and three days."""
    e = views(spark, sf_dir, "events").sql("SELECT event_id, value, event_type, unix_millis(CAST(ts AS TIMESTAMP)) AS ms FROM events")
    at = scratch(spark, "blocks")
    write_blocks(e, at, "event_type", "ms")
    return read_blocks(spark, at, "click", "2024-01-03", "2024-01-05").select("event_id", "value")


@query("trace_bloom_lookup", "SELECT conv_id, turn FROM conversations WHERE md5(conv_id::VARCHAR) = md5('7')")
def bloom_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace by its id in blocks with Bloom filters: row groups without the id are not read."""
    c = views(spark, sf_dir, "conversations").sql("SELECT md5(CAST(conv_id AS STRING)) AS trace_id, conv_id, turn FROM conversations")
    at = scratch(spark, "bloom")
    c.write.option("parquet.bloom.filter.enabled#trace_id", "true").option("parquet.bloom.filter.expected.ndv#trace_id", "100000").parquet(at)
    return spark.read.parquet(at).where(F.col("trace_id") == F.md5(F.lit("7").cast("binary"))).select("conv_id", "turn")


_CONV = "SELECT lpad(CAST(conv_id AS STRING), 32, '0') AS t, lpad(CAST(turn AS STRING), 16, '0') AS s, IF(turn > 0, lpad(CAST(turn - 1 AS STRING), 16, '0'), '') AS p, role, length(text) AS n, turn FROM conversations"


@query("otlp_ingest", "SELECT lpad(conv_id::VARCHAR, 32, '0') AS trace_id, lpad(turn::VARCHAR, 16, '0') AS span_id, CASE WHEN turn > 0 THEN lpad((turn - 1)::VARCHAR, 16, '0') END AS parent_id, role AS service, length(text)::BIGINT AS duration, length(text)::VARCHAR AS n FROM conversations")
def otlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = """concat('{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"', role, '"}}]},"scopeSpans":[{"scope":{"name":"x"},"spans":[{"traceId":"', t, '","spanId":"', s, '","parentSpanId":"', p, '","name":"turn","kind":2,"startTimeUnixNano":"1000","endTimeUnixNano":"', 1000 + n, '","attributes":[{"key":"n","value":{"intValue":"', n, '"}}]}]}]}]}')"""
    c = views(spark, sf_dir, "conversations").sql(_CONV).select(F.expr(body).alias("body"))
    return otlp_spans(c, "body").select("trace_id", "span_id", "parent_id", "service", "duration", F.try_element_at("attributes", F.lit("n")).alias("n"))


@query("zipkin_ingest", "SELECT lpad(conv_id::VARCHAR, 32, '0') AS trace_id, role AS service, CASE WHEN role = 'user' THEN 3 ELSE 2 END AS kind, length(text)::BIGINT * 1000 AS duration FROM conversations")
def zipkin(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = """concat('[{"traceId":"', t, '","id":"', s, '","name":"turn","kind":"', IF(role = 'user', 'CLIENT', 'SERVER'), '","timestamp":5,"duration":', n, ',"localEndpoint":{"serviceName":"', role, '"},"tags":{"a":"b"}}]')"""
    c = views(spark, sf_dir, "conversations").sql(_CONV).select(F.expr(body).alias("body"))
    return zipkin_spans(c, "body").select("trace_id", "service", "kind", "duration")


@query("remote_write_ingest", "SELECT event_type AS name, event_id AS ts, value FROM events UNION ALL SELECT event_type, event_id + 1, value * 2 FROM events")
def remote_write_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.lit("__name__").alias("name"), F.col("event_type").alias("value"))).alias("labels"), F.array(F.struct("value", F.col("event_id").alias("timestamp")), F.struct((F.col("value") * 2).alias("value"), (F.col("event_id") + 1).alias("timestamp"))).alias("samples"))).alias("timeseries")))
    e = views(spark, sf_dir, "events").table("events").select(body.alias("body"))
    return remote_write(e, "body").select(F.col("labels")["__name__"].alias("name"), "ts", "value")


@query("framed_payloads", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 3)::INTEGER END AS schema_id, CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 3 = 2 THEN o_orderstatus END AS status FROM orders")
def framed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views(spark, sf_dir, "orders").table("orders")
    json = F.when(F.col("o_orderkey") % 3 == 1, F.to_json(F.struct("o_totalprice"))).otherwise(F.to_json(F.struct("o_orderstatus")))
    frame = F.concat(F.unhex(F.when(F.col("o_orderkey") % 3 == 0, F.lit("01")).otherwise(F.lit("00"))), F.unhex(F.lpad(F.hex(F.col("o_orderkey") % 3), 8, "0")), json.cast("binary"))
    out = framed(o.select(F.col("o_orderkey").alias("id"), frame.alias("payload")), "payload", {1: "o_totalprice double", 2: "o_orderstatus string"})
    return out.select("id", "schema_id", F.col("v1.o_totalprice").alias("price"), F.col("v2.o_orderstatus").alias("status"))


@query("profile_collapsed_ingest", "SELECT string_split(p_type, ' ')[1] AS root, sum(p_size)::BIGINT AS value FROM part GROUP BY 1")
def collapsed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views(spark, sf_dir, "part").sql("SELECT concat(replace(p_type, ' ', ';'), ' ', p_size) AS line FROM part")
    return collapsed_stacks(p, "line").groupBy(F.element_at("stack", 1).alias("root")).agg(F.sum("value").alias("value"))


@query("pprof_ingest", "SELECT 'cpu' AS type, 'main>work' AS stack, (n_nationkey + 1)::BIGINT AS value FROM nation")
def pprof_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary profiles: a main and a work function, one sample each."""
    strings = [b"", b"cpu", b"nanoseconds", b"main", b"work"]
    head = [(1, _message((1, 1), (2, 2)))]
    tail = [(4, _message((1, 7), (4, _message((1, 1))))), (4, _message((1, 8), (4, _message((1, 2))))), (5, _message((1, 1), (2, 3))), (5, _message((1, 2), (2, 4))), *[(6, x) for x in strings]]
    rows = [(gzip.compress(_message(*head, (2, _message((1, b"\x08\x07"), (2, bytes([k + 1])))), *tail)),) for k in range(25)]
    return pprof(spark.createDataFrame(rows, "body binary"), "body").select("type", F.array_join("stack", ">").alias("stack"), "value")
