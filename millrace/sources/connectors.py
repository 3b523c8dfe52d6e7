"""Sources and sinks: text COPY, tenant blocks, hot and cold stores, topics as tables, and a connector of the Python data source API."""

from __future__ import annotations

import re

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from millrace.registry import query, views

ENCODINGS = {"UTF8": "UTF-8", "SQL_ASCII": "US-ASCII", "LATIN1": "ISO-8859-1", "EUC_JP": "EUC-JP"}


def copy_out(df: DataFrame, path: str, header: bool = True, delimiter: str = ",", null: str = "", encoding: str = "UTF8", quote: str = '"', escape: str | None = None) -> None:
    w = df.write.mode("overwrite").option("header", header).option("delimiter", delimiter).option("nullValue", null).option("encoding", ENCODINGS[encoding])
    w.option("quote", quote).option("escape", escape or quote).csv(path)


def copy_in(spark: SparkSession, path: str, schema, header: bool = True, delimiter: str = ",", null: str = "", encoding: str = "UTF8", quote: str = '"', escape: str | None = None, multiline: bool = False) -> DataFrame:
    """COPY FROM in CSV format; ``multiline`` lets quoted fields hold line ends, and then a file is one task."""
    r = spark.read.schema(schema).option("header", header).option("delimiter", delimiter).option("nullValue", null).option("encoding", ENCODINGS[encoding])
    return r.option("quote", quote).option("escape", escape or quote).option("multiLine", multiline).csv(path)


#: Escapes of COPY's text format besides the backslash's own.
_ESCAPES = {"\t": "\\t", "\n": "\\n", "\r": "\\r", "\b": "\\b", "\f": "\\f", "\v": "\\v"}


def copy_text_out(df: DataFrame, path: str, delimiter: str = "\t", null: str = "\\N") -> None:
    """COPY TO in text format: one line a row, special characters behind backslashes."""
    def field(c: str):
        x = F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\"))
        for char, text in _ESCAPES.items():
            x = F.replace(x, F.lit(char), F.lit(text))
        if delimiter != "\t":
            x = F.replace(x, F.lit(delimiter), F.lit("\\" + delimiter))
        return F.coalesce(x, F.lit(null))

    df.select(F.concat_ws(delimiter, *map(field, df.columns)).alias("value")).write.mode("overwrite").text(path)


def copy_text_in(spark: SparkSession, path: str, schema, delimiter: str = "\t", null: str = "\\N") -> DataFrame:
    """COPY FROM in text format; a line ``\\.`` alone is no row."""
    from pyspark.sql import types as T

    fields = (schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)).fields
    lines = spark.read.text(path).where(F.col("value") != "\\.")
    # A delimiter behind an odd number of backslashes belongs to its field.
    parts = F.split("value", r"(?<=(?<!\\)(?:\\\\){0,64})" + re.escape(delimiter), -1)

    def plain(x):
        def whole(p):
            for char, text in _ESCAPES.items():
                p = F.replace(p, F.lit(text), F.lit(char))
            return F.replace(p, F.lit("\\" + delimiter), F.lit(delimiter))

        return F.array_join(F.transform(F.split(x, r"\\\\", -1), whole), "\\")

    rows = lines.select(parts.alias("p"))
    return rows.select(*[F.when(F.get("p", F.lit(k)) != null, plain(F.get("p", F.lit(k)))).cast(f.dataType).alias(f.name) for k, f in enumerate(fields)])


def write_blocks(df: DataFrame, path: str, tenant: str, ms: str) -> None:
    """Blocks by tenant and day; readers prune by both."""
    df.withColumn("tenant", F.col(tenant).cast("string")).withColumn("day", F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")).write.mode("overwrite").partitionBy("tenant", "day").parquet(path)


def read_blocks(spark: SparkSession, path: str, tenant: str, start: str, end: str) -> DataFrame:
    """Blocks of a tenant from day ``start`` to ``end``; the tenant is mandatory."""
    if not tenant:
        raise ValueError("a tenant is needed")
    df = spark.read.option("basePath", path).parquet(path)
    return df.where((F.col("tenant") == tenant) & F.col("day").between(start, end))


def hot_and_cold(cold: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Compacted blocks and the head in memory; rows that both have count once."""
    return cold.unionByName(hot).dropDuplicates(keys)


def topic_table(df: DataFrame, partitions: int, key: str, ms: str) -> DataFrame:
    """A table in the shape of a topic: _partition, _offset, _timestamp (ms), _key, _headers and the values."""
    from pyspark.sql import Window as W

    part = F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")
    df = df.withColumn("_partition", part).withColumn("_offset", F.row_number().over(W.partitionBy("_partition").orderBy(ms, key)).cast("long") - 1)
    return df.withColumn("_timestamp", F.col(ms)).withColumn("_key", F.col(key).cast("string").cast("binary")).withColumn("_headers", F.lit("{}"))


def offsets_at(synced: DataFrame, wanted: DataFrame) -> DataFrame:
    """Consumer offsets of a replica: for each (part, source) the target of the last synced source at or before it.

    A part is cut into pieces of 2^18 offsets, so a long one is dealt over tasks.
    """
    from millrace.operators.joins import as_of

    return as_of(wanted, synced.select("part", F.col("source").alias("s"), F.col("target")), ["part"], "source", "s", ["target"], chunk=1 << 18)


class _Span(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class CounterSource(DataSource):
    """A connector of the simplest kind: rows (offset, value); option ``rows`` and ``partitions``. Shows poll, checkpoint and seek."""

    @classmethod
    def name(cls) -> str:
        return "millrace_counter"

    def schema(self) -> str:
        return "offset long, value string"

    def reader(self, schema) -> DataSourceReader:
        options = self.options

        class Reader(DataSourceReader):
            def partitions(self):
                n, k = int(options.get("rows", 100)), int(options.get("partitions", 4))
                return [_Span(n * i // k, n * (i + 1) // k) for i in range(k)]

            def read(self, partition) -> Iterator[tuple]:
                return ((i, f"v{i}") for i in range(partition.start, partition.end))

        return Reader()

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        limit = int(self.options.get("rows", 100))

        class Stream(SimpleDataSourceStreamReader):
            def initialOffset(self):
                return {"at": 0}

            def read(self, start):
                end = min(limit, start["at"] + 50)
                return iter([(i, f"v{i}") for i in range(start["at"], end)]), {"at": end}

            def readBetweenOffsets(self, start, end):
                return iter([(i, f"v{i}") for i in range(start["at"], end["at"])])

        return Stream()


@query("connector_source", "SELECT range AS \"offset\", 'v' || range AS value FROM range(1000)")
def connector(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(CounterSource)
    return spark.read.format("millrace_counter").option("rows", 1000).load()


@query("topic_scan", "SELECT count(*) AS n, 0::BIGINT AS lo FROM events")
def topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views(spark, sf_dir, "events").sql("SELECT event_id, user_id, unix_millis(CAST(ts AS TIMESTAMP)) AS ms FROM events")
    return topic_table(e, 4, "user_id", "ms").agg(F.count_distinct("_partition", "_offset").alias("n"), F.min("_offset").alias("lo"))


@query("offset_translation", "SELECT o_orderkey AS source, (o_orderkey // 10) * 10 + 7 AS target FROM orders")
def offset_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views(spark, sf_dir, "orders").sql("SELECT 0 AS part, o_orderkey AS source FROM orders")
    synced = o.select("part", (F.floor(F.col("source") / 10) * 10).alias("source")).distinct().withColumn("target", F.col("source") + 7)
    return offsets_at(synced, o).select("source", "target")


@query("hot_cold_union", "SELECT event_id, value FROM events")
def hot_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views(spark, sf_dir, "events").sql("SELECT event_id, value FROM events")
    return hot_and_cold(e.where("event_id % 3 < 2"), e.where("event_id % 3 > 0"), ["event_id"])
