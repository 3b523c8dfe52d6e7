"""Runs a streaming plan to its end: everything available now, into a table of memory or a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.storage import scratch


def stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drain(df: DataFrame, mode: str = "append", batch=None) -> DataFrame:
    """The rows that the stream emits until its sources have no more; ``batch`` (df, id) maps each micro-batch first.

    Micro-batches are appended to Parquet under the batch's number and overwritten
    when a batch is run again, so the sink is idempotent.
    """
    spark = df.sparkSession
    at = scratch(spark, "stream")

    def put(rows: DataFrame, n: int) -> None:
        (batch(rows, n) if batch else rows).write.mode("overwrite").parquet(f"{at}/rows/batch={n}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    try:
        return spark.read.option("basePath", f"{at}/rows").parquet(f"{at}/rows/batch=*").drop("batch") if batch is None else spark.read.option("basePath", f"{at}/rows").parquet(f"{at}/rows/batch=*")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], df.schema)
        raise


def for_each(df: DataFrame, effect, returned: str) -> DataFrame:
    """Hand each record of a stream to ``effect``, in the tasks that hold them; what it returns is kept, a row for each record.

    A micro-batch that is run again hands its records over again, as a terminal
    with effects outside the engine is told of a record at least once.
    """

    def told(batches):
        import pyarrow as pa

        names = [c.split()[0] for c in returned.split(",")]
        for batch in batches:
            rows = [effect(r) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows]) if rows else pa.RecordBatch.from_pylist([])

    return drain(df, batch=lambda rows, n: rows.mapInArrow(lambda it: (b for b in told(it) if b.num_rows), returned)).drop("batch")
