"""Token counts by a separator scan of flat token files.

The token files are nothing but ids, one after another, with an
end-of-document id behind each document: no header, no index. Counting reads
them in blocks of fixed size, finds the separators of a block with one numpy
comparison, and stitches documents that lie across blocks with a prefix scan:
for each block the place of the last separator before it and the number of
separators before it, both from a window over the blocks of its file.

Texts are encoded with the strings of special tokens as ordinary text, so the
separator stands only behind documents. A sidecar file carries the doc_ids in
the same order; it holds no lengths or places. A task writes both files into a
folder of its own attempt and renames that folder once, so the two always come
from one attempt; an attempt that finds the name taken drops its own.

Defined results: a null or empty text counts zero ids; repeated rows count each
for itself; an empty table gives no rows; a null doc_id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.bpe import Codec, binary_texts, slices, tokenizer_path
from millrace.llm.common import filesystem, fresh_dir, until_exit

#: Ids in a block of the scan.
BLOCK = 1 << 20
END = 50256
#: Tasks of the scan for each core, however many blocks there are.
SCAN_TASKS = 4
NO_ID = np.iinfo(np.int64).min


def _flat(folder: str, path: str, end_id: int, kind: str):
    """Function for mapInArrow over (doc_id, text as binary): a flat file and its sidecar for each partition that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        codec, part = Codec.of(path, specials=False), task.partitionId()
        fs, at = filesystem(folder)
        name = f"flat-{part:07d}"
        own = f"{at}/.{name}-{task.taskAttemptId()}"
        end = np.array([end_id], kind).tobytes()
        sink = side = None
        for whole in batches:
            for batch in slices(whole):
                if not batch.num_rows:
                    continue
                if sink is None:
                    fs.create_dir(own, recursive=True)
                    sink, side = fs.open_output_stream(f"{own}/tok"), fs.open_output_stream(f"{own}/doc")
                for raw in codec.encode(binary_texts(batch.column(1))):
                    sink.write(np.frombuffer(raw, "<u4").astype(kind).tobytes() + end)
                side.write(batch.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
        if sink is not None:
            sink.close()
            side.close()
            commit(fs, own, f"{at}/{name}")
            size = fs.get_file_info(f"{at}/{name}/tok").size
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size // np.dtype(kind).itemsize], pa.int64())], ["file", "n_ids"])

    return run


def commit(fs, own: str, name: str) -> None:
    """Rename a folder to its final name, or drop it where another attempt was first."""
    try:
        if fs.get_file_info(f"{name}/tok").is_file:
            raise FileExistsError(name)
        fs.move(own, name)
    except OSError:
        if not fs.get_file_info(f"{name}/tok").is_file:
            raise
        fs.delete_dir(own)


def kind_of(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def write_flat(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END, kind: str = "<u2") -> list[tuple[str, int]]:
    """Encode into flat files, one for each partition; (file, ids in it) of each."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = docs.mapInArrow(_flat(folder, path or tokenizer_path(), end_id, kind), "file string, n_ids long").collect()
    return sorted((r.file, r.n_ids) for r in rows)


def _scan(folder: str, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(folder)
        wide = np.dtype(kind).itemsize
        for batch in batches:
            for file, block, start, count in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(f"{at}/{file}/tok") as source:
                    source.seek(start * wide)
                    ids = np.frombuffer(source.read(count * wide), kind)
                ends = np.flatnonzero(ids == end_id) + start
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))], ["file", "block", "ends"])

    return run


def _stitched(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(folder)
        for batch in batches:
            for file, ends, last, before in zip(*(c.to_pylist() for c in batch.columns)):
                if not ends:
                    continue
                with fs.open_input_file(f"{at}/{file}/doc") as source:
                    source.seek(8 * before)
                    ids = np.frombuffer(source.read(8 * len(ends)), "<i8")
                ends = np.array(ends, np.int64)
                counts = np.diff(ends, prepend=-1 if last is None else last) - 1
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NO_ID), pa.array([file] * len(ids)), pa.array(ends - counts), pa.array(counts)], ["doc_id", "file", "start", "n_tokens"])

    return run


def count(spark: SparkSession, folder: str, files: list[tuple[str, int]], end_id: int = END, kind: str = "<u2", block: int = BLOCK) -> DataFrame:
    """doc_id, file, start (place in the file), n_tokens of each document in flat files."""
    names = spark.createDataFrame(files, "file string, n_ids long")
    places = F.expr(f"explode(sequence(0L, (n_ids - 1) div {block}))")
    blocks = names.filter("n_ids > 0").select("file", places.alias("block"), "n_ids")
    blocks = blocks.select("file", "block", (F.col("block") * block).alias("start"), F.least(F.lit(block).cast("long"), F.col("n_ids") - F.col("block") * block).alias("count"))
    tasks = SCAN_TASKS * spark.sparkContext.defaultParallelism
    if files:
        blocks = blocks.repartition(max(1, min(tasks, sum((n + block - 1) // block for _, n in files))), "file", "block")
    found = blocks.mapInArrow(_scan(folder, end_id, kind), "file string, block long, ends array<long>")
    so_far = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.size("ends") > 0, F.element_at("ends", -1)), ignorenulls=True).over(so_far)
    before = F.coalesce(F.sum(F.size("ends").cast("long")).over(so_far), F.lit(0))
    return found.select("file", "ends", last.alias("last"), before.alias("before")).mapInArrow(_stitched(folder), "doc_id long, file string, start long, n_tokens long")


def write_and_count(docs: DataFrame, path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    folder = fresh_dir(spark, "flat")
    files = write_flat(docs, folder, path)
    return count(spark, until_exit(spark, folder), files)
