"""Token files with fixed-width bit packing.

A file holds the ids of consecutive documents, each id in as few bits as the
vocabulary needs, most significant bit first, in blocks of ``BLOCK`` ids. Each
block starts on a byte, so a block can be unpacked alone with numpy.

    "MRPK" | width u8 | payload of the blocks | doc_ids i64[] | doc starts u64[n_docs + 1]
    | block offsets u64[n_blocks + 1] | n_ids u64 | n_docs u64 | n_blocks u64 | BLOCK u64 | "MRPK"

All integers are little-endian. The index stands at the end, so a file is
written in one pass with memory for one block and the index of its documents.

Documents are dealt by ranges of doc_id in one exchange; file k holds the k-th
range. A task writes to a name of its own attempt and renames at the end, so a
lost executor's work is written again and readers never see half a file. The
files are written through pyarrow's filesystems, to where the session's
checkpoint folder is.

Defined results: a null text has only the end id; rows of equal doc_id stand
together, by the hash of their text; an empty table makes no file and no row;
null doc_ids come first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import Codec, binary_texts, slices, tokenizer_path
from millrace.llm.common import filesystem, fresh_dir, until_exit

MAGIC = b"MRPK"
HEAD = len(MAGIC) + 1
TAIL = struct.Struct("<QQQQ4s")
BLOCK = 1 << 16
NO_ID = np.iinfo(np.int64).min


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in ``width`` bits each, zero-padded to a whole byte."""
    bits = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(bits[:, 32 - width :].reshape(-1)).tobytes()


def unpack(data: bytes, count: int, width: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width).reshape(count, width)
    full = np.zeros((count, 32), np.uint8)
    full[:, 32 - width :] = bits
    return np.packbits(full, axis=1).view(">u4").reshape(-1).astype("<u4")


class Writer:
    """Writes one file; ``add`` a document at a time."""

    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.pending: list[np.ndarray] = []
        self.held = self.total = 0
        self.doc_ids: list[int] = []
        self.starts, self.offsets, self.at = [0], [0], 0
        sink.write(MAGIC + bytes([width]))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(NO_ID if doc_id is None else doc_id)
        self.pending.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        self.starts.append(self.total)
        if self.held >= BLOCK:
            ids = np.concatenate(self.pending)
            whole = len(ids) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                self._block(ids[k : k + BLOCK])
            self.pending, self.held = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.sink.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.pending))
        for values, kind in ((self.doc_ids, "<i8"), (self.starts, "<u8"), (self.offsets, "<u8")):
            self.sink.write(np.array(values, kind).tobytes())
        self.sink.write(TAIL.pack(self.total, len(self.doc_ids), len(self.offsets) - 1, BLOCK, MAGIC))


class Reader:
    """Random access to the documents of one file (anything with ``seek`` and ``read``)."""

    def __init__(self, source, size: int):
        self.source = source
        self.n_ids, self.n_docs, self.n_blocks, self.block, magic = TAIL.unpack(self._at(size - TAIL.size, TAIL.size))
        if magic != MAGIC or self._at(0, 4) != MAGIC:
            raise ValueError("not a file of packed ids")
        self.width = self._at(4, 1)[0]
        index = size - TAIL.size - 8 * (2 * self.n_docs + 1 + self.n_blocks + 1)
        data = self._at(index, size - TAIL.size - index)
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs)
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, 8 * self.n_docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", self.n_blocks + 1, 8 * (2 * self.n_docs + 1)).astype(np.int64)
        self.kept: tuple[int, np.ndarray] = (-1, np.empty(0, "<u4"))

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def block_ids(self, b: int) -> np.ndarray:
        if self.kept[0] != b:
            start, end = int(self.offsets[b]), int(self.offsets[b + 1])
            count = min(self.block, self.n_ids - b * self.block)
            self.kept = (b, unpack(self._at(HEAD + start, end - start), count, self.width))
        return self.kept[1]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, read from the blocks it lies in."""
        a, z = int(self.starts[k]), int(self.starts[k + 1])
        if a == z:
            return np.empty(0, "<u4")
        first, last = a // self.block, (z - 1) // self.block
        parts = [self.block_ids(b) for b in range(first, last + 1)]
        ids = parts[0] if len(parts) == 1 else np.concatenate(parts)
        return ids[a - first * self.block : z - first * self.block]


def _written(folder: str, path: str, end_id: int):
    """Function for mapInArrow over (doc_id, text as binary) in order: one file for each partition that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        codec, part = Codec.of(path), task.partitionId()
        fs, at = filesystem(folder)
        name, own = f"{at}/ids-{part:07d}.mrpk", f"{at}/.ids-{part:07d}-{task.taskAttemptId()}"
        end = np.array([end_id], "<u4").tobytes()
        sink = out = None
        for whole in batches:
            for batch in slices(whole):
                if not batch.num_rows:
                    continue
                if out is None:
                    fs.create_dir(at, recursive=True)
                    sink = fs.open_output_stream(own)
                    out = Writer(sink, width_of(max(codec.size, end_id + 1)))
                for doc_id, raw in zip(batch.column(0).to_pylist(), codec.encode(binary_texts(batch.column(1)))):
                    out.add(doc_id, np.frombuffer(raw + end, "<u4"))
        if out is not None:
            out.close()
            sink.close()
            fs.move(own, name)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"ids-{part:07d}.mrpk"]), pa.array([out.total], pa.int64())], ["part", "file", "n_ids"])

    return run


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2) -> list[tuple[str, int]]:
    """Write the documents' ids in ascending doc_id order; (file, first id's place) of each file.

    What comes to the driver is one row for each file, not for each document.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = dealt.mapInArrow(_written(folder, path or tokenizer_path(), end_id), "part int, file string, n_ids long").collect()
    out, start = [], 0
    for r in sorted(rows, key=lambda r: r.part):
        out.append((r.file, start))
        start += r.n_ids
    return out


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(folder)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                info = fs.get_file_info(f"{at}/{name}")
                with fs.open_input_file(f"{at}/{name}") as source:
                    r = Reader(source, info.size)
                    for k in range(0, r.n_docs, 4096):
                        docs = range(k, min(k + 4096, r.n_docs))
                        crc = [zlib.crc32(r.document(d).tobytes()) for d in docs]
                        ids, starts = r.doc_ids[k : docs.stop], r.starts[k : docs.stop]
                        counts = r.starts[k + 1 : docs.stop + 1] - starts
                        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NO_ID), pa.array(starts + first), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read(spark: SparkSession, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files; a task for each file."""
    names = spark.createDataFrame(files, "file string, first long")
    if files:
        names = names.repartition(len(files), "file")
    return names.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    spark = docs.sparkSession
    folder = fresh_dir(spark, "packed")
    files = write(docs, folder, path, end_id)
    return read(spark, until_exit(spark, folder), files)
