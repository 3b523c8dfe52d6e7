"""Exact top-k inner products over a bit-sliced index.

*Index.* Components are ``floor(1024 * x)``. Rows stand in blocks; in a block
every component keeps its ``SLICES`` most significant bits, offset to be
unsigned, and bit b of component d of all rows is one bitmap. A block's row holds
the bitmaps, the ids and the whole components, and is written to the shared
folder.

*Search.* For a query, component bitmaps (complemented where the query is
negative) are added with carry-save adders, weighted by the bits of the query's
component; this leaves the slices of a sum that differs from the inner product by
a bounded rest of the bits that were cut off. The k-th greatest sum is found from
the most significant slice downward. Rows whose sum lies within the rest of it,
or of the k-th exact score known so far, are the boundary; another pass from the
most significant slice downward marks them and their inner products are computed
exactly. Nothing is approximate: a row outside the boundary has k better ones.

Queries are dealt into chunks of about ``QUERY_BYTES`` by a hash of their id and
written to the shared folder beside the index; none comes to the driver. The work
is a table of rows (index file, chunk): a task reads a row's chunk and passes
over the file's blocks one at a time, keeping k rows for each query of the chunk.
The number of tasks is fixed by the cluster, and a lost task reads its files again.

Defined results: vectors that are null, or hold a null or a component that is
not finite, take no part, nor do rows without id; a scaled component that does not
fit a long fails the query, and so does a score that may be among the k best and
does not fit one; shorter vectors count as padded with zeros; rows of a query's own id are not its candidates, and a query id that comes
several times is asked once, with its least vector; with fewer than k candidates
all are returned; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import filesystem, fresh_dir, stored, until_exit

SCALE = 1024
SLICES = 8
BLOCK = 1 << 15
QUERY_BYTES = 32 << 20
_LONG = 1 << 63


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v (scaled integer components) of the rows that take part."""
    x = F.col(embedding).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    scaled = F.transform(x, lambda c: F.when(F.abs(c * SCALE) < float(_LONG), F.floor(c * SCALE)).otherwise(F.raise_error(F.lit("a scaled component does not fit a long")).cast("long")))
    return vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & fine).select(F.col(vec_id).cast("long").alias("vec_id"), scaled.alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to one width."""
    out = np.zeros((len(column), width), np.int64)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), ends)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)] = flat
    return out


def sliced(v: np.ndarray, slices: int = SLICES) -> tuple[int, np.ndarray]:
    """Bits cut off, and bitmaps [component, slice, word] of the offset leading bits."""
    n, d = v.shape
    bits = int(max(v.max(initial=0), ~v.min(initial=0))).bit_length() + 1
    cut = max(0, bits - slices)
    u = ((v >> cut) + (1 << (slices - 1))).astype(np.uint32)
    words = -(-n // 64)
    padded = np.zeros((d, slices, words * 64), np.uint8)
    for b in range(slices):
        padded[:, b, :n] = ((u >> b) & 1).T
    return cut, np.packbits(padded, axis=2, bitorder="little").view(np.uint64)


def add(terms: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Slices of the sum of bitmaps given by their weight's exponent: three of a weight become a sum and a carry."""
    out, p = [], 0
    while terms:
        own = terms.pop(p, [])
        carry = terms.setdefault(p + 1, [])
        while len(own) > 2:
            a, b, c = own.pop(), own.pop(), own.pop()
            half = a ^ b
            own.insert(0, half ^ c)
            carry.append((a & b) | (half & c))
        if len(own) == 2:
            a, b = own
            own = [a ^ b]
            carry.append(a & b)
        out.append(own[0] if own else None)
        if not carry:
            del terms[p + 1]
        p += 1
    return out


def sum_slices(maps: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """Slices of sum |q_d| * t_d, with t_d the offset bits of component d, complemented where q_d is negative."""
    terms: dict[int, list[np.ndarray]] = {}
    for d in np.flatnonzero(q):
        own = maps[d] if q[d] > 0 else ~maps[d]
        weight = abs(int(q[d]))
        for p in range(weight.bit_length()):
            if weight >> p & 1:
                for b in range(len(own)):
                    terms.setdefault(p + b, []).append(own[b])
    low = min(terms, default=0)
    for p in range(low):
        terms.setdefault(p, [])
    zero = np.zeros(maps.shape[2], np.uint64)
    return [zero if s is None else s for s in add(terms)] if terms else [zero]


def kth(slices: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th greatest sum among the marked rows (the least, if there are fewer)."""
    value, open_rows = 0, rows
    k = min(k, int(np.bitwise_count(rows).sum()))
    for p in range(len(slices) - 1, -1, -1):
        ones = open_rows & slices[p]
        n = int(np.bitwise_count(ones).sum())
        if n >= k:
            value |= 1 << p
            open_rows = ones
        else:
            k -= n
            open_rows = open_rows & ~slices[p]
    return value


def at_least(slices: list[np.ndarray], rows: np.ndarray, value: int) -> np.ndarray:
    """Marked rows whose sum is the value or more."""
    if value <= 0:
        return rows
    if value >> len(slices):
        return rows & np.uint64(0)
    above, equal = np.zeros_like(rows), rows
    for p in range(len(slices) - 1, -1, -1):
        if value >> p & 1:
            equal = equal & slices[p]
        else:
            above |= equal & slices[p]
            equal = equal & ~slices[p]
    return above | equal


def total(q: np.ndarray) -> int:
    """The sum as a Python number, which has no bounds."""
    return sum(q.tolist())


def scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows with q; one that does not fit a long raises."""
    size = max(int(v.max(initial=0)), -int(v.min(initial=0)))
    if size * sum(map(abs, q.tolist())) < _LONG:
        return v @ q
    exact = [sum(a * b for a, b in zip(row, q.tolist())) for row in v.tolist()]
    if any(not -_LONG <= s < _LONG for s in exact):
        raise OverflowError("a score does not fit a long")
    return np.array(exact, np.int64)


class Block:
    def __init__(self, ids: np.ndarray, v: np.ndarray, cut: int, maps: np.ndarray):
        self.ids, self.v, self.cut, self.maps = ids, v, cut, maps
        rows = np.zeros(maps.shape[2] * 64, np.uint8)
        rows[: len(ids)] = 1
        self.rows = np.packbits(rows, bitorder="little").view(np.uint64)
        self.order = np.argsort(ids, kind="stable")

    def best(self, query_id: int, q: np.ndarray, k: int, known: int | None) -> tuple[np.ndarray, np.ndarray]:
        """ids and exact scores of rows of this block that may be among the k best; known: a k-th score to reach."""
        q = np.pad(q[: self.v.shape[1]], (0, max(0, self.v.shape[1] - len(q))))
        rows = self.rows.copy()
        a, b = np.searchsorted(self.ids, query_id, "left", sorter=self.order), np.searchsorted(self.ids, query_id, "right", sorter=self.order)
        for r in self.order[a:b]:
            rows[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        if not rows.any():
            return self.ids[:0], self.ids[:0]
        slices = sum_slices(self.maps, q)
        top = (1 << self.maps.shape[1]) - 1
        # score = 2^cut * (sum - shift) + rest, and rest lies in [least, most]
        half = (top + 1) // 2
        above, below = total(q[q > 0]), total(q[q < 0])
        shift = above * half - below * (top - half)
        rest = (1 << self.cut) - 1
        least, most = rest * below, rest * above
        bound = kth(slices, rows, k)
        reach = ((bound - shift) << self.cut) + least  # k rows, or all there are, score this or more
        if int(np.bitwise_count(rows).sum()) < k:
            reach = None
        if known is not None:
            reach = known if reach is None else max(reach, known)
        if reach is not None:
            rows = at_least(slices, rows, -((most - reach) >> self.cut) + shift)
        at = np.flatnonzero(np.unpackbits(rows.view(np.uint8), bitorder="little"))
        return self.ids[at], scores(self.v[at], q)


def _index(width: int, block: int):
    """Function for mapInArrow over (vec_id, v): a row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        rows: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            i, v = np.concatenate(ids), np.concatenate(rows)
            cut, maps = sliced(v)
            size = np.abs(v).max(initial=0)
            kind = "<i2" if size < 1 << 15 else "<i4" if size < 1 << 31 else "<i8"
            return pa.RecordBatch.from_arrays([pa.array([len(i)], pa.int32()), pa.array([cut], pa.int32()), pa.array([kind]), pa.array([i.astype("<i8").tobytes()]), pa.array([v.astype(kind).tobytes()]), pa.array([maps.tobytes()])], ["n", "cut", "kind", "ids", "v", "maps"])

        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                ids.append(batch.column(0).to_numpy(zero_copy_only=False))
                rows.append(matrix(batch.column(1), width))
                if sum(map(len, ids)) >= block:
                    yield out()
                    ids, rows = [], []
        if sum(map(len, ids)):
            yield out()

    return run


def index(candidates: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """Bit-sliced blocks of quantised rows, written to the shared folder."""
    return stored(candidates.mapInArrow(_index(width, block), "n int, cut int, kind string, ids binary, v binary, maps binary"), "slices")


def _best_rows(blocks: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of each query among the blocks of one file."""
    width = queries.shape[1]
    kept: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids)
    for batch in blocks:
        for j in range(batch.num_rows):
            n, cut, kind, i, v, maps = (c[j].as_py() for c in batch.columns)
            own = Block(np.frombuffer(i, "<i8"), np.frombuffer(v, kind).reshape(n, width).astype(np.int64), cut, np.frombuffer(maps, np.uint64).reshape(width, SLICES, -1))
            for m in range(len(ids)):
                have_ids, have = kept[m]
                new_ids, new = own.best(int(ids[m]), queries[m], k, int(have[-1]) if len(have) == k else None)
                if len(new):
                    a, s = np.concatenate([have_ids, new_ids]), np.concatenate([have, new])
                    best = np.lexsort((a, ~s))[:k]
                    kept[m] = (a[best], s[best])
    for m in range(0, len(ids), 4096):
        part = kept[m : m + 4096]
        lengths = [len(a) for a, _ in part]
        if sum(lengths):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[m : m + 4096], lengths)), pa.array(np.concatenate([a for a, _ in part])), pa.array(np.concatenate([s for _, s in part]))], ["query_id", "vec_id", "score"])


def _search(folder: str, width: int, k: int):
    """Function for mapInArrow over (file, chunk): the k best rows of each of the chunk's queries among the file's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as arrow_fs
        from pyarrow import parquet

        for batch in batches:
            for file, chunk in zip(*(c.to_pylist() for c in batch.columns)):
                store, at = filesystem(f"{folder}/chunk={chunk}")
                infos = store.get_file_info(arrow_fs.FileSelector(at, allow_not_found=True))
                parts = [parquet.read_table(i.path, filesystem=store, columns=["vec_id", "v"]) for i in infos if i.path.endswith(".parquet")]
                asked = pa.concat_tables(parts).combine_chunks() if parts else None
                if asked is None or not asked.num_rows:
                    continue
                q = matrix(asked["v"].combine_chunks(), width)
                store, at = filesystem(file)
                with store.open_input_file(at) as source:
                    blocks = parquet.ParquetFile(source).iter_batches(batch_size=1, columns=["n", "cut", "kind", "ids", "v", "maps"])
                    yield from _best_rows(blocks, asked["vec_id"].to_numpy(), q, k)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = BLOCK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of ``vectors`` for each of ``queries`` (both vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = quantised(vectors)
    width = max(1, rows.agg(F.max(F.size("v")).alias("w")).first().w or 0)
    asked = quantised(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    chunks = max(1, -(-quantised(queries).select("vec_id").count() * 8 * width // query_bytes))
    folder = fresh_dir(spark, "queries")
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).alias("chunk")
    asked.select("vec_id", "v", chunk).repartition(min(chunks, 8 * spark.sparkContext.defaultParallelism), "chunk").write.partitionBy("chunk").parquet(folder)
    until_exit(spark, folder)
    files = index(rows, width, block).select(F.input_file_name().alias("file")).distinct()
    work = files.select("file", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    work = work.repartition(8 * spark.sparkContext.defaultParallelism, "file", "chunk")
    found = work.mapInArrow(_search(folder, width, k), "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_ten(vectors: DataFrame) -> DataFrame:
    """Every row whose vec_id is divisible by 100 against all other rows."""
    return search(vectors, vectors.where("vec_id % 100 = 0"), 10)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
