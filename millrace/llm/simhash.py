"""Near-duplicates by SimHash, linked over a grid of segment bit counts.

A fingerprint has 64 bits; two link if they differ in ``NEAR`` bits at most.

*Embedding.* A fingerprint is mapped to the bit counts (0, 1 or 2) of its 32
two-bit segments. A differing bit changes one count by one, so the Manhattan
distance of two embeddings is at most the number of differing bits. Written in
unary (0 = 00, 1 = 01, 2 = 11) the 32 counts fill one long, and their Manhattan
distance is the bit count of an exclusive or.

*Grid.* The segments form 6 blocks. At a Manhattan distance of 4 or less at most
4 of the blocks differ, so at least 2 have equal counts. Each fingerprint goes to
the 15 cells named by 2 blocks and their counts, and every pair to be linked
meets in one of them (for a nearer ``near``, more blocks name a cell). Only distinct
fingerprints go there: exact copies are one row.

*Range join.* The rows of a cell come in the order of their whole bit count, the
coarsest embedding of all: one segment. Its Manhattan distance bounds that of the
32 segments from below, so a row meets only the rows whose count is at most
``near`` above its own, a band found by binary search. Pairs of the band are held
against the Manhattan distance of the 32 segments, and those left are verified
exactly. A cell emits no more links than it has rows: where a cell has more pairs than
rows, a breadth-first search emits a tree instead of them.

*Large cells.* A cell of more than ``SWEEP`` rows is first searched breadth-first for
dense groups, which costs about their size; what is left is gridded again in
memory by the counts of the other blocks' segments (7 smaller blocks, 35 cells),
and each finer cell is joined by range as above. A cell keeps some 50 bytes for a
fingerprint.

*The rest.* If a cell holds more than ``CELL`` fingerprints, or its search would make
more than ``WORK`` comparisons, its open fingerprints take another exact way: two
that differ in ``near`` bits share a point within half of that of both, rounded
up for one of them. So each is sent to the points around it, at most 2,081, and
linked there to the least of those at the smaller distance, in work linear in
their number.

Defined results: a null or wordless text has fingerprint zero and links like any
other; fewer than four words are one shingle; texts of any length are whole;
repeated rows get the same class; the class of rows without any doc_id is null;
an empty table gives no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.bpe import binary_texts, slices
from millrace.llm.common import settle
from millrace.llm.components import components

NEAR = 4
SHINGLE = 4
SEED = 42
CELL = 1 << 22
WORK = 1 << 31
#: Rows of a cell that are joined by range at once.
SWEEP = 512
#: Comparisons of the first search of a large cell for dense groups.
FIRST = 1 << 28
#: Pairs that are compared at once, a cell's own at least.
PAIRS = 1 << 18
_LOW = 0x5555555555555555
_SEGMENTS = range(32)


def blocks(segments: Iterable[int], n: int) -> list[int]:
    """Masks of n blocks of near equal numbers of two-bit segments."""
    segments = list(segments)
    return [sum(3 << 2 * g for g in segments[len(segments) * k // n : len(segments) * (k + 1) // n]) for k in range(n)]


def cell_masks(near: int) -> list[int]:
    """Masks of the blocks that name a cell: as many as are equal at least."""
    return [sum(c) for c in combinations(blocks(_SEGMENTS, 6), 6 - near)]


def finer_masks(mask: int, near: int) -> list[int]:
    """The same for the segments outside of a mask, in 7 blocks."""
    return [sum(c) for c in combinations(blocks([g for g in _SEGMENTS if not mask >> 2 * g & 1], 7), 7 - near)]


def around(radius: int) -> list[int]:
    """The points within so many bits of zero."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """SimHash of the text's word shingles: a bit is set if it is set in over half of their XXH64."""
    from xxhash import xxh64_intdigest as xxh

    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    spans = zip(starts[:n].tolist(), (ends[size - 1 :] if len(words) >= size else ends[-1:]).tolist())
    hashes = np.fromiter((xxh(flat[a:b], SEED) for a, b in spans), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, 1024):
            values = np.array([fingerprint(t) for t in binary_texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame, hashed: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and, if asked for, hash (of the text) of each row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *([F.xxhash64("text").alias("hash")] if hashed else []))
    return texts.mapInArrow(_fingerprints, "doc_id long, fp long" + ", hash long" * hashed)


def embedding(fp: Column) -> Column:
    """Bit counts of the two-bit segments, in unary."""
    low, high = fp.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_LOW))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def embedded(fp: np.ndarray) -> np.ndarray:
    low, high = fp & np.uint64(_LOW), (fp >> np.uint64(1)) & np.uint64(_LOW)
    return low | high | ((low & high) << np.uint64(1))


Links = list[tuple[np.ndarray, np.ndarray]]


def tree(fp: np.ndarray, near: int = NEAR, work: int = WORK) -> tuple[Links, np.ndarray, int]:
    """Tree links among distinct fingerprints by breadth-first search, those left open as the work ran out, and the work left."""
    fp = np.sort(fp)
    u = embedded(fp)
    child, parent = [], []
    left, queue = np.arange(len(fp)), deque()
    while len(left):
        queue, left = deque([int(left[0])]), left[1:]
        while queue and len(left) and work >= len(left):
            work -= len(left)
            at = queue.popleft()
            maybe = np.bitwise_count(u[left] ^ u[at]) <= near  # Manhattan distance, a lower bound
            maybe[maybe] = np.bitwise_count(fp[left[maybe]] ^ fp[at]) <= near
            found = left[maybe].tolist()
            if found:
                child += found
                parent += [at] * len(found)
                queue += found
                left = left[~maybe]
        if queue and len(left):
            break
    open_rows = fp[np.concatenate([np.array(queue, int), left])] if len(left) else fp[:0]
    return [(fp[child], fp[parent])] if child else [], open_rows, work


def range_links(fp: np.ndarray, cell: np.ndarray, near: int = NEAR) -> Links:
    """Links within cells; rows are in the order of (cell number, bit count)."""
    u = embedded(fp)
    place = cell.astype(np.int64) * 128 + np.bitwise_count(fp)
    ends = np.searchsorted(place, place + near, "right")
    starts = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1))
    stops = np.append(starts[1:], len(fp))
    pairs = np.cumsum(np.add.reduceat(ends - np.arange(len(fp)) - 1, starts))
    out: Links = []
    first = 0
    while first < len(starts):  # whole cells, so many that their pairs fit a budget
        done = pairs[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(pairs, done + PAIRS, "right")))
        a, b = _band(fp, u, ends, int(starts[first]), int(stops[last - 1]), near)
        if len(a):
            of = np.searchsorted(starts, a, "right") - 1
            many = np.bincount(of, minlength=len(starts)) > stops - starts
            few = ~many[of]
            out.append((fp[b[few]], fp[a[few]]))
            for c in np.flatnonzero(many):
                out += tree(fp[starts[c] : stops[c]], near)[0]
        first = last
    return out


def _band(fp: np.ndarray, u: np.ndarray, ends: np.ndarray, start: int, stop: int, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near pairs of rows start to stop, each with those from it to its band's end."""
    at, j = np.arange(start, stop), 0
    low, high = [at[:0]], [at[:0]]
    while True:
        j += 1
        at = at[at + j < ends[at]]
        if not len(at):
            return np.concatenate(low), np.concatenate(high)
        some = at[np.bitwise_count(u[at] ^ u[at + j]) <= near]  # Manhattan distance, a lower bound
        some = some[np.bitwise_count(fp[some] ^ fp[some + j]) <= near]
        low.append(some)
        high.append(some + j)


def _unique(links: Links) -> Links:
    pairs = np.unique(np.stack([np.concatenate(side) for side in zip(*links)], axis=1), axis=0)
    return [(pairs[:, 0].copy(), pairs[:, 1].copy())]


def large_cell(fp: np.ndarray, mask: int, near: int = NEAR, work: int = WORK, sweep: int = SWEEP) -> tuple[Links, np.ndarray]:
    """Links of a large cell, and the fingerprints that the work did not suffice for."""
    links, fp, _ = tree(fp, near, min(work, FIRST))
    if not len(fp):
        return links, fp
    u, count, open_rows = embedded(fp), np.bitwise_count(fp), []
    for finer in finer_masks(mask, near):
        key = u & np.uint64(finer)
        order = np.lexsort((count, key))
        cell = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        sizes = np.bincount(cell)
        small = sizes[cell] <= sweep
        links += range_links(fp[order[small]], np.cumsum(np.diff(cell[small], prepend=cell[small][:1]) != 0), near) if small.any() else []
        for c in np.flatnonzero(sizes > sweep):
            more, rest, work = tree(fp[order[np.searchsorted(cell, c, "left") : np.searchsorted(cell, c, "right")]], near, work)
            links += more
            open_rows.append(rest)
        if sum(len(a) for a, _ in links) > 4 * len(fp):
            links = _unique(links)
    return links, np.unique(np.concatenate(open_rows)) if open_rows else fp[:0]


def _cells(masks: list[int], near: int, cell: int, work: int, sweep: int):
    """Function for mapInArrow over (c, key, fp) in order: links (a, b), or (a, null) for a fingerprint that stays open."""

    def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        low = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), low], ["a", "b"])

    def emit(links: Links, rest: np.ndarray) -> Iterator[pa.RecordBatch]:
        if links:
            yield out(*(np.concatenate(side) for side in zip(*links)))
        if len(rest):
            yield out(rest, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []  # the open cell: its fingerprints so far, none of them if there are too many
        name, held = None, 0

        def close() -> Iterator[pa.RecordBatch]:
            if 1 < held <= cell:
                fp = np.concatenate(kept)
                if held <= sweep:
                    yield from emit(range_links(fp, np.zeros(held, np.int64), near), fp[:0])
                else:
                    yield from emit(*large_cell(fp, masks[name[0]], near, work, sweep))

        for batch in batches:
            if not batch.num_rows:
                continue
            c, key, fp = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            fp = fp.view(np.uint64)
            starts = np.concatenate([[0], np.flatnonzero((c[1:] != c[:-1]) | (key[1:] != key[:-1])) + 1])
            ends = np.concatenate([starts[1:], [len(fp)]])
            sizes = ends - starts
            # Small cells inside the batch are joined all at once.
            inner = (sizes > 1) & (sizes <= min(sweep, cell))
            inner[[0, -1]] = False
            if inner.any():
                mine = np.repeat(inner, sizes)
                yield from emit(range_links(fp[mine], np.repeat(np.arange(int(inner.sum())), sizes[inner]), near), fp[:0])
            for k in sorted({0, len(starts) - 1} | set(np.flatnonzero(~inner & (sizes > 1)).tolist())):
                if k > 0 or name != (c[0], key[0]):
                    yield from close()
                    kept, held, name = [], 0, (int(c[starts[k]]), int(key[starts[k]]))
                rows = fp[starts[k] : ends[k]]
                if held <= cell < held + len(rows):  # too many: hand on what was kept
                    for x in kept:
                        yield out(x, None)
                    kept = []
                held += len(rows)
                if held > cell:
                    yield out(rows, None)
                else:
                    kept.append(rows.copy())
        yield from close()

    return run


def links(distinct: DataFrame, near: int = NEAR, cell: int = CELL, work: int = WORK, sweep: int = SWEEP) -> DataFrame:
    """Links (a, b) that join all of the distinct fingerprints fp which differ in ``near`` (1 to 4) bits at most."""
    if not 1 <= near <= 4:
        raise ValueError("the grid finds links of 1 to 4 differing bits")
    masks = cell_masks(near)
    u = embedding(F.col("fp"))
    cells = distinct.select("fp", u.alias("u")).select("fp", "u", F.posexplode(F.array(*[F.lit(signed(m)) for m in masks])).alias("c", "mask"))
    cells = cells.select("c", F.col("u").bitwiseAND(F.col("mask")).alias("key"), "fp")
    cells = cells.repartition("c", "key").sortWithinPartitions("c", "key", F.bit_count("fp"))
    found = settle(cells.mapInArrow(_cells(masks, near, cell, work, sweep), "a long, b long").distinct())
    rest = found.where("b IS NULL").select(F.col("a").alias("fp"))
    out = found.where("b IS NOT NULL")
    if rest.isEmpty():
        return out
    points = rest.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in around((near + 1) // 2)])).alias("m"))
    points = points.select("fp", F.bit_count("m").alias("bits"), F.col("fp").bitwiseXOR(F.col("m")).alias("z"))
    least = points.groupBy("z").agg(F.min(F.when(F.col("bits") <= near // 2, F.col("fp"))).alias("low"))
    more = points.join(least, "z").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()
    return out.union(more)


def _members(docs: DataFrame, near: int, hashed: bool = False) -> DataFrame:
    """The fingerprints of each row, with root (a fingerprint that names the class) and component_id (its least doc_id)."""
    own = settle(fingerprints(docs, hashed))
    firsts = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = components(links(firsts.select("fp"), near))
    firsts = firsts.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = settle(firsts)
    # Settled, so that the join below has an exchange on both sides and a large class can be split over tasks.
    least = settle(firsts.groupBy("root").agg(F.min("first").alias("component_id")))
    of = firsts.join(least, "root").select("fp", "root", "component_id")
    return own.join(of, "fp")


def classes(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id of the class) of each row."""
    return _members(docs, near).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """The document with the least doc_id of each class, all columns; rows without doc_id stand for themselves, copies aside.

    A doc_id may come with texts of several classes: rows are known by doc_id and the
    text's hash, and each class keeps one.
    """
    found = _members(docs, near, hashed=True)
    own = F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))
    # A class keeps its least doc_id with one text, and one row of each text without doc_id.
    keep = found.where(own).groupBy("root", "doc_id", F.when(F.col("doc_id").isNull(), F.col("hash")).alias("_t")).agg(F.min("hash").alias("hash"))
    keep = keep.select(*_known(F.col("doc_id"), F.col("hash"))).distinct()
    rows = docs.select(*_known(F.col("doc_id").cast("long"), F.xxhash64("text")), F.struct(*docs.columns).alias("_row"))
    # Repeated rows go first, most of them before the exchange; the join then finds its rows in place.
    nth = F.row_number().over(W.partitionBy("_z", "_i", "_h").orderBy(F.lit(0)))
    return rows.withColumn("_nth", nth).where("_nth = 1").join(keep, ["_z", "_i", "_h"], "left_semi").select("_row.*")


def _known(doc_id: Column, text_hash: Column) -> list[Column]:
    """What a row is known by: no doc_id at all, the doc_id, and the text."""
    return [doc_id.isNull().alias("_z"), F.coalesce(doc_id, F.lit(0)).alias("_i"), text_hash.alias("_h")]
