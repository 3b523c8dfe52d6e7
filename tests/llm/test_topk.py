"""op7 against all inner products."""

import math
import random

import numpy as np
import pytest

from millrace.llm import topk


def brute(rows, k, asked):
    fine = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in fine if asked(i)}):
        q = min(v for j, v in fine if j == i)
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in fine if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return out


@pytest.mark.parametrize(("scale", "block"), [(0.2, 1 << 15), (0.2, 50), (0.004, 64), (30.0, 100)])
def test_top_k_equals_brute_force(spark, scale, block):
    rnd = random.Random(5)
    rows = [(k, [float(np.float32(rnd.gauss(0, scale))) for _ in range(12)]) for k in range(230)]
    rows += [(300 + k, rows[10][1]) for k in range(40)]  # ties
    rows += [(400, None), (500, [None] * 12), (600, [float("nan")] * 12), (601, [float("inf")] + [0.0] * 11), (None, rows[1][1]), (700, [0.5] * 3), (800, []), (0, rows[3][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    got = topk.search(df, df.where("vec_id % 100 = 0"), 10, block=block).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10, lambda i: i % 100 == 0)


def test_chunks_of_queries(spark):
    rnd = random.Random(6)
    rows = [(k, [rnd.random() for _ in range(4)]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df, df.where("vec_id % 5 = 0"), 3, query_bytes=100).collect()
    assert sorted(map(tuple, got)) == brute(rows, 3, lambda i: i % 5 == 0)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.search(df, df).collect())) == [(0, 1, 1, 2048 * 1024), (1, 1, 0, 2048 * 1024)]
    assert topk.top_ten(df.limit(0)).count() == 0


def test_slice_arithmetic():
    rnd = np.random.default_rng(1)
    v = rnd.integers(-500, 500, (200, 6))
    cut, maps = topk.sliced(v)
    for _ in range(20):
        q = rnd.integers(-300, 300, 6)
        slices = topk.sum_slices(maps, q)
        sums = sum((np.unpackbits(s.view(np.uint8), bitorder="little").astype(np.int64) << p) for p, s in enumerate(slices))[:200]
        u = (v >> cut) + 128
        want = (np.where(q > 0, u, 255 - u) * np.abs(q)).sum(1)
        assert (sums == want).all()
        rows = topk.Block(np.arange(200), v, cut, maps).rows
        assert topk.kth(slices, rows, 7) == np.sort(want)[-7]
        marked = np.unpackbits(topk.at_least(slices, rows, int(np.median(want))).view(np.uint8), bitorder="little")[:200]
        assert (marked == (want >= int(np.median(want)))).all()


@pytest.mark.parametrize(("scale", "block"), [(4e5, 1 << 15), (4e5, 50), (6e5, 64)])
def test_large_components_keep_their_values(spark, scale, block):
    rnd = random.Random(7)
    rows = [(k, [rnd.gauss(0, scale) for _ in range(8)]) for k in range(150)]
    rows += [(200, [1e6, 0.0]), (201, [0.0] * 8 + [1e15]), (300, [0.5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = topk.search(df, df.where("vec_id % 100 = 0"), 10, block=block).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10, lambda i: i % 100 == 0)


def test_scores_beyond_a_long_fail(spark):
    assert topk.scores(np.array([[1 << 40, 1 << 40]]), np.array([1 << 40, -(1 << 40)])).tolist() == [0]
    for far in (1e14, 1e300):
        df = spark.createDataFrame([(0, [far]), (1, [far])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="does not fit a long"):
            topk.search(df, df).collect()


def test_many_chunks_over_several_files(spark):
    rows = spark.range(20_000).selectExpr("id AS vec_id", "transform(sequence(0, 3), k -> CAST((id * (k + 3) * 7919) % 2001 - 1000 AS DOUBLE) / 1000) AS embedding")
    queries = rows.where("vec_id % 4 = 0")
    got = topk.search(rows, queries, 1, block=4096, query_bytes=1600)
    assert got.count() == 5000
    few = {r.query_id: (r.vec_id, r.score) for r in got.where("query_id % 1000 = 0").collect()}
    plain = [(r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for r in rows.collect()]
    for i, (j, s) in few.items():
        q = plain[i][1]
        assert (-s, j) == min((-sum(a * b for a, b in zip(q, v)), o) for o, v in plain if o != i)
