"""op4 against a plain water filling."""

import random

import pytest

from millrace.llm import mixing


def rows_of(n=400, seed=1):
    rnd = random.Random(seed)
    out = [(k, "w " * rnd.randrange(60), "hot" if k % 3 == 0 else rnd.choice(["a", "b", "é", "z", None]), "x") for k in range(n)]
    return out + [(1, None, "a", None), (1, "tie tie", "a", None), (1, "tie tie", "a", None), (None, "no id here", None, None), (7, "", "empty", None), (8, "long " * 5000, "tiny", None)]


def water(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, target = sum(sizes.values()), {}
    while len(target) < len(sizes):
        free = [s for s in names if s not in target]
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if 3 * sizes[s] < level * weight[s]]
        target |= {s: 3 * sizes[s] for s in over} if over else {s: level * weight[s] for s in free}
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken(spark, seed):
    rows = rows_of(seed=seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    out = mixing.planned(df, buckets=16).collect()
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    assert len(out) == len(rows)
    taken = {}
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5
    again = mixing.planned(df.repartition(7), buckets=16).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_positions_follow_the_schedule(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, x string")
    out = [r for r in mixing.planned(df).collect() if r.taken]
    for r in out:
        t = spark.range(1).select(mixing.position(mixing.F.lit(float(r.before)), mixing.F.lit(float(r.goal)), mixing.F.lit(r.slope)).alias("t")).first().t if r.doc_id in (5, 6, 9) else None
        if t is not None and r.before <= r.goal:
            assert abs(r.goal * (t + r.slope * (t * t - t)) - r.before) < 1e-6 * max(1, r.goal)
    rate = {}
    for r in out:
        rate[r.source] = (r.goal, r.slope)
    assert abs(sum(g * k for g, k in rate.values())) < 1e-6 * sum(g for g, _ in rate.values())


def test_training_order(spark):
    rows = rows_of()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.training_order(df)
    assert got.columns == df.columns
    seen = {}
    for r in got.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert max(v for k, v in seen.items() if k != 1) <= 3
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.training_order(df.limit(0)).count() == 0


@pytest.mark.parametrize("doc_id", ["CAST(NULL AS LONG)", "7L"])
def test_a_hot_doc_id_is_dealt_over_tasks(spark, doc_id):
    hot = spark.range(100_000).selectExpr(f"{doc_id} AS doc_id", "'five words in a text' AS text", "'s' AS source")
    docs = hot.union(spark.range(2000).selectExpr("id AS doc_id", "repeat('w ', CAST(id % 30 AS INT)) AS text", "IF(id % 2 = 0, 's', NULL) AS source"))
    both = [mixing.planned_sizes(docs), mixing.planned(docs, hot=5000)]
    for out in both:
        rows = out.collect()
        assert len(rows) == 102_000
        taken, goal = {}, {}
        for r in rows:
            taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
            goal[r.source_size] = r.goal
        assert taken == goal
        own = sorted(r.before for r in rows if r.goal == max(goal.values()) and r.size == 5 and r.doc_id in (None, 7))
        assert len(own) >= 100_000 and len(set(own)) == len(own)


def test_figures_with_and_without_texts_agree(spark):
    df = spark.createDataFrame([r for r in rows_of() if r[0] != 1], "doc_id long, text string, source string, x string")
    key = lambda r: (str(r.doc_id), r.size, r.source_size, r.target, r.goal)
    assert sorted(map(key, mixing.planned(df).collect())) == sorted(map(key, mixing.planned_sizes(df).collect()))
