"""op1 against all pairs on small tables."""

import random

import numpy as np
import pytest
import xxhash

from millrace.llm import components, simhash


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, near=4):
    """Root index of each by brute force."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= near:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(x) for x in range(len(fps))]


def near_copies(n, seed):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(900)}" for _ in range(300)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(300)] = f"x{rnd.randrange(99)}"
        out.append(" ".join(words))
    return out


def test_fingerprint_is_the_stated_one():
    for t in ["", None, " \t", "One", "a b C", "a b c d", "a b c d e", "É\x0bÀ x Y z", *near_copies(3, 1)]:
        assert simhash.fingerprint((t or "").encode()) == plain(t)


@pytest.mark.parametrize("near", [1, 2, 3, 4])
def test_distances_in_the_grid(near):
    rnd = np.random.default_rng(5)
    a = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = a.copy()
    for _ in range(near):
        b ^= np.uint64(1) << rnd.integers(0, 64, 3000, dtype=np.uint64)
    ua, ub = simhash.embedded(a), simhash.embedded(b)
    assert (np.bitwise_count(ua ^ ub) <= np.bitwise_count(a ^ b)).all()
    masks = simhash.cell_masks(near)
    assert len(masks) <= 20
    same = (ua[:, None] & np.array(masks, np.uint64)) == (ub[:, None] & np.array(masks, np.uint64))
    assert same.any(1).all()
    for k in range(50):  # and in a finer grid of the rest
        finer = np.array(simhash.finer_masks(masks[int(np.flatnonzero(same[k])[0])], near), np.uint64)
        assert ((ua[k] & finer) == (ub[k] & finer)).any()


def test_classes_equal_brute_force(spark):
    texts = [None, "", " ", "Hello", "hello", "a b c", *near_copies(40, 2), *near_copies(25, 3), "tie tie tie", "tie tie tie", "long " * 20000]
    rows = [(k * 7, t, "x") for k, t in enumerate(texts)] + [(14, "a b c", None), (None, "hello", None), (None, "alone with no id at all", None)]
    got = simhash.classes(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    fps = [plain(t) for _, t, _ in rows]
    root = classes(fps)
    ids = {}
    for (d, _, _), r in zip(rows, root):
        if d is not None:
            ids[r] = min(ids.get(r, d), d)
    want = sorted(((d, f"{f:016x}", ids.get(r)) for (d, _, _), f, r in zip(rows, fps, root)), key=repr)
    assert sorted(map(tuple, got), key=repr) == want


LIMITS = [(1 << 22, 1 << 31, 512), (1 << 22, 1 << 31, 2), (5, 1 << 31, 512), (1 << 22, 9, 2), (1 << 22, 300, 4)]


@pytest.mark.parametrize("near", [1, 2, 3, 4])
@pytest.mark.parametrize(("cell", "work", "sweep"), LIMITS)
def test_hot_cells_lose_no_link(spark, near, cell, work, sweep):
    rnd = random.Random(4)
    centre = [rnd.getrandbits(64) for _ in range(3)]
    fps = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(near + 1))) for c in centre for _ in range(30)}
    fps |= {rnd.getrandbits(64) for _ in range(20)}
    walk = rnd.getrandbits(64)
    for _ in range(12):  # a chain of links at the greatest distance
        walk ^= sum(1 << b for b in rnd.sample(range(64), near))
        fps.add(walk)
    values = sorted(simhash.signed(f) for f in fps)
    df = spark.createDataFrame([(f,) for f in values], "fp long")
    found = simhash.links(df, near, cell, work, sweep)
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= near for a, b in found.collect())
    got = {r.node: r.root for r in components.components(found).collect()}
    groups = {}
    for f, r in zip(values, classes([f & (1 << 64) - 1 for f in values], near)):
        groups.setdefault(r, []).append(f)
    for members in groups.values():
        if len(members) > 1:
            assert {got[m] for m in members} == {min(members)}
        else:
            assert members[0] not in got


@pytest.mark.parametrize(("sweep", "first"), [(512, 1 << 28), (512, 20_000), (40, 20_000), (40, 0)])
def test_large_cells_without_spark(monkeypatch, sweep, first):
    """Thousands of fingerprints that share two blocks, dense groups among them; ``first`` leaves more or less to the finer grid."""
    monkeypatch.setattr(simhash, "FIRST", first)
    rnd = np.random.default_rng(8)
    mask = simhash.cell_masks(4)[3]
    fp = rnd.integers(0, 1 << 63, 3000, dtype=np.uint64) & ~np.uint64(mask)
    fp |= np.uint64(0x5555555555555555 & mask)
    for _ in range(3):
        other = fp[:1500] ^ (np.uint64(1) << rnd.integers(0, 64, 1500, dtype=np.uint64))
        fp = np.unique(np.concatenate([fp, other[((other ^ fp[:1500]) & np.uint64(mask)) == 0]]))
    links, rest = simhash.large_cell(fp, mask, 4, sweep=sweep)
    assert not len(rest) and sum(len(a) for a, _ in links) < 40 * len(fp)
    root = {int(f): int(f) for f in fp}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        assert (np.bitwise_count(a ^ b) <= 4).all()
        for x, y in zip(a.tolist(), b.tolist()):
            root[find(x)] = find(y)
    for k in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[k + 1 :] ^ fp[k]) <= 4):
            assert find(int(fp[k])) == find(int(fp[k + 1 + j]))


def test_a_dense_cell_makes_a_tree():
    """Tens of thousands of fingerprints within a few bits of each other cost one search and a link each."""
    rnd = np.random.default_rng(1)
    mask = simhash.cell_masks(4)[4]
    free = np.array([b for b in range(64) if not mask >> b & 1], np.uint64)
    fp = np.full(60_000, np.uint64(0x5555555555555555 & mask))
    for _ in range(6):
        fp ^= np.uint64(1) << free[rnd.integers(0, len(free), len(fp))]
    fp = np.unique(fp)
    links, rest = simhash.large_cell(fp, mask)
    assert not len(rest) and sum(len(a) for a, _ in links) == len(fp) - 1


def test_a_hub_of_many_links(spark):
    edges = spark.range(1, 50_000).selectExpr("id AS a", "0L AS b").union(spark.range(1, 50_000).selectExpr("id AS a", "id + 100000 AS b"))
    out = components.components(edges)
    assert out.count() == 99_999 and out.where("root <> 0").count() == 0


def test_refused_distances(spark):
    for near in (0, 5):
        with pytest.raises(ValueError, match="1 to 4"):
            simhash.links(spark.createDataFrame([(1,)], "fp long"), near)


def test_components_of_a_path_and_of_nothing(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(99, 98), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components.components(path).collect()}
    assert got == {k: 0 for k in range(61)} | {98: 98, 99: 98}
    assert components.components(path.limit(0)).count() == 0


def test_one_of_each(spark):
    rows = [(3, "a b c d e", "k"), (2, "a b c d e", "k"), (2, "a b c d e", "k"), (9, "other words stand in here", None), (None, None, None)]
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted((r.doc_id or -1) for r in out.collect()) == [-1, 2, 9]
    assert out.columns == ["doc_id", "text", "lang"]
    assert simhash.classes(out.limit(0)).count() == 0


def test_one_of_each_where_a_doc_id_has_several_texts(spark):
    a, near = near_copies(2, 1)[0], None
    for text in near_copies(60, 1):
        if text != a and (plain(text) ^ plain(a)).bit_count() <= 4:
            near = text
    b, c = "quite other words " * 3 + "stand in here", "and a third one of its own " * 4
    assert near and min((plain(x) ^ plain(y)).bit_count() for x, y in ((a, b), (a, c), (b, c))) > 4
    rows = [(1, a), (2, near), (2, b), (2, b), (2, c), (5, c), (None, a), (None, a), (None, b)]
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out), key=repr) == sorted([(1, a), (2, b), (2, c), (None, a), (None, b)], key=repr)
