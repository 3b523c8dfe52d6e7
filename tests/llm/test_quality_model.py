"""op6 by its accuracy on held-out rows, and its edges."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from millrace.llm import quality_model as m


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    got = {r.doc_id: r for r in m.scores(docs, labels).collect()}
    y = {r.doc_id: r.quality for r in labels.collect()}
    held = [(y[d], got[d].score) for d in y if got[d].held_out]
    good, bad = [s for q, s in held if q == 1], [s for q, s in held if q == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    right = np.mean([(s >= 0.5) == (q == 1) for q, s in held])
    print(auc, right)
    assert auc > 0.95 and right > 0.9
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (2, "", "a"), (3, "word " * 30000, "b"), (None, "text", "c"), (4, "| a | b ##", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, q) for k, q in [(1, 1), (2, 0), (3, 1), (4, 0), (9, 1), (None, 1), (2, None)]], "doc_id long, quality int")
    got = m.scores(docs, labels).collect()
    assert len(got) == len(rows) and all(np.isfinite(r.score) for r in got)
    assert all(r.score == 0.5 for r in m.scores(docs, labels.limit(0)).collect())
    assert m.scores(docs.limit(0), labels).count() == 0
    assert all(len(m.statistics(t)) == len(m.FEATURES) and np.isfinite(m.statistics(t)).all() for t in [b"", b" \n ", b"a", "é".encode() * 99])


def test_scores_use_the_inverse_covariance():
    rnd = np.random.default_rng(2)
    d = len(m.FEATURES)
    x = {c: rnd.normal(c, 1 + c, (500, d)) for c in (0, 1)}
    sums = np.array([np.concatenate([[500], x[c].sum(0), (x[c].T @ x[c]).ravel()]) for c in (0, 1)])
    model = m.Discriminant(sums, pooled=0.0, unit=0.0)
    density = []
    for c in (0, 1):
        s, e = np.cov(x[c].T), x[0][:5] - x[c].mean(0)
        density.append(-0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(s), e) - 0.5 * np.linalg.slogdet(s)[1])
    want = 1 / (1 + np.exp(-(density[1] - density[0]) / np.sqrt(d)))
    assert np.allclose(model.score(x[0][:5]), want, atol=1e-6)


def plain_statistics(text):
    """The statistics by plain counting."""
    text = text or ""
    data, words = text.encode(), re.findall(r"[^\x20\x09-\x0d]+", text)
    raw = [w.encode() for w in words]
    lines = [x for x in data.split(b"\n") if re.search(rb"[^\x20\x09-\x0d]", x)]
    grams = Counter(tuple(raw[k : k + 3]) for k in range(len(raw) - 2))
    of = lambda chars: sum(b in chars for b in data)
    share = lambda k, n: math.log((k + 0.5) / (n + 1))
    n, size = len(raw), len(data)
    return [
        math.log(1 + n), math.log(1 + size), math.log((sum(map(len, raw)) + 1) / (n + 1)), share(of(b"#*$%&|<>"), size), share(of(bytes(range(65, 91))), size), share(of(b"0123456789"), size), share(of(b"!"), size), share(of(b"|"), size),
        share(of(b".,;:?"), size), share(of(bytes(range(128, 256))), size), share(len(Counter(raw)), n), share(sum(grams.values()) - len(grams), n), share(len(lines) - len(set(lines)), len(lines)), math.log(1 + len(lines)),
        math.log((size + 1) / (len(lines) + 1)), share(sum(any(b in b"#*$%&|<>" for b in w) for w in raw), n), math.log(1 + max([len(w) for w in raw], default=0)),
    ]


def plain_scores(docs, labels):
    """The whole query with the textbook's formulas: inverse matrices and determinants."""
    d = len(m.FEATURES)
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 3 == 1
    x = {k: np.rint(np.array(plain_statistics(t)) * 4096) / 4096 for k, t in docs.items()}
    own = {c: np.array([x[k] for k, q in labels.items() if q == c and k in x and not held(k)]) for c in (0, 1)}
    cov = {c: np.cov(own[c].T) for c in own}
    n = {c: len(own[c]) for c in own}
    pooled = sum((n[c] - 1) * cov[c] for c in own) / (n[0] + n[1] - 2)
    dev = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    density = {}
    for c in own:
        s = (0.8 * cov[c] + 0.2 * pooled) / np.outer(dev, dev)
        s = 0.98 * s + 0.02 * max(np.trace(s) / d, 1e-3) * np.eye(d) + 1e-9 * np.eye(d)
        inverse, log_det, mean = np.linalg.inv(s), np.linalg.slogdet(s)[1], own[c].mean(0)
        density[c] = {k: -0.5 * (v - mean) / dev @ inverse @ ((v - mean) / dev) - 0.5 * log_det for k, v in x.items()}
    odds = {k: density[1][k] - density[0][k] + math.log(n[1] / n[0]) for k in x}
    return {k: 1 / (1 + math.exp(-o / math.sqrt(d))) if o > -2000 else 0.0 for k, o in odds.items()}


def test_the_query_equals_brute_force(spark):
    from millrace.llm.queries import QUERIES

    at = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    want = plain_scores(docs, labels)
    got = QUERIES["op6_quality_scores"](spark, at).collect()
    assert len(got) == len(docs)
    for r in got:
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-6, abs_tol=1e-9)
        assert r.predicted == (r.score >= 0.5)


def test_scores_do_not_hang_on_the_order_of_rows(spark):
    at = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    one, other = (sorted((r.doc_id, r.score) for r in m.scores(docs.repartition(k, "lang"), labels.orderBy(order)).collect()) for k, order in ((1, "doc_id"), (5, "quality")))
    assert one == other
