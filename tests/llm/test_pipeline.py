"""The pipeline against a plain version of its stages."""

import hashlib
import random
import re

from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import bpe, mixing, quality_rules, secrets, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for k in range(60):
        text = " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(60, 200))) + "."
        rows.append((k, text, "en", f"s{k % 4}", len(text)))
    rows += [(100 + k, rows[k][1], "en", "s0", rows[k][4]) for k in range(8)]  # copies
    rows += [(200, "too short", "en", "s1", 9), (201, None, None, None, None), (202, " ".join(f"x{k}###" for k in range(90)), "en", "s2", 5), (203, rows[3][1] + "\nSign in\ntoken = abcdef123456", "en", None, 1)]
    return rows


def test_stages_and_columns(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scan", "source_mix", "bpe"]
    kept = corpus_pipeline.clean(spark, docs, "")
    assert kept.columns == docs.columns
    got = {r.doc_id: r for r in kept.collect()}
    assert set(got) == {r[0] for r in rows} - {200, 201, 202}
    assert got[203].text == rows[3][1] + "\ntoken = abcdef123456" and got[203].n_chars == len(got[203].text)
    one = corpus_pipeline.distinct(spark, kept, "")
    assert one.columns == docs.columns
    fps = {d: simhash.fingerprint(r.text.encode()) for d, r in got.items()}
    want = {d for d in fps if not any(e < d and (fps[d] ^ fps[e]).bit_count() <= 4 for e in fps)}
    assert {r.doc_id for r in one.collect()} == want
    red = corpus_pipeline.redact(spark, one, "")
    assert red.columns == docs.columns
    scanner = secrets.Scanner()
    for r in red.collect():
        assert r.text == secrets.redacted(got[r.doc_id].text, scanner.scan([got[r.doc_id].text])[0])
        assert not re.search("abcdef123456", r.text)
    mixed = corpus_pipeline.mix(spark, red, "")
    assert mixed.columns == docs.columns
    plan = {r.doc_id: r for r in mixing.planned(red).collect()}
    seen = {}
    for r in mixed.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {d: n for d, r in plan.items() if (n := r._full + (r._rest > 0 and 2 * r._rest >= r.size))}
    library = Tokenizer.from_file(bpe.tokenizer_path())
    text = {r.doc_id: r.text for r in red.collect()}
    out = corpus_pipeline.encode(spark, mixed, "").collect()
    assert len(out) == sum(seen.values())
    for r in out:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_run_on_a_folder(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 50
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert quality_rules.KEEP == 0.5


def test_columns_with_clashing_names(spark):
    """Columns that the stages use inside themselves pass through unchanged."""
    more = ["n_words", "kept", "clean", "_row", "_keep", "_nth", "_id", "_hash", "fp", "first", "root", "fingerprint", "component_id", "size", "source_size", "target", "taken", "before", "goal", "slope", "_at", "_pass", "_times", "_full", "_rest", "_key", "_bucket", "spans", "ids"]
    rows = [(*r, *[f"{r[0]}-{c}" for c in more]) for r in corpus() if r[0] is not None]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in more))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert docs.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), *more]
        got = docs.collect()
        assert got and all(r[c] == f"{r.doc_id}-{c}" for r in got for c in more)
    assert corpus_pipeline.encode(spark, docs, "").count() == len(got)
