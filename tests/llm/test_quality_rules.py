"""op5 against a plain Python count."""

import re
from collections import Counter

import pytest

from millrace.llm import quality_rules as q

SENTENCE = "the quick brown fox jumps over the lazy dog near a river bank today"
LONG = " ".join(f"w{k}" for k in range(60))
TEXTS = [None, "", " \n\t ", "one", LONG, f"{LONG}\n{LONG}", "\n".join([SENTENCE] * 8), LONG + "\nHome | News | Sport | Contact", "\n".join(f"item{k} | thing{k} | other{k}" for k in range(30)), " ".join(f"bad{k}###" for k in range(80)), LONG + "\nAll rights reserved.", "a b c a b c a b c x y z " * 30, "é\x0bü\x0cß " * 40, "x " * 20000, "it's " + LONG + " | a"]


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_base_figures(spark):
    rows = [(k, t, None) for k, t in enumerate(TEXTS)] + [(4, LONG, 7), (None, LONG, 1)]
    got = q.rules(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect()
    assert len(got) == len(rows)
    text = {k: t for k, t, _ in rows}
    for r in got:
        n, chars, symbols, dup, rep = base(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), r
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.base_failed and r.kept)


@pytest.mark.parametrize(("text", "kept"), [(LONG, True), (LONG + "\nHome | News | Sport | Contact", True), (" ".join(f"bad{k}###" for k in range(80)), False), ("\n".join(f"item{k} | thing{k} | other{k}" for k in range(30)), False), (LONG + "\n" + LONG.upper(), True)])
def test_verdict(spark, text, kept):
    assert q.rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().kept is kept


def test_clean_text_loses_failing_lines(spark):
    text = f"{LONG}\nHome | News | Sport | Contact\nSign in\nAll rights reserved."
    assert q.judged(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().clean == LONG
    whole = f"{LONG}\n\n  {LONG.upper()}\n"
    assert q.judged(spark.createDataFrame([(1, whole)], "doc_id long, text string")).first().clean == whole


def test_no_python_and_no_exchange(spark, sf):
    df = q.rules(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert q.rules(spark.read.parquet(f"{sf}/documents.parquet").limit(0)).count() == 0


def test_texts_with_more_windows_than_packed_places(spark, monkeypatch):
    """With 4 bits for a place, as with 24 for a text of more than 2^24 words."""
    monkeypatch.setattr(q, "_PLACE", 15)
    texts = [*TEXTS, " ".join(f"w{k % 30}" for k in range(60)), " ".join(f"w{k}" for k in range(18)), " ".join(["a b c"] * 6)]
    got = q.rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {k: base(t)[4] for k, t in enumerate(texts)}
