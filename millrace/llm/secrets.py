"""Secret scans over a trigram inverted index.

Each rule's regular expression yields a Boolean query of trigrams that every
match must hold. Texts come in blocks; a block is indexed once for the trigrams
of all rules, a rule's postings are intersected and joined as its query says,
and the expression runs over the candidates alone. Rules without a mandatory
trigram run over every text. Index and block live in the task, so the scan is
map-only and needs memory for one block: texts become Python objects a block at
a time, and the index looks at a stretch of their bytes at a time, so a text
larger than a block costs a few times its own size and no more.

The base kinds are assign, access and hex; the other rules add spans and take
none away. Places are code points, ends exclusive. A private key's span runs to
its END line, or to the end of its base64 lines where that line is missing.

Defined results: a null or empty text has no spans; texts of any length are
whole (one text larger than a block is a block); repeated rows repeat their
result; an empty table gives no rows; columns besides doc_id and text are only
read where they are returned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.trigrams import Index, query, trigrams

#: Bytes of text that are indexed together.
BLOCK = 4 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the least length of a group of it (0: the match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: What follows a BEGIN line: all up to an END line that is the next mark of five hyphens; without one, header lines and the base64 lines, a short last one included.
_KEY_BODY = (
    r"(?:(?:[^-]|-(?!----))*+-----END (?:[A-Z]+ )?PRIVATE KEY-----"
    r"|(?:\s*(?:Proc-Type|DEK-Info):[^\r\n]*)*+(?:(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{16,}={0,2})++(?:(?:[\r\n]|\\[nr])++[A-Za-z0-9+/]+={0,2}(?=[\r\n]|\Z))?)?)"
)
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----" + _KEY_BODY),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pay_key", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pgp_key", r"-----BEGIN PGP PRIVATE KEY BLOCK-----(?:(?:[^-]|-(?!----))*+-----END PGP PRIVATE KEY BLOCK-----)?"),
    Rule("project_token", r"gl(?:pat|ptt|dt|rt)-[A-Za-z0-9_-]{20,}"),
    Rule("package_token", r"npm_[A-Za-z0-9]{36,}"),
    Rule("index_token", r"pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{40,}"),
    Rule("mail_key", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"),
    Rule("fine_token", r"github_pat_[A-Za-z0-9_]{22,}"),
    Rule("storage_key", r"AccountKey=[A-Za-z0-9+/]{64,}={0,2}"),
    Rule("web_hook", r"https://hooks\.slack\.com/services/[A-Za-z0-9/+]{20,}"),
    Rule("bearer", r"[Aa]uthorization:\x20*(?:[Bb]earer|[Bb]asic)\x20+[A-Za-z0-9._~+/-]{16,}=*"),
    Rule("url_login", r"://[^/\s:@]+:[^/\s:@]{3,}@"),
)


class Scanner:
    """Finds the spans of the rules in blocks of texts."""

    def __init__(self, rules: tuple[Rule, ...] = BASE + MORE):
        self.rules = [(n, r, re.compile(_floor(r)), query(r.pattern)) for n, r in enumerate(rules)]
        self.index = Index(set().union(*(trigrams(q) for *_, q in self.rules)))

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, number of the rule, end) of each text, sorted."""
        self.index.build([t.encode() for t in texts])
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for n, rule, find, q in self.rules:
            for k in self.index.candidates(q).tolist():
                for m in find.finditer(texts[k]):
                    a, b = m.span(rule.group)
                    if b - a >= rule.least:
                        out[k].append((m.start(), n, m.end()))
        for spans in out:
            spans.sort()
        return out


def _floor(rule: Rule) -> str:
    """A rule that is one run of a class needs no match of runs too short."""
    run = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    return f"{run[1]}{{{rule.least},}}" if run and not rule.group else rule.pattern


def _blocks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows of ``BLOCK`` bytes at most; a larger row is a run."""
    start = held = 0
    for k, size in enumerate(sizes):
        if k > start and held + size > BLOCK:
            yield start, k
            start, held = k, 0
        held += size
    if len(sizes) > start:
        yield start, len(sizes)


def _pieces(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Pieces of batches of a block's size at most, with their texts."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
        for a, b in _blocks(sizes):
            piece = batch.slice(a, b - a)
            yield piece, [t or "" for t in piece.column(at).to_pylist()]


def _spelled(spans, kinds: list[str]) -> str:
    return ",".join([f"{kinds[n]}:{a}:{b}" for a, n, b in spans])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans, and all spans of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        kinds = [r.kind for _, r, *_ in scanner.rules]
        for batch, texts in _pieces(batches, 1):
            found = scanner.scan(texts)
            base = [[s for s in x if s[1] < len(BASE)] for x in found]
            counts = [pa.array([sum(s[1] == n for s in x) for x in base], pa.int64()) for n in range(len(BASE))]
            sha = pa.array([hashlib.sha256(_spelled(x, kinds).encode()).hexdigest() for x in base], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([_spelled(x, kinds) for x in found], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by the kindless mark ``[SECRET]``."""
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a >= end:
            if end >= 0:
                out.append("[SECRET]")
                at = end
            out.append(text[at:a])
            end = b
        else:
            end = max(end, b)
    return "".join([*out, "[SECRET]", text[end:]]) if end >= 0 else text


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns, with the secrets of ``text`` replaced; ``n_chars``, if there, follows."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch, texts in _pieces(batches, at):
            new = [redacted(t, s) if s else t for t, s in zip(texts, scanner.scan(texts))]
            nulls = batch.column(at).is_null().to_pylist()
            columns = list(batch.columns)
            columns[at] = pa.array([None if no else t for t, no in zip(new, nulls)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    out = docs.withColumn("text", F.col("text").cast("string"))
    out = out.mapInArrow(run, out.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
