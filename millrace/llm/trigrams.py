"""Boolean trigram queries of regular expressions, and a trigram index to answer them.

``query`` walks a parsed expression and keeps, for each part, the finite set of
strings it can match if there is one, and otherwise the strings it can begin and
end with and what any match must hold. The result is True (no trigram is
mandatory), a trigram, or ("and" | "or", parts). Letters are lower-cased on both
sides, so a query may accept more texts than the expression, never fewer.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser as parser

import numpy as np

#: Most strings kept in a set, and most characters of a class that are spelled out.
MOST, SPELLED = 48, 4
#: Bytes whose trigrams are looked up at once.
STRETCH = 1 << 20


def _all(op: str, parts: list) -> object:
    """and / or of the parts, flattened."""
    neutral = op == "and"
    flat: list = []
    for p in parts:
        if p is True:
            if not neutral:
                return True
            continue
        flat += p[1] if isinstance(p, tuple) and p[0] == op else [p]
    flat = list(dict.fromkeys(flat))
    if not flat:
        return True
    return flat[0] if len(flat) == 1 else (op, tuple(flat))


def _holds(strings: set[str]) -> object:
    """What a text must hold that holds one of the strings."""
    if not strings:
        return True
    return _all("or", [_all("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


@dataclass
class _Part:
    exact: set[str] | None
    prefix: set[str]
    suffix: set[str]
    must: object = True

    def open(self) -> _Part:
        """The same without a finite set."""
        if self.exact is None:
            return self
        return _Part(None, {s[:2] for s in self.exact}, {s[-2:] for s in self.exact}, _all("and", [self.must, _holds(self.exact)]))


_ANY = lambda: _Part(None, {""}, {""})


def _then(x: _Part, y: _Part) -> _Part:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MOST:
        return _Part({a + b for a, b in product(x.exact, y.exact)}, set(), set(), _all("and", [x.must, y.must]))
    ends = x.exact if x.exact is not None else x.suffix
    begins = y.exact if y.exact is not None else y.prefix
    across = _holds({a[-2:] + b[:2] for a, b in product(ends, begins)})
    a, b = x.open(), y.open()
    prefix = {(p + q)[:2] for p, q in product(x.exact, b.prefix)} if x.exact is not None else a.prefix
    suffix = {(p + q)[-2:] for p, q in product(a.suffix, y.exact)} if y.exact is not None else b.suffix
    return _Part(None, prefix if len(prefix) <= MOST else {""}, suffix if len(suffix) <= MOST else {""}, _all("and", [a.must, b.must, across]))


def _either(parts: list[_Part]) -> _Part:
    if all(p.exact is not None and p.must is True for p in parts) and len(union := set().union(*(p.exact for p in parts))) <= MOST:
        return _Part(union, set(), set())
    parts = [p.open() for p in parts]
    return _Part(None, set().union(*(p.prefix for p in parts)), set().union(*(p.suffix for p in parts)), _all("or", [p.must for p in parts]))


def _class(items) -> _Part:
    found: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            found.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < SPELLED:
            found |= {chr(k).lower() for k in range(value[0], value[1] + 1)}
        else:
            return _ANY()
    return _Part(found, set(), set()) if len(found) <= SPELLED else _ANY()


def _walk(tokens) -> _Part:
    out = _Part({""}, set(), set())
    for op, value in tokens:
        if op is C.LITERAL:
            part = _Part({chr(value).lower()}, set(), set())
        elif op is C.IN:
            part = _class(value)
        elif op is C.SUBPATTERN:
            part = _walk(value[3])
        elif op is C.BRANCH:
            part = _either([_walk(x) for x in value[1]])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, inner = value
            one = _walk(inner)
            if least == 0:
                part = _either([_Part({""}, set(), set()), one]) if most == 1 else _ANY()
            else:
                part = one
                for _ in range(min(least, 4) - 1):
                    part = _then(part, one)
                if most != least or least > 4:
                    part = part.open()
                    part = _Part(None, part.prefix, {""} if one.exact is None or least > 4 else part.suffix, part.must)
                    part = _Part(None, part.prefix, {""}, part.must)
        elif op is C.AT:
            continue
        else:
            part = _ANY()
        out = _then(out, part)
    return out


def query(pattern: str) -> object:
    """Boolean query over lower-case trigrams that every match's text satisfies."""
    return _walk(parser.parse(pattern)).open().must


def trigrams(q: object) -> set[str]:
    if q is True:
        return set()
    return {q} if isinstance(q, str) else set().union(*(trigrams(p) for p in q[1]))


class Index:
    """Postings of chosen trigrams over a block of texts, from one pass over their bytes."""

    _lower = np.arange(256, dtype=np.uint8)
    _lower[65:91] += 32

    def __init__(self, wanted: set[str]):
        self.codes = {t: int.from_bytes(t.encode("latin-1"), "big") for t in wanted}
        self.table = np.zeros(1 << 24, bool)
        self.table[list(self.codes.values())] = True
        self.postings: dict[int, np.ndarray] = {}
        self.size = 0

    def build(self, texts: list[bytes]) -> None:
        """Index the texts; posting lists are sorted numbers of texts."""
        self.size, self.postings = len(texts), {}
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        found = [self._pairs(data, ends, k) for k in range(0, max(0, len(data) - 2), STRETCH)]
        if not found:
            return
        pairs = np.unique(np.concatenate(found))
        code = (pairs >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.diff(code)) + 1
        for group in np.split(np.arange(len(pairs)), cut):
            if len(group):
                self.postings[int(code[group[0]])] = (pairs[group] & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def _pairs(self, data: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
        """Trigrams that begin in a stretch of the bytes, each with its text, packed and without repeats."""
        own = self._lower[data[start : start + STRETCH + 2]]
        codes = own[:-2].astype(np.uint32) << 16
        codes |= own[1:-1].astype(np.uint32) << 8
        codes |= own[2:]
        at = np.flatnonzero(self.table[codes])
        code, at = codes[at].astype(np.uint64), at + start
        text = np.searchsorted(ends, at, "right")
        inside = at + 3 <= ends[text]
        return np.unique(code[inside] << np.uint64(32) | text[inside].astype(np.uint64))

    def candidates(self, q: object) -> np.ndarray:
        """Numbers of the texts that satisfy the query, ascending."""
        if q is True:
            return np.arange(self.size)
        if isinstance(q, str):
            return self.postings.get(self.codes[q], np.empty(0, np.int64))
        lists = [self.candidates(p) for p in q[1]]
        if q[0] == "or":
            return np.unique(np.concatenate(lists))
        lists.sort(key=len)
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True)
        return out
