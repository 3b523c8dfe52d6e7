"""PostgreSQL-flavoured SQL on Spark: statements are rewritten token by token.

What Spark's parser lacks is put in its own terms, and Catalyst does the rest:

* ``ORDER BY`` items get PostgreSQL's null order (ascending last, descending first);
* ``SELECT DISTINCT ON (k) ... ORDER BY`` becomes the first row of each key;
* ``FETCH FIRST n ROWS ONLY`` becomes LIMIT, ``WITH TIES`` a rank;
* ``x SIMILAR TO 'p'`` becomes an anchored RLIKE;
* ``x op ANY (array)`` / ``op ALL (array)`` become EXISTS / FORALL over the array,
  over a subquery (NOT) EXISTS with three-valued logic kept by the comparison;
* ``~ ~* !~ !~*`` become RLIKE; ``IS [NOT] DISTINCT FROM`` is Spark's own;
* ``^`` is power and ``#`` exclusive or; ``|/``, ``||/`` and ``@`` are sqrt, cbrt and abs;
* ``OVER (w ...)`` that extends a named window gets the window's body;
* ``GROUP BY DISTINCT`` is written out as its different grouping sets,
  ``grouping(a, b)`` as grouping_id, ``extract(epoch FROM x)`` as seconds;
* ``AS [NOT] MATERIALIZED`` is a hint that Spark has no use for;
* SQL/JSON constructors and query functions become plain calls (``sqljson``);
* ``last_value`` over a frame to the partition's end reads the whole partition;
* a subquery behind LIMIT or OFFSET is run first, for its one number;
* frames that start after their end, or have a negative offset, are refused;
* functions of PostgreSQL's names that are not Spark's are made when a statement calls them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from millrace.functions import named
from millrace.plans import sqljson

_TOKEN = re.compile(r"\s+|--[^\n]*|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|[A-Za-z_][A-Za-z_0-9]*|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?[A-Za-z]*|::|\|\|/|\|/|!~\*|!~|~\*|<=>|<=|>=|<>|!=|->>|->|=>|\|\||.", re.S)
#: Words that end an ORDER BY list on its own level.
_ENDS = {"LIMIT", "OFFSET", "FETCH", "ROWS", "RANGE", "GROUPS", "UNION", "INTERSECT", "EXCEPT", "WINDOW", "FOR"}


#: Words that a bracket may follow without being a call.
_WORDS = {"SELECT", "DISTINCT", "WHERE", "AND", "OR", "NOT", "ON", "WHEN", "THEN", "ELSE", "CASE", "BETWEEN", "HAVING", "BY", "LIMIT", "OFFSET", "SET", "RETURNING"}


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def _next(t: list[str], k: int, step: int = 1) -> int:
    """Index of the next token that is not blank, or where the list ends."""
    k += step
    while 0 <= k < len(t) and (t[k].isspace() or t[k].startswith("--")):
        k += step
    return k


def _close(t: list[str], k: int) -> int:
    """Index of the bracket that closes the one at k."""
    depth = 0
    for j in range(k, len(t)):
        depth += (t[j] in "([") - (t[j] in ")]") if t[j] else 0
        if depth == 0:
            return j
    raise ValueError("unbalanced brackets")


def _up(t: list[str], k: int) -> str:
    return t[k].upper() if 0 <= k < len(t) else ""


def _null_order(t: list[str]) -> list[str]:
    out, k = [], 0
    while k < len(t):
        if _up(t, k) == "ORDER" and _up(t, _next(t, k)) == "BY":
            j = _next(t, k)
            out += ["ORDER", " ", "BY"]
            k, depth, item = j + 1, 0, []

            def done(item: list[str]) -> list[str]:
                words = [x.upper() for x in item if not x.isspace()]
                if not words or "NULLS" in words or words == ["ALL"]:
                    return item
                while item and item[-1].isspace():
                    item = item[:-1]
                return [*item, " NULLS FIRST " if words[-1] == "DESC" else " NULLS LAST "]

            while k < len(t):
                if depth == 0 and (t[k] == ")" or _up(t, k) in _ENDS or t[k] == ";"):
                    break
                if depth == 0 and t[k] == ",":
                    out += [*done(_null_order(item)), ","]
                    item = []
                else:
                    depth += (t[k] in ("(", "[")) - (t[k] in (")", "]"))
                    item.append(t[k])
                k += 1
            out += done(_null_order(item))
            continue
        out.append(t[k])
        k += 1
    return out


def similar_pattern(pattern: str, escape: str = "\\") -> str:
    """A regular expression for a SIMILAR TO pattern."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == escape and k + 1 < len(pattern):
            out.append(re.escape(pattern[k + 1]))
            k += 1
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c == "[":
            end = pattern.index("]", k + 1)
            out.append(pattern[k : end + 1])
            k = end
        elif c in ".^$\\":
            out.append("\\" + c)
        else:
            out.append(c)
        k += 1
    return "^(?s:" + "".join(out) + ")$"


def _operand(out: list[str]) -> tuple[list[str], list[str]]:
    """The operand that the tokens end with: a name, literal, call or bracketed term, with casts and fields."""
    k = len(out)
    while k and out[k - 1].isspace():
        k -= 1
    while k:
        if out[k - 1] in (")", "]"):
            depth = 0
            while k:
                k -= 1
                depth += (out[k] in (")", "]")) - (out[k] in ("(", "["))
                if depth == 0:
                    break
            if k and re.fullmatch(r"\w+", out[k - 1]) and out[k - 1].upper() not in ("AND", "OR", "WHERE", "NOT", "WHEN", "ON", "SELECT"):
                k -= 1
        else:
            k -= 1
        if k and out[k - 1] in (".", "::"):
            k -= 1
            continue
        break
    return out[:k], out[k:]


def _predicates(t: list[str]) -> list[str]:
    out: list[str] = []
    k = 0
    while k < len(t):
        word = _up(t, k)
        if word == "SIMILAR" and _up(t, _next(t, k)) == "TO":
            j = _next(t, _next(t, k))
            pattern = t[j][1:-1].replace("''", "'")
            k = j
            escape = "\\"
            if _up(t, _next(t, j)) == "ESCAPE":
                k = _next(t, _next(t, j))
                escape = t[k][1:-1]
            out += ["RLIKE ", "'" + similar_pattern(pattern, escape).replace("\\", "\\\\").replace("'", "\\'") + "'"]
        elif t[k] in ("~", "~*", "!~", "!~*") and _operand(out)[1] and _next(t, k) < len(t) and t[_next(t, k)].startswith("'"):
            j = _next(t, k)
            pattern = ("(?i)" if t[k].endswith("*") else "") + t[j][1:-1]
            out += [("NOT " if t[k][0] == "!" else "") + "RLIKE ", "'" + pattern.replace("\\", "\\\\") + "'"]
            k = j
        elif t[k] in ("=", "<>", "!=", "<", ">", "<=", ">=") and _up(t, _next(t, k)) in ("ANY", "SOME", "ALL") and t[_next(t, _next(t, k))] == "(":
            op, which = t[k], _up(t, _next(t, k))
            a = _next(t, _next(t, k))
            z = _close(t, a)
            inner = _predicates(t[a + 1 : z])
            rest, left = _operand(out)
            x, body = "".join(left).strip(), "".join(inner).strip()
            if re.match(r"(?i)\s*(select|with|values)\b", body):
                name = f"_q{len(out)}"
                if which == "ALL":
                    out = [*rest, f"NOT EXISTS (SELECT 1 FROM ({body}) AS {name}(_v) WHERE coalesce(NOT ({x} {op} {name}._v), true))"]
                else:
                    out = [*rest, f"EXISTS (SELECT 1 FROM ({body}) AS {name}(_v) WHERE {x} {op} {name}._v)"]
            else:
                f = "forall" if which == "ALL" else "exists"
                out = [*rest, f"{f}({body}, _e -> {x} {op} _e)"]
            k = z
        else:
            out.append(t[k])
        k += 1
    return out


def _top_level(t: list[str], word: str, start: int = 0) -> int:
    depth = 0
    for k in range(start, len(t)):
        depth += (t[k] in ("(", "[")) - (t[k] in (")", "]"))
        if depth == 0 and _up(t, k) == word:
            return k
    return -1


def _right(t: list[str], k: int) -> tuple[str, int]:
    """The operand that begins at token k, and the token after it."""
    start = k
    if t[k] in ("-", "+"):
        k = _next(t, k)
    if t[k] == "(":
        k = _close(t, k) + 1
    else:
        k += 1
    while k < len(t) and t[k] in (".", "::", "(", "["):
        k = _close(t, k) + 1 if t[k] in ("(", "[") else k + 2
    return "".join(t[start:k]), k


def _operators(t: list[str]) -> list[str]:
    """Arithmetic operators that Spark lacks or reads otherwise; applied inside brackets first."""
    out: list[str] = []
    k = 0
    prefix = {"|/": "sqrt", "||/": "cbrt", "@": "abs"}
    while k < len(t):
        if t[k] == "^":
            rest, left = _operand(out)
            right, k = _right(t, _next(t, k))
            out = [*rest, f"power({''.join(left).strip()}, {''.join(_operators(tokens(right)))})"]
            continue
        if t[k] == "#":
            out.append("^")
        elif t[k] in prefix:
            f = prefix[t[k]]
            right, k = _right(t, _next(t, k))
            out.append(f"{f}({''.join(_operators(tokens(right)))})")
            continue
        else:
            out.append(t[k])
        k += 1
    return out


def _named_windows(t: list[str]) -> list[str]:
    bodies: dict[str, str] = {}
    for k in range(len(t)):
        if _up(t, k) == "WINDOW" or (t[k] == "," and bodies):
            n = _next(t, k)
            a = _next(t, _next(t, n))
            if _up(t, _next(t, n)) == "AS" and a < len(t) and t[a] == "(":
                bodies[t[n]] = "".join(t[a + 1 : _close(t, a)])
    out: list[str] = []
    for k, x in enumerate(t):
        p = _next(t, k, -1)
        opens = x in bodies and p >= 0 and t[p] == "(" and _up(t, _next(t, p, -1)) == "OVER"
        out.append(bodies[x] if opens and t[_next(t, k)] != ")" else x)
    return out


def _split(t: list[str]) -> list[list[str]]:
    """Items between the commas of the top level."""
    out, depth = [[]], 0
    for x in t:
        depth += (x in ("(", "[")) - (x in (")", "]"))
        if x == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(x)
    return [x for x in out if "".join(x).strip()]


def _items(t: list[str]) -> list[str]:
    """The same as texts."""
    return ["".join(x) for x in _split(t)]


def _sets(item: list[str]) -> list[tuple[str, ...]]:
    """The grouping sets that an item of GROUP BY stands for."""
    words = [k for k in range(len(item)) if not item[k].isspace()]
    head = item[words[0]].upper()
    a = next((k for k in words if item[k] == "("), None)
    plain = lambda x: tuple("".join(y).strip() for y in _split(x))
    parts = lambda: [plain(x[1:-1]) if x[0] == "(" and _close(x, 0) == len(x) - 1 else ("".join(x),) for x in (tokens("".join(y).strip()) for y in _split(item[a + 1 : _close(item, a)]))]
    flat = lambda groups: tuple(dict.fromkeys(c for g in groups for c in g))
    if head == "ROLLUP":
        p = parts()
        return [flat(p[:n]) for n in range(len(p), -1, -1)]
    if head == "CUBE":
        p = parts()
        return [flat(g for b, g in enumerate(p) if not mask >> b & 1) for mask in range(1 << len(p))]
    if head == "GROUPING":
        return [s for x in _split(item[a + 1 : _close(item, a)]) for s in _sets(x)]
    if item[words[0]] == "(":
        return [plain(item[words[0] + 1 : _close(item, words[0])])]
    return [("".join(item).strip(),)]


def _group_by(t: list[str]) -> list[str]:
    out: list[str] = []
    k = 0
    while k < len(t):
        word = _up(t, k)
        b = _next(t, k)
        if word == "GROUP" and _up(t, b) == "BY" and _up(t, _next(t, b)) in ("DISTINCT", "ALL"):
            d = _next(t, b)
            end, depth = d + 1, 0
            while end < len(t) and not (depth == 0 and (t[end] in (")", ";") or _up(t, end) in _ENDS | {"HAVING", "ORDER"})):
                depth += (t[end] in ("(", "[")) - (t[end] in (")", "]"))
                end += 1
            items = _split(t[d + 1 : end])
            if _up(t, d) == "ALL" and items:
                out += ["GROUP BY ", *t[d + 1 : end]]
                k = end
                continue
            if items:
                sets: list[tuple[str, ...]] = [()]
                for item in items:
                    sets = [(*a, *(c for c in s if c not in a)) for a in sets for s in _sets(item)]
                different = {frozenset(s): s for s in reversed(sets)}
                out.append("GROUP BY GROUPING SETS (" + ", ".join(f"({', '.join(s)})" for s in reversed(different.values())) + ") ")
                k = end
                continue
        if word == "GROUPING" and t[b : b + 1] == ["("] and len(_split(t[b + 1 : _close(t, b)])) > 1:
            out.append("grouping_id")
        elif word == "EXTRACT" and t[b : b + 1] == ["("] and _up(t, _next(t, b)) == "EPOCH":
            z = _close(t, b)
            f = _top_level(t, "FROM", b + 1)
            out.append(f"(unix_micros(CAST({''.join(t[f + 1 : z]).strip()} AS TIMESTAMP)) / 1000000D)")
            k = z
        elif word == "MATERIALIZED" and t[b : b + 1] == ["("]:
            p = _next(t, k, -1)
            if _up(t, p) == "NOT":
                while out and (out[-1].isspace() or out[-1].upper() == "NOT"):
                    out.pop()
                out.append(" ")
        else:
            out.append(t[k])
        k += 1
    return out


def _flat(parts: list[str]) -> list[str]:
    return tokens("".join(parts))


def _fetch(t: list[str]) -> list[str]:
    k = _top_level(t, "FETCH")
    if k < 0:
        return t
    j = _next(t, _next(t, k))
    n = t[j] if t[j].isdigit() else "1"
    tail = "".join(t[j:]).upper()
    if "TIES" not in tail:
        return [*t[:k], f"LIMIT {n}"]
    o = _top_level(t, "ORDER")
    order = "".join(t[_next(t, _next(t, o)) - 1 : k]).strip()
    return [f"SELECT * EXCEPT (_rank) FROM (SELECT *, rank() OVER (ORDER BY {order}) AS _rank FROM (", *t[:o], f")) WHERE _rank <= {n}"]


def _distinct_on(t: list[str]) -> list[str]:
    """A statement that begins SELECT DISTINCT ON; subqueries are rewritten by their own brackets."""
    out, k = [], 0
    while k < len(t):
        if t[k] == "(":
            z = _close(t, k)
            out += ["(", *_distinct_on(t[k + 1 : z]), ")"]
            k = z + 1
            continue
        out.append(t[k])
        k += 1
    out = _flat(out)
    s = _next(out, -1)
    d = _next(out, s)
    o = _next(out, d)
    if not (_up(out, s) == "SELECT" and _up(out, d) == "DISTINCT" and _up(out, o) == "ON"):
        return out
    a = _next(out, o)
    z = _close(out, a)
    keys = "".join(out[a + 1 : z])
    f, order = _top_level(out, "FROM", z + 1), _top_level(out, "ORDER", z + 1)
    limit = _top_level(out, "LIMIT", z + 1)
    end = order if order >= 0 else (limit if limit >= 0 else len(out))
    by = "".join(out[order : limit if limit >= 0 else len(out)]) if order >= 0 else f"ORDER BY {keys}"
    columns, source = "".join(out[z + 1 : f]).strip(), "".join(out[f:end])
    return [f"SELECT * EXCEPT (_nth) FROM (SELECT {columns}, row_number() OVER (PARTITION BY {keys} {by}) AS _nth {source}) WHERE _nth = 1 ", *(out[limit:] if limit >= 0 else [])]


def _calls(t: list[str]) -> list[str]:
    """SQL/JSON and other calls that take more than a change of name, from the innermost outward."""
    out, k = [], 0
    while k < len(t):
        b = _next(t, k)
        word = _up(t, k)
        if word == "(":
            z = _close(t, k)
            own = [x for x in t[k + 1 : z] if x.strip()]
            if len(own) > 2 and own[-2] == "::" and own[-1].upper() == "JSONB" and t[_next(t, z) : _next(t, z) + 1] == ["["]:
                path = []
                while t[_next(t, z) : _next(t, z) + 1] == ["["]:
                    a = _next(t, z)
                    z = _close(t, a)
                    path.append(f"CAST({''.join(_calls(t[a + 1 : z])).strip()} AS STRING)")
                out += tokens(f"jsonb_at({''.join(_calls(own))}, array({', '.join(path)}))")
                k = z + 1
                continue
        if word in ("JSON", "JSONB"):
            before = next((x for x in reversed(out) if x.strip()), "")
            if before == "::" or before.upper() == "AS" and _up(t, b) == ")":
                out.append("STRING")
                k += 1
                continue
            if t[b : b + 1] and t[b].startswith("'"):  # a typed literal
                k += 1
                continue
        if re.fullmatch(r"[A-Z_][A-Z_0-9]*", word) and word not in _WORDS and t[b : b + 1] == ["("]:
            z = _close(t, b)
            inner = _calls(t[b + 1 : z])
            parts = _items(inner)
            if word in ("JSON_VALUE", "JSON_QUERY", "JSON_EXISTS") and len(parts) > 1:
                comma = len(tokens(parts[0]))
                inner = tokens("".join(inner))
                new = sqljson.query_function(word, parts[0].strip(), inner[comma + 1 :], lambda x: _items(tokens(x)))
            else:
                new = sqljson.constructor(word, *_arguments(word, parts))
            out += tokens(new) if new is not None else [t[k], *t[k + 1 : b + 1], *inner, ")"]
            k = z + 1
            continue
        out.append(t[k])
        k += 1
    return out


def _arguments(word: str, parts: list[str]) -> tuple[list[str], bool]:
    """Arguments of a constructor without its clauses, and whether nulls are left out."""
    if not word.startswith("JSON"):
        return [p.strip() for p in parts], True
    absent = word != "JSON_OBJECTAGG"
    args = []
    for p in parts:
        own = re.search(r"(?i)\s+(NULL|ABSENT)\s+ON\s+NULL\s*(?=$|RETURNING\b)", f" {p}")
        absent = own[1].upper() == "ABSENT" if own else absent
        p = re.sub(r"(?i)\s*\b(NULL|ABSENT)\s+ON\s+NULL\s*(?=$|RETURNING\b)", " ", p)
        p = re.sub(r"(?i)\s*\bRETURNING\s+\w+\s*$", "", p).strip()
        p = re.sub(r"(?i)\s*\bWITH(OUT)?\s+UNIQUE(\s+KEYS)?\s*$", "", p).strip()
        if word in ("JSON_OBJECT", "JSON_OBJECTAGG"):
            t = tokens(p)
            at = next((k for k in (_top_level(t, "VALUE"), _top_level(t, ":")) if k > 0), -1)
            args += ["".join(t[:at]).strip(), "".join(t[at + 1 :]).strip()] if at > 0 else [p] if p else []
        elif p:
            args.append(p)
    return args, absent


def _frames(t: list[str]) -> None:
    """Refuse the frames that PostgreSQL refuses and Spark takes."""
    for k, x in enumerate(t):
        if x.upper() not in ("PRECEDING", "FOLLOWING"):
            continue
        p = _next(t, k, -1)
        m = _next(t, p, -1)
        if m >= 0 and t[m] == "-" and t[p][:1].isdigit() and _up(t, _next(t, m, -1)) in ("ROWS", "RANGE", "GROUPS", "BETWEEN", "AND"):
            raise ValueError("frame offset must not be negative (SQLSTATE 22013)")
        a = _next(t, p, -1)
        if x.upper() == "PRECEDING" and _up(t, a) == "AND" and _up(t, _next(t, a, -1)) == "ROW":
            raise ValueError("frame starting from current row cannot have preceding rows (SQLSTATE 42P20)")


def _whole_frames(t: list[str]) -> list[str]:
    """last_value over a frame that holds its own row and ends with the partition is that of the whole partition, which
    Spark reads once; it would go over the rest of the partition for each row else."""
    out = list(t)
    for k, x in enumerate(t):
        if x.upper() != "OVER" or _up(t, _next(t, k)) != "(":
            continue
        a = _next(t, k, -1)
        depth = 0
        for b in range(a, -1, -1):
            depth += (t[b] in ")]") - (t[b] in "([")
            if depth == 0:
                break
        if t[a] != ")" or _up(t, _next(t, b, -1)) != "LAST_VALUE" or len(_items(t[b + 1 : a])) != 1 or any(y.upper() == "NULLS" for y in t[b:a]):
            continue
        o = _next(t, k)
        z = _close(t, o)
        words = [i for i in range(o + 1, z) if t[i].strip()]
        frame = next((n for n, i in enumerate(words) if t[i].upper() in ("ROWS", "RANGE") and _up(t, words[min(n + 1, len(words) - 1)]) == "BETWEEN"), None)
        if frame is None:
            continue
        own = [t[i].upper() for i in words[frame + 2 :]]
        if own[-3:] == ["AND", "UNBOUNDED", "FOLLOWING"] and (own[:-3] == ["CURRENT", "ROW"] or own[-4:-3] == ["PRECEDING"]):
            for i in words[frame + 2 :]:
                out[i] = ""
            out[words[frame + 2]] = "UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    return out


def rewrite(text: str) -> str:
    """The statement in Spark's dialect."""
    t = tokens(text.strip().rstrip(";"))
    _frames(t)
    t = _flat(_calls(t))
    t = _flat(_named_windows(t))
    t = _flat(_whole_frames(t))
    t = _flat(_group_by(t))
    t = _flat(_operators(t))
    t = _predicates(t)
    t = tokens("".join(_null_order(t)))
    t = tokens("".join(_fetch(t)))
    return "".join(_distinct_on(t))


#: PostgreSQL's names of settings that Spark has under another name.
_SETTINGS = {"timezone": "spark.sql.session.timeZone", "search_path": "spark.sql.defaultCatalog"}


def _session_calls(spark: SparkSession, t: list[str]) -> list[str]:
    """current_setting and set_config with constant arguments, and random() after setseed(), from the session's settings."""
    out, k = [], 0
    while k < len(t):
        b, word = _next(t, k), _up(t, k)
        if word in ("CURRENT_SETTING", "SET_CONFIG", "SETSEED", "RANDOM") and t[b : b + 1] == ["("]:
            z = _close(t, b)
            args = [x.strip() for x in _items(t[b + 1 : z])]
            if word == "RANDOM":
                seed = spark.conf.get("millrace.seed", None)
                out.append(f"rand({seed})" if seed else "rand()")
            elif word == "SETSEED":
                spark.conf.set("millrace.seed", str(int(float(args[0]) * (1 << 31))))
                out.append("CAST(NULL AS STRING)")
            else:
                name = args[0].strip("'")
                name = _SETTINGS.get(name.lower(), name)
                if word == "SET_CONFIG":
                    spark.conf.set(name, args[1].strip("'"))
                value = spark.conf.get(name, None)
                if value is None and not (len(args) == 2 and args[1].lower() == "true"):
                    raise ValueError(f"unrecognized configuration parameter {name!r}")
                out.append("CAST(NULL AS STRING)" if value is None else "'" + value.replace("'", "''") + "'")
            k = z + 1
            continue
        out.append(t[k])
        k += 1
    return out


def _limits(spark: SparkSession, t: list[str], args: dict) -> list[str]:
    """Subqueries behind LIMIT and OFFSET by their values, so that a limit is one for Spark's planner too; NULL is none."""
    out, k = [], 0
    while k < len(t):
        b, word = _next(t, k), _up(t, k)
        if word in ("LIMIT", "OFFSET") and t[b : b + 1] == ["("] and _up(t, _next(t, b)) in ("SELECT", "WITH"):
            z = _close(t, b)
            rows = run_sql(spark, "".join(t[b + 1 : z]), **args).limit(2).collect()
            if len(rows) > 1:
                raise ValueError("more than one row returned by a subquery used as an expression (SQLSTATE 21000)")
            n = rows[0][0] if rows else None
            if n is not None and n < 0:
                raise ValueError(f"{word} must not be negative (SQLSTATE {'2201W' if word == 'LIMIT' else '2201X'})")
            out += [f"{word} {int(n)}" if n is not None else ""]
            k = z + 1
            continue
        out.append(t[k])
        k += 1
    return out


def run_sql(spark: SparkSession, text: str, **args) -> DataFrame:
    text = "".join(_limits(spark, tokens("".join(_session_calls(spark, tokens(text)))), args))
    text = rewrite(text)
    t = tokens(text)
    named.install(spark, {x.lower() for k, x in enumerate(t) if t[_next(t, k) : _next(t, k) + 1] == ["("]})
    return spark.sql(text, args=args) if args else spark.sql(text)
