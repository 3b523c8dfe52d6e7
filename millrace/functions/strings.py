"""PostgreSQL string and regular-expression functions that Spark lacks or does otherwise."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.udfs import udf
from millrace.registry import sql


def chr_(n: Column) -> Column:
    """The character of a code point (Spark's chr is modulo 256)."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def concat_(*args: Column) -> Column:
    """Concatenation that skips nulls."""
    return F.concat_ws("", *args)


def encode_(data: Column, how: str) -> Column:
    return {"hex": F.lower(F.hex(data)), "base64": F.base64(data)}[how]


def decode_(text: Column, how: str) -> Column:
    return {"hex": F.unhex(text), "base64": F.unbase64(text)}[how]


def to_hex(n: Column) -> Column:
    return F.lower(F.hex(n))


def quote_literal(s: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'"))


def quote_nullable(s: Column) -> Column:
    return F.coalesce(quote_literal(s), F.lit("NULL"))


def quote_ident(s: Column) -> Column:
    """In double quotes unless it is a plain lower-case name."""
    return F.when(s.rlike("^[a-z_][a-z0-9_$]*$"), s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def substr_(s: Column, start: int, count: int | None = None) -> Column:
    """Characters from start; a start before 1 uses up the count (Spark counts from the end)."""
    if count is None:
        return F.substring(s, max(start, 1), 1 << 30)
    end = start + count
    return F.substring(s, max(start, 1), max(0, end - max(start, 1)))


def string_to_array(s: Column, sep: str) -> Column:
    return F.split(s, re.escape(sep))


def regexp_replace_(s: Column, pattern: str, to: str, flags: str = "") -> Column:
    """The first match only, unless the flags hold g."""
    flag = "(?i)" if "i" in flags else ""
    if "g" in flags:
        return F.regexp_replace(s, flag + pattern, re.sub(r"\\(\d)", r"$\1", to))
    first = F.regexp_extract(s, f"{flag}(?s)^(.*?)({pattern})(.*)$", 1)
    rest = F.regexp_replace(s, f"{flag}(?s)^(.*?){pattern}", "")
    return F.when(s.rlike(flag + pattern), F.concat(first, F.lit(to), rest)).otherwise(s)


def regexp_match(s: Column, pattern: str) -> Column:
    """Groups of the first match (the match, if there are none), null without one."""
    n = re.compile(pattern).groups
    parts = [F.regexp_extract(s, pattern, k) for k in (range(1, n + 1) if n else [0])]
    return F.when(s.rlike(pattern), F.array(*parts))


def regexp_nth(s: Column, pattern: str, nth: int) -> Column:
    """The n-th match."""
    return F.get(F.regexp_extract_all(s, F.lit(f"({pattern})")), F.lit(nth - 1))


@udf("string", "pg_initcap")
def initcap_(s):
    """Words end at anything but letters and digits (Spark: at blanks)."""
    return None if s is None else re.sub(r"[^\W_]+", lambda m: m[0][0].upper() + m[0][1:].lower(), s)


@udf("string", "normalize")
def normalize(s, form="NFC"):
    return None if s is None else unicodedata.normalize(form or "NFC", s)


@udf("boolean", "is_normalized")
def is_normalized(s, form="NFC"):
    return None if s is None else unicodedata.is_normalized(form or "NFC", s)


@udf("string")
def to_ascii(s):
    return None if s is None else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()


@udf("string")
def unistr(s):
    """Resolves \\XXXX, \\+XXXXXX, \\uXXXX and \\UXXXXXXXX."""
    if s is None:
        return None
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|\+([0-9A-Fa-f]{6})|([0-9A-Fa-f]{4})|(\\))", lambda m: "\\" if m[5] else chr(int(m[1] or m[2] or m[3] or m[4], 16)), s)


@udf("array<string>")
def parse_ident(s):
    if s is None:
        return None
    parts = re.findall(r'"((?:[^"]|"")*)"|([^.\s"]+)', s)
    return [a.replace('""', '"') if a else b.lower() for a, b in parts]


def _literal(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _ident(v: str) -> str:
    return v if re.fullmatch("[a-z_][a-z0-9_$]*", v) else '"' + v.replace('"', '""') + '"'


@udf("string")
def format_(pattern, args):
    """format() with %s, %I, %L, %%, n$ places and widths."""
    if pattern is None:
        return None
    at = [0]

    def put(m):
        if m[0] == "%%":
            return "%"
        k = int(m[1]) - 1 if m[1] else at[0]
        at[0] = k + 1
        v = args[k]
        out = {"s": lambda: v or "", "I": lambda: _ident(v), "L": lambda: _literal(v)}[m[4]]()
        return (out.ljust if m[2] else out.rjust)(int(m[3] or 0))

    return re.sub(r"%(?:(\d+)\$)?(-)?(\d+)?([sIL])|%%", put, pattern)


@udf("string", "pg_size_pretty")
def size_pretty(n):
    """pg_size_pretty."""
    if n is None:
        return None
    for unit in ("bytes", "kB", "MB", "GB", "TB"):
        if abs(n) < 10240 or unit == "TB":
            return f"{n} {unit}"
        n = (n // 1024 if unit == "bytes" else n // 1024) if unit != "bytes" else (n + 512) // 1024
    return str(n)


sql("fn_string_basic", """SELECT p_partkey, ascii(p_name) AS a, bit_length(p_name) AS b, btrim('  x ') AS c, char_length(p_name) AS d, lower(p_name) AS e, upper(p_name) AS f, lpad(p_brand, 12, '*') AS g, rpad(p_brand, 12, '-') AS h,
ltrim('  x') AS i, rtrim('x  ') AS j, md5(p_name) AS k, octet_length(p_name) AS l, position('a' IN p_name) AS m, repeat(p_brand, 2) AS n, replace(p_name, 'a', 'A') AS o, reverse(p_name) AS p, left(p_name, 3) AS q, right(p_name, 2) AS r FROM part""",
    """SELECT p_partkey, ascii(p_name) AS a, strlen(p_name)::INTEGER * 8 AS b, trim('  x ') AS c, length(p_name)::INTEGER AS d, lower(p_name) AS e, upper(p_name) AS f, lpad(p_brand, 12, '*') AS g, rpad(p_brand, 12, '-') AS h,
ltrim('  x') AS i, rtrim('x  ') AS j, md5(p_name) AS k, strlen(p_name)::INTEGER AS l, position('a' IN p_name)::INTEGER AS m, repeat(p_brand, 2) AS n, replace(p_name, 'a', 'A') AS o, reverse(p_name) AS p, left(p_name, 3) AS q, right(p_name, 2) AS r FROM part""")
sql("fn_string_more", """SELECT p_partkey, concat_ws('-', p_brand, NULL, p_type) AS a, concat_ws('', p_brand, NULL) AS b, split_part(p_type, ' ', 2) AS c, startswith(p_name, 'a') AS d, instr(p_name, 'e') AS e, substring(p_name, 2, 3) AS f,
translate(p_name, 'abc', 'xyz') AS g, overlay(p_name PLACING '##' FROM 2 FOR 3) AS h, sha2(p_name, 256) AS i, lower(hex(p_size)) AS j FROM part""",
    """SELECT p_partkey, concat_ws('-', p_brand, NULL, p_type) AS a, concat_ws('', p_brand, NULL) AS b, split_part(p_type, ' ', 2) AS c, starts_with(p_name, 'a') AS d, instr(p_name, 'e')::INTEGER AS e, substring(p_name, 2, 3) AS f,
translate(p_name, 'abc', 'xyz') AS g, left(p_name, 1) || '##' || substr(p_name, 5) AS h, sha256(p_name) AS i, lower(to_hex(p_size)) AS j FROM part""")
sql("fn_regexp", """SELECT p_partkey, regexp_count(p_name, '[aeiou]') AS a, regexp_instr(p_name, '[xyz]') > 0 AS b, regexp_like(p_type, '(?i)steel') AS c, regexp_replace(p_name, '[aeiou]', '_') AS d, regexp_substr(p_name, '[b-d]+') AS e,
array_join(split(p_type, '[ ]+'), '|') AS f, regexp_extract(p_brand, '#([0-9])', 1) AS g FROM part""",
    """SELECT p_partkey, len(regexp_extract_all(p_name, '[aeiou]'))::INTEGER AS a, regexp_matches(p_name, '[xyz]') AS b, regexp_matches(p_type, '(?i)steel') AS c, regexp_replace(p_name, '[aeiou]', '_', 'g') AS d, nullif(regexp_extract(p_name, '[b-d]+'), '') AS e,
array_to_string(regexp_split_to_array(p_type, '[ ]+'), '|') AS f, regexp_extract(p_brand, '#([0-9])', 1) AS g FROM part""")
