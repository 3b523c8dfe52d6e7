"""PostgreSQL mathematical functions that Spark lacks or does otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.udfs import udf
from millrace.registry import sql


def _exact(x: Column, points: dict[int, float], otherwise: Column) -> Column:
    out = otherwise
    for deg, v in points.items():
        out = F.when(F.pmod(x, F.lit(360)) == deg % 360, F.lit(v)).otherwise(out)
    return out


def sind(x: Column) -> Column:
    return _exact(x, {0: 0.0, 30: 0.5, 90: 1.0, 150: 0.5, 180: 0.0, 210: -0.5, 270: -1.0, 330: -0.5}, F.sin(F.radians(x)))


def cosd(x: Column) -> Column:
    return _exact(x, {0: 1.0, 60: 0.5, 90: 0.0, 120: -0.5, 180: -1.0, 240: -0.5, 270: 0.0, 300: 0.5}, F.cos(F.radians(x)))


def tand(x: Column) -> Column:
    return _exact(x, {0: 0.0, 45: 1.0, 135: -1.0, 180: 0.0, 225: 1.0, 315: -1.0}, F.tan(F.radians(x)))


def cotd(x: Column) -> Column:
    return _exact(x, {45: 1.0, 90: 0.0, 135: -1.0, 225: 1.0, 270: 0.0, 315: -1.0}, F.try_divide(F.lit(1.0), F.tan(F.radians(x))))


def asind(x: Column) -> Column:
    return F.when(x == 0.5, F.lit(30.0)).when(x == -0.5, F.lit(-30.0)).otherwise(F.degrees(F.asin(x)))


def acosd(x: Column) -> Column:
    return F.when(x == 0.5, F.lit(60.0)).when(x == -0.5, F.lit(120.0)).otherwise(F.degrees(F.acos(x)))


def atand(x: Column) -> Column:
    return F.degrees(F.atan(x))


def atan2d(y: Column, x: Column) -> Column:
    return F.degrees(F.atan2(y, x))


def log_(x: Column, base: Column | None = None) -> Column:
    """Base 10 with one argument."""
    return F.log10(x) if base is None else F.ln(x) / F.ln(base)


def trunc(x: Column, n: int = 0) -> Column:
    return F.sign(x) * F.floor(F.abs(x) * 10**n) / 10**n


def div(a: Column, b: Column) -> Column:
    """The truncated quotient."""
    q = F.abs(a) / F.abs(b)
    return F.sign(a) * F.sign(b) * F.floor(q)


def round_(x: Column, n: int = 0, numeric: bool = True) -> Column:
    """Numeric rounds halves away from zero, float8 to even."""
    return F.round(x, n) if numeric else F.bround(x, n)


def gcd(a: Column, b: Column, steps: int = 92) -> Column:
    """Euclid's algorithm as a fold; 92 steps suffice for any two longs."""
    start = F.struct(F.abs(a.cast("long")).alias("a"), F.abs(b.cast("long")).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.when(s["b"] == 0, F.lit(1).cast("long")).otherwise(s["b"])).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["a"])


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.abs(a.cast("long")) / g * F.abs(b.cast("long"))).cast("long")


@udf("string")
def factorial(n):
    """Exact for any n, as text beyond a long."""
    return None if n is None else str(math.factorial(n))


def scale(text: Column) -> Column:
    """Digits after the point of a number's text."""
    return F.length(F.substring_index(F.concat(text, F.lit(".")), ".", 2)) - F.length(F.substring_index(text, ".", 1)) - 1 - F.when(F.instr(text, ".") == 0, 0).otherwise(0)


def trim_scale(text: Column) -> Column:
    return F.when(F.instr(text, ".") > 0, F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def min_scale(text: Column) -> Column:
    t = trim_scale(text)
    return F.when(F.instr(t, ".") > 0, F.length(t) - F.instr(t, ".")).otherwise(0)


_R = lambda e, n: f"round({e}, 9) AS {n}"
_SAME = ", ".join(_R(e, n) for n, e in {"a": "acos(x / 60)", "b": "asin(x / 60)", "c": "atan(x)", "d": "atan2(x, 2)", "e": "cbrt(x)", "f": "cos(x)", "g": "cot(x)", "h": "degrees(x)", "i": "exp(x / 10)", "j": "ln(x)", "k": "log10(x)", "l": "power(x, 1.5)", "m": "radians(x)", "n": "sin(x)", "o": "sqrt(x)", "p": "tan(x)", "q": "sinh(x / 20)", "r": "cosh(x / 20)", "s": "tanh(x)", "t": "asinh(x)", "u": "acosh(x)", "v": "atanh(x / 60)"}.items())
sql("fn_math_transcendental", f"SELECT key, {_SAME} FROM (SELECT p_partkey AS key, CAST(p_size AS DOUBLE) AS x FROM part)", "same")
sql("fn_math_basic", "SELECT p_partkey, abs(-p_size) AS a, ceil(p_retailprice) AS b, floor(p_retailprice) AS c, mod(p_size, 7) AS d, sign(p_size - 20) AS e, greatest(p_size, 20) AS f, least(p_size, 20) AS g, nullif(p_size, 7) AS h, coalesce(nullif(p_size, 7), -1) AS i, round(p_retailprice / 3, 2) AS j, p_size div 4 AS k, factorial(p_size % 10) AS l, width_bucket(p_size, 0, 50, 10) AS m FROM part",
    "SELECT p_partkey, abs(-p_size) AS a, ceil(p_retailprice)::BIGINT AS b, floor(p_retailprice)::BIGINT AS c, mod(p_size, 7) AS d, sign(p_size - 20)::DOUBLE AS e, greatest(p_size, 20) AS f, least(p_size, 20) AS g, nullif(p_size, 7) AS h, coalesce(nullif(p_size, 7), -1) AS i, round(p_retailprice / 3, 2) AS j, (p_size // 4)::BIGINT AS k, factorial(p_size % 10)::BIGINT AS l, least(floor(p_size / 5.0) + 1, 11)::BIGINT AS m FROM part")
