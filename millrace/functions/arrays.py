"""PostgreSQL array and multirange functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.registry import sql


def array_length(a: Column) -> Column:
    return F.nullif(F.size(a), F.lit(0))


def array_position(a: Column, x: Column) -> Column:
    """Null where Spark gives 0."""
    return F.nullif(F.array_position(a, x), F.lit(0).cast("long"))


def array_positions(a: Column, x: Column) -> Column:
    return F.filter(F.transform(a, lambda v, i: F.when(v.eqNullSafe(x), i + 1)), lambda i: i.isNotNull())


def array_replace(a: Column, old: Column, new: Column) -> Column:
    return F.transform(a, lambda v: F.when(v.eqNullSafe(old), new).otherwise(v))


def array_fill(x: Column, *dims: int) -> Column:
    for n in reversed(dims):
        x = F.array_repeat(x, n)
    return x


def trim_array(a: Column, n: int) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - n, F.lit(0)))


def array_sample(a: Column, n: int, seed: int | None = None) -> Column:
    return F.slice(F.shuffle(a, seed) if seed is not None else F.shuffle(a), 1, n)


def array_dims(a: Column) -> Column:
    """Text of a one-dimensional array's bounds."""
    return F.when(F.size(a) > 0, F.concat(F.lit("[1:"), F.size(a).cast("string"), F.lit("]")))


def contains(a: Column, b: Column) -> Column:
    """a @> b."""
    return F.size(F.array_except(b, a)) == 0


# Multiranges: sorted arrays of struct<lo, hi>, half-open.


def range_union(a: Column, b: Column) -> Column:
    """Disjoint ranges that cover both."""
    both = F.sort_array(F.concat(a, b))
    empty = F.slice(both, 1, 0)

    def step(acc, r):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (r["lo"] <= last["hi"])
        merged = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], r["hi"]).alias("hi"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(merged))).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(both, empty, lambda acc, r: F.when(F.size(acc) == 0, F.array(r)).otherwise(step(acc, r)))


def range_intersection(a: Column, b: Column) -> Column:
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(F.greatest(x["lo"], y["lo"]).alias("lo"), F.least(x["hi"], y["hi"]).alias("hi")))))
    return F.sort_array(F.filter(pairs, lambda r: r["lo"] < r["hi"]))


def range_overlaps(a: Column, b: Column) -> Column:
    return F.size(range_intersection(a, b)) > 0


def range_contains(a: Column, x: Column) -> Column:
    return F.exists(a, lambda r: (r["lo"] <= x) & (x < r["hi"]))


_T = "string_split(p_type, ' ')"
sql("fn_arrays", """SELECT p_partkey, array_join(array_append(t, 'z'), ',') AS a, array_join(array_prepend(t, 'z'), ',') AS b, array_join(concat(t, t), ',') AS c, nullif(size(t), 0) AS d, nullif(array_position(t, 'STEEL'), 0) AS e, array_join(array_remove(t, 'STEEL'), ',') AS f,
array_join(reverse(t), ',') AS g, array_join(array_sort(t), ',') AS h, array_join(slice(t, 1, 2), ',') AS i, array_join(transform(t, x -> lower(x)), ',') AS j, cardinality(t) AS k, array_join(array_repeat('q', 3), '') AS l FROM (SELECT p_partkey, split(p_type, ' ') AS t FROM part)""",
    f"""SELECT p_partkey, array_to_string(list_append(t, 'z'), ',') AS a, array_to_string(list_prepend('z', t), ',') AS b, array_to_string(list_concat(t, t), ',') AS c, len(t)::INTEGER AS d, nullif(coalesce(list_position(t, 'STEEL'), 0), 0)::BIGINT AS e, coalesce(array_to_string(list_filter(t, lambda x: x <> 'STEEL'), ','), '') AS f,
array_to_string(list_reverse(t), ',') AS g, array_to_string(list_sort(t), ',') AS h, array_to_string(t[1:2], ',') AS i, array_to_string(list_transform(t, lambda x: lower(x)), ',') AS j, len(t)::INTEGER AS k, 'qqq' AS l FROM (SELECT p_partkey, {_T} AS t FROM part)""")
