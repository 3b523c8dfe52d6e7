"""Arrow batch functions: built when first used, so importing needs no session, and made callable by name in SQL."""

from __future__ import annotations

import functools
import inspect

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": (T.StringType(), pa.string()), "boolean": (T.BooleanType(), pa.bool_()), "array<string>": (T.ArrayType(T.StringType()), pa.list_(pa.string()))}
#: Functions of SQL text by name.
BY_NAME: dict[str, object] = {}


def udf(kind: str, name: str | None = None):
    """A function of whole Arrow batches from one of single values.

    Defaults of the function's last arguments hold where fewer are given. With a
    name it can also be called in SQL text.
    """
    spark_type, arrow_type = _TYPES[kind]

    def wrap(f):
        least = sum(p.default is inspect.Parameter.empty for p in inspect.signature(f).parameters.values())

        def batch(*columns: pa.Array) -> pa.Array:
            return pa.array(map(f, *(c.to_pylist() for c in columns)), arrow_type)

        @functools.wraps(f)
        def call(*columns):
            if len(columns) < least:
                raise TypeError(f"{name or f.__name__} needs {least} arguments")
            return F.arrow_udf(batch, spark_type)(*columns)

        call.in_sql = lambda: F.arrow_udf(batch, spark_type)
        if name:
            BY_NAME[name] = call
        return call

    return wrap


def install(spark: SparkSession, called: set[str]) -> None:
    """Make those of the called functions that are known by name."""
    for name in sorted(called & BY_NAME.keys()):
        spark.udf.register(name, BY_NAME[name].in_sql())
