"""User routines: overloaded SQL functions, table functions, aggregates, casts and procedures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.registry import query, views


class Overloads:
    """Functions of one name, told apart by their number of arguments; defaults fill what is missing, ambiguity raises."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.known: dict[str, list[tuple[int, int, str]]] = {}

    def create(self, name: str, arguments: list[tuple[str, str, str | None]], returns: str, body: str, strict: bool = False) -> None:
        """CREATE FUNCTION with (name, type, default) arguments; ``strict`` gives NULL for any NULL argument."""
        most = len(arguments)
        least = sum(d is None for *_, d in arguments)
        own = f"{name}__{most}"
        if strict:
            body = f"CASE WHEN {' OR '.join(f'{n} IS NULL' for n, *_ in arguments)} THEN NULL ELSE {body} END"
        head = ", ".join(f"{n} {t}" + (f" DEFAULT {d}" if d is not None else "") for n, t, d in arguments)
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {own}({head}) RETURNS {returns} RETURN {body}")
        self.known[name] = [x for x in self.known.get(name, []) if x[1] != most] + [(least, most, own)]

    def call(self, name: str, *arguments: str) -> Column:
        """A call with SQL texts as arguments."""
        n = len(arguments)
        fit = [own for least, most, own in self.known.get(name, []) if most == n] or [own for least, most, own in self.known.get(name, []) if least <= n <= most]
        if len(fit) != 1:
            raise ValueError(f"function {name} with {n} arguments is {'not unique' if fit else 'unknown'}")
        return F.expr(f"{fit[0]}({', '.join(arguments)})")


def user_aggregate(df: DataFrame, keys: list[str], value: str, start: Column, step, finish, name: str) -> DataFrame:
    """CREATE AGGREGATE as a fold over a key's values, where no built-in aggregate says it."""
    return df.groupBy(*keys).agg(F.aggregate(F.collect_list(value), start, step, finish).alias(name))


@query("fn_overloads", "SELECT p_partkey, p_size + 10 AS a, p_size * 3 AS b, NULL::INTEGER AS c FROM part")
def overloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = views(spark, sf_dir, "part")
    f = Overloads(v)
    f.create("bump", [("x", "INT", None)], "INT", "x + 10")
    f.create("bump", [("x", "INT", None), ("by", "INT", None)], "INT", "x * by", strict=True)
    return v.table("part").select("p_partkey", f.call("bump", "p_size").alias("a"), f.call("bump", "p_size", "3").alias("b"), f.call("bump", "p_size", "CAST(NULL AS INT)").alias("c"))


@query("fn_returns_table", "SELECT p_partkey, i::INTEGER AS i FROM part, unnest(generate_series(1, p_size % 4)) AS t(i)")
def returns_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SETOF: a SQL table function called laterally."""
    v = views(spark, sf_dir, "part")
    v.sql("CREATE OR REPLACE TEMPORARY FUNCTION up_to(n INT) RETURNS TABLE (i INT) RETURN SELECT explode(IF(n > 0, sequence(1, n), array()))")
    return v.sql("SELECT p.p_partkey, t.i FROM part p, LATERAL up_to(p.p_size % 4) AS t")


@query("fn_python_table_function", "SELECT n_name, unnest(regexp_extract_all(n_name, '[A-Z]')) AS letter FROM nation WHERE n_name SIMILAR TO '.*[A-Z].*'")
def python_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.functions import udtf

    @udtf(returnType="letter string")
    class Letters:
        def eval(self, text: str):
            for c in text or "":
                if "A" <= c <= "Z":
                    yield (c,)

    v = views(spark, sf_dir, "nation")
    v.udtf.register("letters_of", Letters)
    return v.sql("SELECT n.n_name, l.letter FROM nation n, LATERAL letters_of(n.n_name) AS l")


@query("fn_pandas_aggregate", "SELECT p_brand, round(exp(avg(ln(p_size + 1))), 6) AS g FROM part GROUP BY p_brand")
def pandas_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered Python aggregate (geometric mean); the built-in form is exp(avg(ln(x)))."""

    @F.pandas_udf("double")
    def geometric(x: pd.Series) -> float:
        import numpy as np

        return float(np.exp(np.log(x.astype(float)).mean()))

    return views(spark, sf_dir, "part").table("part").groupBy("p_brand").agg(F.round(geometric(F.col("p_size") + 1), 6).alias("g"))


@query("fn_fold_aggregate", "SELECT p_brand, product((p_size % 3 + 1)::DOUBLE) AS p FROM part WHERE p_partkey % 7 = 0 GROUP BY p_brand")
def fold_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views(spark, sf_dir, "part").sql("SELECT p_brand, p_size % 3 + 1 AS v FROM part WHERE p_partkey % 7 = 0")
    return user_aggregate(p, ["p_brand"], "v", F.lit(1.0), lambda acc, x: acc * x, lambda acc: acc, "p")


@query("fn_user_cast", "SELECT p_partkey, '#' || p_size AS tag FROM part")
def user_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE CAST ... WITH FUNCTION: the cast is a registered function."""
    v = views(spark, sf_dir, "part")
    v.sql("CREATE OR REPLACE TEMPORARY FUNCTION int_as_tag(x INT) RETURNS STRING RETURN concat('#', x)")
    return v.sql("SELECT p_partkey, int_as_tag(p_size) AS tag FROM part")


@query("fn_procedure_script", "SELECT 55::BIGINT AS total")
def procedure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DO with variables and a loop, as a SQL script."""
    return spark.sql("""BEGIN
  DECLARE total BIGINT DEFAULT 0;
  DECLARE i BIGINT DEFAULT 1;
  WHILE i <= 10 DO
    SET total = total + i;
    SET i = i + 1;
  END WHILE;
  SELECT total AS total;
END""")
