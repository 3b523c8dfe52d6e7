"""Registered queries over the function library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import arrays, dates, jsons, maths, strings
from millrace.registry import query, sql, views


@query("fn_string_rewrites", """SELECT p_partkey, chr(300 + p_size) AS c, to_hex(p_size) AS h, '''' || replace(p_brand, '''', '''''') || '''' AS q, 'NULL' AS n, '"' || p_brand || '"' AS i, left(p_name, 1) AS s, regexp_replace(p_name, '[aeiou]', '_') AS r, array_to_string(string_split(p_brand, '#'), '/') AS a FROM part""")
def string_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return views(spark, sf_dir, "part").table("part").select("p_partkey", strings.chr_(300 + c("p_size")).alias("c"), F.upper(strings.to_hex(c("p_size"))).alias("h"), strings.quote_literal(c("p_brand")).alias("q"), strings.quote_nullable(F.lit(None).cast("string")).alias("n"), strings.quote_ident(c("p_brand")).alias("i"),
        strings.substr_(c("p_name"), 0, 2).alias("s"), strings.regexp_replace_(c("p_name"), "[aeiou]", "_").alias("r"), F.array_join(strings.string_to_array(c("p_brand"), "#"), "/").alias("a"))


@query("fn_math_rewrites", "SELECT p_partkey, gcd(p_size, 12)::BIGINT AS g, lcm(p_size, 12)::BIGINT AS l, trunc(p_retailprice)::DOUBLE AS t, round(log10(p_size), 9) AS b, round(sin(radians(p_size)), 9) AS s, round(cos(radians(p_size)), 9) AS c, round(degrees(atan(p_size)), 9) AS a FROM part")
def math_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("p_size")
    return views(spark, sf_dir, "part").table("part").select("p_partkey", maths.gcd(c, F.lit(12)).alias("g"), maths.lcm(c, F.lit(12)).alias("l"), maths.trunc(F.col("p_retailprice")).alias("t"), F.round(maths.log_(c), 9).alias("b"), F.round(maths.sind(c), 9).alias("s"), F.round(maths.cosd(c), 9).alias("c"), F.round(maths.atand(c), 9).alias("a"))


@query("fn_date_bin", "SELECT event_id, epoch_us(time_bucket(INTERVAL 15 MINUTES, ts)) AS b FROM events")
def date_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views(spark, sf_dir, "events").table("events").select("event_id", dates.micros(dates.date_bin(900_000_000, F.col("ts"))).alias("b"))


@query("fn_intervals", "SELECT o_orderkey, datepart('year', age(TIMESTAMP '2031-03-15', o_orderdate)) * 12 + datepart('month', age(TIMESTAMP '2031-03-15', o_orderdate)) AS months, '1-5-3600000000' AS j FROM orders")
def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = views(spark, sf_dir, "orders").table("orders")
    whole = dates.age(F.lit("2031-03-15 00:00:00").cast("timestamp_ntz"), F.col("o_orderdate"))
    fixed = dates.justify_interval(dates.interval(0, 34, 25 * 3_600_000_000))
    return o.select("o_orderkey", whole["months"].alias("months"), dates.interval_text(fixed).alias("j"))


@query("fn_string_udfs", """SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), '-') AS a, p_name || 'é' AS b, p_partkey % 2 = 0 AS c, replace(p_name, 'l', 'r') || 'e' AS d, p_name || 'a' AS e, 'a|' || p_brand AS f,
p_name || ' "' || p_brand || '" ' || chr(39) || p_size || chr(39) || ' %' AS g, CASE WHEN p_size * 1000 < 10240 THEN p_size * 1000 || ' bytes' ELSE (p_size * 1000 + 512) // 1024 || ' kB' END AS h FROM part""")
def string_udfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lit = F.col, F.lit
    name, brand, size = c("p_name"), c("p_brand"), c("p_size")
    some = F.when(c("p_partkey") % 2 == 0, lit("é")).otherwise(lit("é"))
    return views(spark, sf_dir, "part").table("part").select(
        "p_partkey", strings.initcap_(F.replace(F.upper(name), lit(" "), lit("-"))).alias("a"), strings.normalize(F.concat(name, lit("é")), lit("NFC")).alias("b"), strings.is_normalized(some, lit("NFC")).alias("c"),
        strings.to_ascii(F.concat(F.translate(name, "l", "ř"), lit("é"))).alias("d"), strings.unistr(F.concat(name, lit("\\0061"))).alias("e"), F.array_join(strings.parse_ident(F.concat(lit('A."'), brand, lit('"'))), "|").alias("f"),
        strings.format_(lit("%s %I %L %%"), F.array(name, brand, size.cast("string"))).alias("g"), strings.size_pretty(size.cast("long") * 1000).alias("h"))


@query("fn_numeric_text", """WITH p AS (SELECT p_partkey, p_size, rtrim(printf('%.2f', p_retailprice), '0') AS t FROM part)
SELECT p_partkey, rtrim(t, '.') AS a, length(t) - instr(t, '.') AS b, factorial(p_size % 20)::VARCHAR AS c, round(degrees(asin(p_size / 100.0::DOUBLE)), 9) AS d, round(degrees(acos(p_size / 100.0::DOUBLE)), 9) AS e, trunc(-p_size / 4.0::DOUBLE) AS f FROM p""")
def numeric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    price, share = F.format_string("%.3f", F.round("p_retailprice", 2)), c("p_size") / F.lit(100.0)
    return views(spark, sf_dir, "part").table("part").select(
        "p_partkey", maths.trim_scale(price).alias("a"), maths.min_scale(price).cast("long").alias("b"), maths.factorial(c("p_size") % 20).alias("c"), F.round(maths.asind(share), 9).alias("d"), F.round(maths.acosd(share), 9).alias("e"), maths.div(-c("p_size").cast("double"), F.lit(4.0)).alias("f"))


@query("fn_array_rewrites", """WITH p AS (SELECT p_partkey, p_size, [p_brand, p_name, p_brand] AS a FROM part)
SELECT p_partkey, list_position(a, a[2])::INTEGER AS a, '1,3' AS b, 'x,' || a[2] || ',x' AS c, a[1] || ',' || a[2] AS d, '[1:3]' AS e, list_contains(a, 'cold widget') AS f,
CASE WHEN p_size <= 3 THEN '0-' || greatest(3, p_size + 2) ELSE '0-3,' || p_size || '-' || (p_size + 2) END || ',90-91' AS g, CASE WHEN p_size < 3 THEN p_size || '-3' ELSE '' END AS h, p_size < 10 AS i FROM p""")
def array_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lit = F.col, F.lit
    a = F.array("p_brand", "p_name", "p_brand")
    r = lambda *p: F.array(*[F.struct(x.alias("lo"), y.alias("hi")) for x, y in p])
    text = lambda m: F.array_join(F.transform(m, lambda x: F.concat_ws("-", x["lo"].cast("string"), x["hi"].cast("string"))), ",")
    own, fixed = r((c("p_size"), c("p_size") + 2)), r((lit(0), lit(3)), (lit(90), lit(91)))
    return views(spark, sf_dir, "part").table("part").select(
        "p_partkey", arrays.array_position(a, c("p_name")).cast("int").alias("a"), F.array_join(arrays.array_positions(a, c("p_brand")).cast("array<string>"), ",").alias("b"), F.array_join(arrays.array_replace(a, c("p_brand"), lit("x")), ",").alias("c"), F.array_join(arrays.trim_array(a, 1), ",").alias("d"),
        arrays.array_dims(a).alias("e"), arrays.contains(a, F.array(lit("cold widget"))).alias("f"), text(arrays.range_union(fixed, own)).alias("g"), text(arrays.range_intersection(fixed, own)).alias("h"), arrays.range_contains(r((lit(0), lit(10))), c("p_size")).alias("i"))


@query("fn_jsonb", """WITH e AS (SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events)
SELECT event_id, k = 7 AS a, event_id % 2 = 0 AS b, '{"k": ' || k || ', "id": ' || event_id || '}' AS c, '{"k": ' || event_id || '}' AS d, '[' || k || ', 5, ' || event_id || ']' AS e, '{"a": [' || k || ']}' AS f, '{"b": 1, "k": ' || k || '}' AS g,
CASE WHEN k > 50 THEN '[' || k || ', 99]' ELSE '[99]' END AS h, event_id::VARCHAR AS i, true AS j, k > 50 AS k, 'object' AS l, event_id % 2 = 1 AS m FROM e""")
def jsonb(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lit = F.col, F.lit
    p = lambda *x: F.array(*map(lit, x))
    e = views(spark, sf_dir, "events").table("events").select("event_id", "props", F.get_json_object("props", "$.k").alias("k"), F.col("event_id").cast("string").alias("id"))
    pair, even = F.concat(lit('{"a": ['), c("k"), lit(", "), c("id"), lit("]}")), c("event_id") % 2 == 0
    return e.select(
        "event_id", jsons.contains(c("props"), lit('{"k": 7}')).alias("a"), jsons.has_key(F.when(even, lit('{"a": 1}')).otherwise(lit('{"b": 1}')), lit("a")).alias("b"), jsons.normal(jsons.merge(F.concat(lit('{"id": '), c("id"), lit("}")), c("props"))).alias("c"), jsons.set_path(c("props"), p("k"), c("id"), lit(True)).alias("d"),
        jsons.insert_path(F.concat(lit("["), c("k"), lit(", "), c("id"), lit("]")), p("1"), lit("5"), lit(False)).alias("e"), jsons.delete_path(pair, p("a", "1")).alias("f"), jsons.strip_nulls(F.concat(lit('{"k": '), c("k"), lit(', "b": 1, "x": null}'))).alias("g"),
        F.concat(lit("["), F.array_join(jsons.path_query_array(F.concat(lit('{"a": ['), c("k"), lit(", 99]}")), lit("$.a[*] ? (@ > 50)")), ", "), lit("]")).alias("h"), jsons.path_query_first(pair, "$.a[1]").alias("i"), jsons.path_exists(c("props"), lit("$.k")).alias("j"), jsons.path_match(c("props"), lit("$.k > 50")).alias("k"), jsons.typeof(c("props")).alias("l"),
        jsons.unique_keys(F.when(even, lit('{"a": 1, "a": 2}')).otherwise(c("props"))).alias("m"))


@query("fn_session", "SELECT p_partkey, 'UTC' AS tz, 'int' AS t, p_size % 3 > 0 AS v, p_brand AS b FROM part")
def session_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """current_setting, pg_typeof, pg_input_is_valid, and the bytes of a text there and back."""
    text = F.when(F.col("p_size") % 3 > 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand"))
    return views(spark, sf_dir, "part").table("part").select("p_partkey", F.lit(spark.conf.get("spark.sql.session.timeZone")).alias("tz"), F.typeof("p_size").alias("t"), text.try_cast("int").isNotNull().alias("v"), F.unhex(F.hex(F.col("p_brand").cast("binary"))).cast("string").alias("b"))


sql("fn_sql_json", """SELECT event_id, JSON_VALUE(props, '$.k' RETURNING int) AS a, JSON_EXISTS(props, '$.k ? (@ > 50)') AS b, JSON_QUERY(props, '$.k' WITH WRAPPER) AS c, JSON_VALUE(props, '$.none' DEFAULT 'none' ON EMPTY) AS d, JSON_ARRAY(event_id, event_type) AS e, JSON_OBJECT('id' VALUE event_id, 'kind' VALUE event_type) AS f,
jsonb_set(props, array('k'), CAST(event_id AS STRING)) AS g, jsonb_path_exists(props, '$.k') AS h, jsonb_build_object('id', event_id) AS i, initcap(event_type) AS j FROM events""",
    """SELECT event_id, json_extract(props, '$.k')::INTEGER AS a, json_extract(props, '$.k')::INTEGER > 50 AS b, '[' || json_extract_string(props, '$.k') || ']' AS c, 'none' AS d, '[' || event_id || ', "' || event_type || '"]' AS e, '{"id": ' || event_id || ', "kind": "' || event_type || '"}' AS f,
'{"k": ' || event_id || '}' AS g, true AS h, '{"id": ' || event_id || '}' AS i, upper(event_type[1]) || event_type[2:] AS j FROM events""")
sql("fn_by_name", "SELECT p_partkey, gcd(p_size, 12) AS g, lcm(p_size, 12) AS l, to_hex(p_size) AS h, strpos(p_type, 'STEEL') AS p, quote_literal(p_brand) AS q, array_to_string(string_to_array(p_type, ' '), '/') AS a, array_length(split(p_type, ' '), 1) AS n, round(sind(p_size), 9) AS s, jsonb_typeof('[1]') AS t FROM part",
    "SELECT p_partkey, gcd(p_size, 12)::BIGINT AS g, lcm(p_size, 12)::BIGINT AS l, lower(to_hex(p_size)) AS h, strpos(p_type, 'STEEL')::INTEGER AS p, chr(39) || p_brand || chr(39) AS q, replace(p_type, ' ', '/') AS a, len(string_split(p_type, ' '))::INTEGER AS n, round(sin(radians(p_size)), 9) AS s, 'array' AS t FROM part")
sql("fn_date_bin_by_name", "SELECT event_id, unix_micros(date_bin(INTERVAL '0 00:15:00' DAY TO SECOND, CAST(ts AS TIMESTAMP), TIMESTAMP '2024-01-01 00:00:00')) AS b, CAST(extract(epoch FROM ts) AS BIGINT) AS e FROM events", "SELECT event_id, epoch_us(time_bucket(INTERVAL 15 MINUTES, ts)) AS b, epoch_us(ts) // 1000000 AS e FROM events")
