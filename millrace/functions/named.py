"""PostgreSQL's names for use inside SQL text.

Most are temporary SQL functions, which Catalyst inlines; those on JSON paths and
mutation, and Unicode's forms, are Arrow batch functions. A function is made in
a session when a statement first calls it. Names that Spark
has itself are left alone, also where the meaning differs; the column functions
of this package cover those.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from millrace.functions import udfs

#: Signature and body by name.
SCALARS = {
    "gcd": ("a BIGINT, b BIGINT) RETURNS BIGINT", "aggregate(sequence(1, 93), named_struct('x', abs(a), 'y', abs(b)), (s, i) -> if(s.y = 0, s, named_struct('x', s.y, 'y', s.x % s.y)), s -> s.x)"),
    "lcm": ("a BIGINT, b BIGINT) RETURNS BIGINT", "if(a = 0 OR b = 0, 0, abs(a div aggregate(sequence(1, 93), named_struct('x', abs(a), 'y', abs(b)), (s, i) -> if(s.y = 0, s, named_struct('x', s.y, 'y', s.x % s.y)), s -> s.x) * b))"),
    "to_hex": ("n BIGINT) RETURNS STRING", "lower(hex(n))"),
    "strpos": ("s STRING, part STRING) RETURNS INT", "instr(s, part)"),
    "quote_literal": ("s STRING) RETURNS STRING", "concat(if(contains(s, chr(92)), ' E', ''), chr(39), replace(replace(s, chr(92), concat(chr(92), chr(92))), chr(39), concat(chr(39), chr(39))), chr(39))"),
    "quote_nullable": ("s STRING) RETURNS STRING", "coalesce(concat(chr(39), replace(s, chr(39), concat(chr(39), chr(39))), chr(39)), 'NULL')"),
    "array_to_string": ("a ARRAY<STRING>, sep STRING) RETURNS STRING", "array_join(a, sep)"),
    "string_to_array": ("s STRING, sep STRING) RETURNS ARRAY<STRING>", "if(s = '', array(), split(s, concat('[', chr(92), 'Q', sep, chr(92), 'E', ']{1}'), -1))"),
    "array_length": ("a ARRAY<STRING>, dim INT) RETURNS INT", "if(dim = 1, nullif(size(a), 0), NULL)"),
    "array_upper": ("a ARRAY<STRING>, dim INT) RETURNS INT", "if(dim = 1, nullif(size(a), 0), NULL)"),
    "array_lower": ("a ARRAY<STRING>, dim INT) RETURNS INT", "if(dim = 1 AND size(a) > 0, 1, NULL)"),
    "date_bin": ("stride INTERVAL DAY TO SECOND, t TIMESTAMP, origin TIMESTAMP) RETURNS TIMESTAMP", "timestamp_micros(unix_micros(origin) + CAST(floor((unix_micros(t) - unix_micros(origin)) / CAST(extract(SECOND FROM stride) * 1000000 + extract(MINUTE FROM stride) * 60000000 + extract(HOUR FROM stride) * 3600000000 + extract(DAY FROM stride) * 86400000000 AS BIGINT)) AS BIGINT) * CAST(extract(SECOND FROM stride) * 1000000 + extract(MINUTE FROM stride) * 60000000 + extract(HOUR FROM stride) * 3600000000 + extract(DAY FROM stride) * 86400000000 AS BIGINT))"),
    "jsonb_typeof": ("j STRING) RETURNS STRING", "CASE WHEN try_parse_json(j) IS NULL THEN NULL WHEN left(ltrim(j), 1) = '{' THEN 'object' WHEN left(ltrim(j), 1) = '[' THEN 'array' WHEN left(ltrim(j), 1) = '\"' THEN 'string' WHEN trim(j) IN ('true', 'false') THEN 'boolean' WHEN trim(j) = 'null' THEN 'null' ELSE 'number' END"),
    "jsonb_array_length": ("j STRING) RETURNS INT", "json_array_length(j)"),
    "jsonb_extract_path_text": ("j STRING, k STRING) RETURNS STRING", "get_json_object(j, concat('$.', k))"),
    "sind": ("x DOUBLE) RETURNS DOUBLE", "CASE pmod(x, 360D) WHEN 0 THEN 0D WHEN 30 THEN 0.5D WHEN 90 THEN 1D WHEN 150 THEN 0.5D WHEN 180 THEN 0D WHEN 210 THEN -0.5D WHEN 270 THEN -1D WHEN 330 THEN -0.5D ELSE sin(radians(x)) END"),
    "cosd": ("x DOUBLE) RETURNS DOUBLE", "CASE pmod(x, 360D) WHEN 0 THEN 1D WHEN 60 THEN 0.5D WHEN 90 THEN 0D WHEN 120 THEN -0.5D WHEN 180 THEN -1D WHEN 240 THEN -0.5D WHEN 270 THEN 0D WHEN 300 THEN 0.5D ELSE cos(radians(x)) END"),
    "sha224": ("s BINARY) RETURNS BINARY", "unhex(sha2(s, 224))"),
    "sha256": ("s BINARY) RETURNS BINARY", "unhex(sha2(s, 256))"),
    "sha384": ("s BINARY) RETURNS BINARY", "unhex(sha2(s, 384))"),
    "sha512": ("s BINARY) RETURNS BINARY", "unhex(sha2(s, 512))"),
    "pg_make_time": ("h INT, m INT, s DECIMAL(8, 6)) RETURNS STRING", "date_format(make_timestamp_ntz(2000, 1, 1, h, m, s), if(s = floor(s), 'HH:mm:ss', 'HH:mm:ss.SSSSSS'))"),
    "make_timestamptz": ("y INT, mo INT, d INT, h INT, mi INT, s DECIMAL(8, 6), zone STRING DEFAULT NULL) RETURNS TIMESTAMP", "make_timestamp(y, mo, d, h, mi, s, coalesce(zone, current_timezone()))"),
    "timezone": ("zone STRING, t TIMESTAMP) RETURNS TIMESTAMP_NTZ", "CAST(from_utc_timestamp(to_utc_timestamp(t, current_timezone()), zone) AS TIMESTAMP_NTZ)"),
    "isfinite": ("t TIMESTAMP) RETURNS BOOLEAN", "if(t IS NULL, NULL, true)"),
    "jsonb_extract_path": ("j STRING, a STRING, b STRING DEFAULT NULL, c STRING DEFAULT NULL, d STRING DEFAULT NULL) RETURNS STRING", "to_json(try_variant_get(parse_json(j), concat('$', array_join(transform(array_compact(array(a, b, c, d)), k -> if(k RLIKE '^[0-9]+$', concat('[', k, ']'), concat('.', k))), '')), 'variant'))"),
    "jsonb_object": ("a ARRAY<STRING>, b ARRAY<STRING> DEFAULT NULL) RETURNS STRING", "to_json(if(b IS NULL, map_from_entries(transform(sequence(1, size(a) div 2), k -> struct(a[2 * k - 2], a[2 * k - 1]))), map_from_arrays(a, b)))"),
    "pg_typeof": ("x STRING) RETURNS STRING", "typeof(x)"),
}
TABLES = {
    "generate_series": ("a BIGINT, b BIGINT, step BIGINT DEFAULT 1) RETURNS TABLE (n BIGINT)", "SELECT explode(CASE WHEN (step > 0 AND a <= b) OR (step < 0 AND a >= b) THEN sequence(a, b, step) ELSE array() END)"),
    "string_to_table": ("s STRING, sep STRING) RETURNS TABLE (part STRING)", "SELECT explode(split(s, concat(chr(92), 'Q', sep, chr(92), 'E'), -1))"),
    "regexp_split_to_table": ("s STRING, pattern STRING) RETURNS TABLE (part STRING)", "SELECT explode(split(s, pattern, -1))"),
    "jsonb_object_keys": ("j STRING) RETURNS TABLE (k STRING)", "SELECT explode(json_object_keys(j))"),
    "jsonb_each": ("j STRING) RETURNS TABLE (key STRING, value STRING)", "SELECT k, to_json(v) FROM (SELECT explode(from_json(j, 'map<string,variant>')) AS (k, v))"),
    "jsonb_each_text": ("j STRING) RETURNS TABLE (key STRING, value STRING)", "SELECT k, CAST(v AS STRING) FROM (SELECT explode(from_json(j, 'map<string,variant>')) AS (k, v))"),
    "jsonb_array_elements_text": ("j STRING) RETURNS TABLE (value STRING)", "SELECT explode(transform(from_json(j, 'array<variant>'), x -> CAST(x AS STRING)))"),
    "jsonb_array_elements": ("j STRING) RETURNS TABLE (value STRING)", "SELECT explode(transform(from_json(j, 'array<variant>'), x -> to_json(x)))"),
}


def install(spark: SparkSession, called: set[str]) -> None:
    """Make those of the called functions that are known here."""
    from millrace.functions import jsons, strings  # noqa: F401  (their functions are known by name)

    udfs.install(spark, called)
    for name in sorted(called & (SCALARS.keys() | TABLES.keys())):
        head, body = (SCALARS | TABLES)[name]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({head} RETURN {body}")
