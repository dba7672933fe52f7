import datetime as dt

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from weftline import operators as op
from weftline import sources as src
from weftline.operators.parse import java_pattern, pattern_groups


def test_split_to_columns(spark):
    df = spark.createDataFrame([("Ada Lovelace",), ("a b c d",), ("solo",), (None,)], "name string")
    out = op.split_to_columns(df, "name", " ", 2, "part")
    assert out.columns == ["part1", "part2"]
    assert rows_of(out) == [(None, None), ("Ada", "Lovelace"), ("a", "b c d"), ("solo", None)]
    dots = spark.createDataFrame([("x.y.z",)], "name string")
    assert op.split_to_columns(dots, "name", ".", 3, keep_original=True).first()[1:] == ("x", "y", "z")


def test_split_to_rows(spark):
    df = spark.createDataFrame([(1, "a,b,c"), (2, None), (3, "")], "id int, csv string")
    assert rows_of(op.split_to_rows(df, "csv")) == [(1, "a"), (1, "b"), (1, "c"), (2, None), (3, "")]


def test_regex_parse(spark):
    df = spark.createDataFrame([("555-123-4567",), ("none",), (None,)], "phone string")
    out = op.regex_parse(df, "phone", r"(?<area>\d{3})-(?P<mid_part>\d{3})-(\d{4})")
    assert out.columns == ["phone", "area", "mid_part", "3"]
    assert rows_of(out) == [(None,) * 4, ("555-123-4567", "555", "123", "4567"), ("none", None, None, None)]
    assert pattern_groups(r"\(?<x>(?<=a)(?<y>b)(?:c)") == (r"\(?<x>(?<=a)(b)(?:c)", ["y"])


def test_regex_match_replace_tokenize(spark):
    df = spark.createDataFrame([("555-1",), ("ab",), (None,)], "p string")
    assert [r[1] for r in op.regex_match(df, "p", "^555").collect()] == [True, False, None]
    assert [r[0] for r in op.regex_replace(df, "p", r"(\d)-(\d)", "$2_$1").collect()] == ["551_5", "ab", None]
    assert op.regex_replace(df, "p", "a", "x", "q").columns == ["p", "q"]
    assert rows_of(op.regex_tokenize(df, "p", r"\d+")) == [(None,), (None,), ("1",), ("555",)]
    assert op.regex_parse(df, "p", "") is df


@pytest.mark.parametrize("fmt, parse, show", [
    ("%Y-%m-%d", "yyyy-M-d", "yyyy-MM-dd"),
    ("%m/%d/%Y", "M/d/yyyy", "MM/dd/yyyy"),
    ("%Y%m%d", "yyyyMMdd", "yyyyMMdd"),
    ("%d %B %Y at %H:%M", "d MMMM yyyy' at 'H:m", "dd MMMM yyyy' at 'HH:mm"),
    ("100%% %b", "100% MMM", "100% MMM"),
])
def test_date_patterns(fmt, parse, show):
    assert java_pattern(fmt, parsing=True) == parse and java_pattern(fmt) == show


def test_datetime(spark):
    df = spark.createDataFrame([("2024-01-05",), ("2024-1-6",), ("bad",), (None,)], "d string")
    out = op.datetime_parse(df, "d", "%Y-%m-%d")
    assert [r[0] for r in out.collect()] == [dt.date(2024, 1, 5), dt.date(2024, 1, 6), None, None]
    ts = spark.createDataFrame([("03/02/2021 10:20:30",), ("x",)], "d string")
    got = op.datetime_parse(ts, "d", "%d/%m/%Y %H:%M:%S", "datetime", "t")
    assert got.dtypes[-1] == ("t", "timestamp_ntz")
    assert [r["t"] for r in got.collect()] == [dt.datetime(2021, 2, 3, 10, 20, 30), None]
    mixed = spark.createDataFrame([("2024-02-03",), ("03/02/2024",), ("2024.2.3",)], "d string")
    assert {r[0] for r in op.datetime_parse(mixed, "d").collect()} == {dt.date(2024, 2, 3)}
    stamps = spark.createDataFrame([("2024-02-03T04:05:06",), ("2024-02-03 04:05:06.000",), ("2024-02-03",)], "d string")
    assert [r[0].hour for r in op.datetime_parse(stamps, "d", output_type="datetime").collect()] == [4, 4, 0]
    back = op.datetime_format(out, "d", "%a %d %b %Y, day %j")
    assert back.first()[0] == "Fri 05 Jan 2024, day 005"
    with pytest.raises(ValueError):
        java_pattern("%Q")


def test_json_parse(spark):
    df = spark.createDataFrame([(1, '{"user":"ada","score":3,"in":{"a b":1.5}}'), (2, '{"user":"bob"}'), (3, None)], "id int, payload string")
    out = op.json_parse(df, "payload")
    assert dict(out.dtypes) == {"id": "int", "in": "struct<a b:double>", "score": "bigint", "user": "string"}
    assert rows_of(out.select("id", "score", "user")) == [(1, 3, "ada"), (2, None, "bob"), (3, None, None)]
    assert op.json_parse(df, "payload", "struct<user:string>", keep_original=True).columns == ["id", "payload", "user"]


def test_json_parse_bad_text_and_clash(spark):
    df = spark.createDataFrame([('{"a":1}',), ("{bad",)], "j string")
    with pytest.raises(Exception):
        op.json_parse(df, "j").collect()
    assert rows_of(op.json_parse(df, "j", on_error="null")) == [(None,), (1,)]
    with pytest.raises(ValueError):
        op.json_parse(df.withColumn("a", F.lit(1)), "j")


def test_json_parse_nonobject(spark):
    df = spark.createDataFrame([("[1,2]",), ("[]",)], "j string")
    out = op.json_parse(df, "j")
    assert out.columns == ["j_parsed"] and [r[0] for r in out.collect()] == [[1, 2], []]
    lone = spark.createDataFrame([("1",), ("2.5",)], "j string")
    assert [r[0] for r in op.json_parse(lone, "j").collect()] == [1.0, 2.5]
    words = spark.createDataFrame([('"x"',), ("null",)], "j string")
    assert [r[0] for r in op.json_parse(words, "j").collect()] == ["x", None]


def test_typed_grid(spark):
    out = src.text_literals(
        spark, {"id": "int64", "name": "string", "score": "float64", "vip": "bool"},
        [["1", "Ada", "9.5", "true"], ["2", "Bob", "7", "no"]],
    )
    assert [t for _, t in out.dtypes] == ["bigint", "string", "double", "boolean"]
    assert [tuple(r) for r in out.collect()] == [(1, "Ada", 9.5, True), (2, "Bob", 7.0, False)]


def test_blank_bad_and_ragged_cells(spark):
    out = src.text_literals(spark, {"n": "int64", "s": "string", "d": "date", "t": "time", "z": "odd"}, [
        ["", " x ", "not-a-date", "10:11:12", " q "], ["5"], [" 7 ", "", "2020-02-03", "nope", ""],
    ])
    rows = [tuple(r) for r in out.collect()]
    assert rows[0] == (None, " x ", None, dt.time(10, 11, 12), "q")
    assert rows[1] == (5, None, None, None, None)
    assert rows[2] == (7, None, dt.date(2020, 2, 3), None, None)
    assert src.text_literals(spark, {"n": "int64"}, []).dtypes == [("n", "bigint")]
    for bad in ([], [("", "string")], [("a", "string"), (" a", "string")]):
        with pytest.raises(ValueError):
            src.text_literals(spark, bad, [])


def test_bool_words(spark):
    words = ["TRUE", " yes ", "y", "t", "1", "False", "no", "N", "f", "0", "maybe"]
    out = src.text_literals(spark, {"b": "bool"}, [[w] for w in words])
    assert [r[0] for r in out.collect()] == [True] * 5 + [False] * 5 + [None]


def test_infer_types_and_headers(spark):
    df = spark.createDataFrame([
        ("01234", "1", "1.5", "yes", "2024-01-02", "", "x"), ("2", "-2", "3", "N", "2024-13-99", " ", "1"), ("3", None, "2e5", "", "", None, "2"),
    ], "zip string, i string, f string, b string, d string, none string, s string")
    assert src.infer_text_types(df) == {
        "zip": "string", "i": "int64", "f": "float64", "b": "bool", "d": "date", "none": "string", "s": "string",
    }
    assert src.repair_headers(["a", " ", "a", "a"]) == ["a", "Column2", "a_1", "a_2"]
