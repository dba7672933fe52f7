"""Nulls, NaN, empty text, large numbers, clashing names and hot keys, beyond what the test tables hold."""
import datetime

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from weftline import functions as fx
from weftline import operators as op
from weftline import sources as src
from weftline.operators import Agg, Win
from weftline.session import shared_folder


def test_csv_keeps_everything(spark, tmp_path):
    rows = [(1234567890123456789 - i, None if i % 4 == 0 else "" if i % 4 == 1 else 'a\nb "c"' if i % 4 == 2 else " x ", "1" if i < 150 else "late") for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, odd string, late string").coalesce(1)
    src.write_csv(df, str(tmp_path / "t"))
    back = src.read_csv(spark, str(tmp_path / "t"))
    assert dict(back.dtypes) == {"id": "bigint", "odd": "string", "late": "string"} and rows_of(back) == rows_of(df)
    one = spark.createDataFrame([("a\nb",), ("",)], "v string").coalesce(1)
    src.write_csv(one, str(tmp_path / "one"), write_header=False)
    assert rows_of(src.read_csv(spark, str(tmp_path / "one"), has_header=False, schema="v string")) == rows_of(one)
    huge = spark.createDataFrame([("9223372036854775808",), ("1",)], "v string").coalesce(1)
    src.write_csv(huge, str(tmp_path / "huge"))
    assert dict(src.read_csv(spark, str(tmp_path / "huge")).dtypes) == {"v": "double"}


def test_numbers(spark):
    odd = [float("nan"), float("inf"), float("-inf"), 1e30, -2.5, None]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(odd)], "v double, i int")
    low = [r[0] for r in df.orderBy("i").select(fx.floor("v", like="double")).collect()]
    assert low[0] != low[0] and low[1:] == [float("inf"), float("-inf"), 1e30, -3.0, None]
    assert [r[0] for r in df.orderBy("i").select(fx.ceil("v")).collect()] == [None, None, None, None, -2, None]
    assert df.select(fx.floor(F.lit(2**63 - 1))).first()[0] == 2**63 - 1
    powers = [(3, 39), (-1, 10**6 + 1), (0, 0), (0, 5), (2, 62), (10, 19), (1, 7), (-2, 3)]
    got = [r[0] for r in spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(powers)], "a bigint, b int, i int").orderBy("i").select(fx.pow_("a", "b", like="bigint")).collect()]
    assert got == [a**b if abs(a**b) < 2**63 else None for a, b in powers]
    texts = ["5d", "5D", "0x1p3", "1e3", " 7 ", "inf", "NaN", "x", "3.f", None]
    read = [r[0] for r in spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int").orderBy("i").select(fx.to_number("t")).collect()]
    assert read[:6] == [None, None, None, 1000.0, 7.0, float("inf")] and read[6] != read[6] and read[7:] == [None] * 3
    joined = spark.createDataFrame([("a", 1), ("b", None)], "t string, n int").select(fx.add("t", "n", text=True))
    assert rows_of(joined) == [(None,), ("a1",)]


def test_booleans_and_large_medians(spark):
    df = spark.createDataFrame([(1, True, 2**63 - 1), (1, False, 2**63 - 3), (1, True, 2**63 - 1), (1, True, 2**63 - 1)], "g int, b boolean, v bigint")
    for hot in (1_000_000, 1):
        got = op.summarize(df, ["g"], [Agg("b", "mean"), Agg("b", "median"), Agg("v", "median")], hot_rows=hot).first()
        assert tuple(got) == (1, 0.75, 1.0, float(2**63 - 1))


def test_top_rows_stay_sorted_at_any_size(spark):
    df = spark.range(6000).select((F.col("id") * 7919 % 6000).alias("v"), (F.col("id") % 3).alias("g"))
    want = sorted((tuple(r) for r in df.collect()), key=lambda r: (-r[1], r[0]))
    got = [tuple(r) for r in op.top_k(df, [("g", "desc"), "v"], 3500).collect()]
    assert got == want[:3500]
    assert [tuple(r) for r in op.sample_first(df, 3500, [("g", "desc"), "v"], rows_per_bucket=500).collect()] == want[:3500]
    assert [tuple(r) for r in op.sample_last(df, 3500, [("g", "desc"), "v"], rows_per_bucket=500).collect()] == want[-3500:]


def test_one_sort_value_is_sorted_by_several_tasks(spark):
    """No task may hold much more than its share when every row has the same sort value."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(8000).select(F.lit(1).alias("k"), "id")
        sizes = [r["count"] for r in op.sort_rows(df, ["k"]).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) >= 3 and max(sizes) <= 4 * 8000 / len(sizes)


@pytest.mark.parametrize("names", [("n", "v", "rows"), ("hot0", "place", "total"), ("o0", "carry", "is_hot")])
def test_hot_paths_with_internal_names(spark, names):
    key, order, value = names
    df = spark.range(400).select((F.col("id") % 3 % 2).alias(key), F.col("id").alias(order), (F.col("id") % 7).alias(value))
    columns = {"a": Win("row_number"), "b": Win("sum", value), "c": Win("lag", value), "d": Win("max", value, frame=(-2, 0))}
    assert rows_of(op.ordered_window(df, [key], [order], columns, hot_rows=50)) == rows_of(op.ordered_window(df, [key], [order], columns))
    assert rows_of(op.duplicate_rows(df, [key], [order], hot_rows=50)) == rows_of(op.duplicate_rows(df, [key], [order]))


def test_copies_share_consecutive_positions(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, 5).otherwise(F.col("id")).alias("v"))
    got = sorted((r["row_index"], r["v"]) for r in op.row_index(df, ["v"], rows_per_bucket=100).collect())
    assert got == list(enumerate(sorted([5] * 2500 + list(range(2500, 3000)))))


def test_descending_times(spark):
    day = datetime.timedelta(days=1)
    df = spark.createDataFrame([(1, datetime.time(5), day), (1, datetime.time(7), 2 * day), (1, None, None)], "g int, t time, d interval day to second")
    for c in ("t", "d"):
        filled = df.where(F.col(c).isNotNull())
        got = op.summarize(filled, ["g"], [Agg(c, "first", "f"), Agg(c, "last", "l")], order_by=[(c, "desc")]).first()
        assert got["f"] > got["l"]


def test_views_of_the_caller_survive(spark):
    spark.range(3).createOrReplaceTempView("input1")
    assert op.sql_inputs("SELECT count(*) AS n FROM input1 ;;", spark.range(5)).first()["n"] == 5
    assert spark.table("input1").count() == 3
    spark.catalog.dropTempView("input1")
    op.sql_inputs("SELECT * FROM input1", spark.range(5))
    assert not spark.catalog.tableExists("input1")


def test_names_that_clash(spark):
    left, right = spark.createDataFrame([(1, 2, 3)], "k int, x int, x_right int"), spark.createDataFrame([(1, 9)], "k int, x int")
    assert op.inner_join(left, right, "k").columns == ["k", "x", "x_right", "x_right_right"]
    assert src.repair_headers(["a", "a", "a_1", "", "Column4", "a"]) == ["a", "a_2", "a_1", "Column4", "Column4_1", "a_3"]
    wide = op.crosstab(spark.createDataFrame([(1, None, 2), (1, "null", 3)], "g int, h string, v int"), ["g"], "h", "v")
    assert sorted(wide.columns) == ["g", "null", "null_"] and wide.first()["null_"] == 2
    with pytest.raises(ValueError):
        op.crosstab(wide, ["g"], "null", "g", most_columns=0)


def test_large_json_numbers(spark):
    df = spark.createDataFrame([('{"a": 12345678901234567890}',), ('{"a": 1}',)], "j string")
    assert sorted(str(r["a"]) for r in op.json_parse(df, "j").collect()) == ["1", "12345678901234567890"]


def test_user_groups_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "k int, v int")
    out = op.python_groups(df, ["k"], lambda g: g.groupby("k", dropna=False, as_index=False).v.sum(), "k int, v bigint")
    assert rows_of(out) == [(None, 3), (1, 3)]


def test_scratch_needs_a_shared_folder(spark):
    assert "weftline" in shared_folder(spark, "x")

    class Elsewhere:
        conf = {}

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(ValueError):
        shared_folder(Elsewhere, "x")


def test_groups_of_every_match():
    from weftline.operators.parse import certain_groups

    assert certain_groups(r"(a)(b)?(c(d)*)(?:(e)|f)(?=(g))(?!(h))[(](i)\((j|k){0,2}(l){2}") == {1, 3, 6, 8, 10}
    assert certain_groups("(a)|(b)") == set() and certain_groups(r"\Q(\E(x*)") == {1}


def test_empty_group_is_kept(spark):
    df = spark.createDataFrame([("ab",), ("b",), ("x",)], "t string")
    assert rows_of(op.regex_parse(df, "t", r"^(a*)(c)?b")) == [("ab", "a", None), ("b", "", None), ("x", None, None)]
