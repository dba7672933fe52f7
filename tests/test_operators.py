import random
from collections import Counter

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from weftline import operators as op
from weftline.operators import Agg, Field
from weftline.operators.ordering import OrderedBuckets, order_items, repeat_rows, sort_columns


# --- projection and filter ---

def test_filter_split_counts(customers):
    out = op.filter_split(customers, "status = 'active'")
    assert (out.true.count(), out.false.count()) == (5, 3)


def test_filter_null_is_in_neither(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "x int")
    out = op.filter_split(df, F.col("x") > 0)
    assert rows_of(out.true) == [(1,)] and rows_of(out.false) == [(-1,)]
    with pytest.raises(ValueError):
        op.filter_split(df, "  ")


def test_select_renames_retypes_drops(customers):
    out = op.select_fields(customers, [Field("spend", "amount", "int32"), "id", Field("name", include=False), Field("region", type="float64")])
    assert out.columns == ["amount", "id", "region"]
    assert out.schema["amount"].dataType.simpleString() == "int"
    assert out.select("region").distinct().collect()[0][0] is None
    assert op.select_fields(customers, []) is customers


def test_unsigned_casts_check_their_range(spark):
    df = spark.createDataFrame([("-1",), ("255",), ("256",), ("x",), (None,)], "v string")
    out = op.select_fields(df, [Field("v", type="uint8")])
    assert [r[0] for r in out.collect()] == [None, 255, None, None, None]
    big = spark.createDataFrame([("18446744073709551615",), ("18446744073709551616",)], "v string")
    assert [str(r[0]) for r in op.select_fields(big, [Field("v", type="uint64")]).collect()] == ["18446744073709551615", "None"]


def test_formulas_see_the_input_row(customers):
    out = op.formula(customers, {"spend": "spend * 2", "twice": (F.col("spend") * 2, "int64"), "": "1", "skip": " "})
    row = out.where("id = 1").first()
    assert row["spend"] == 2401.0 and row["twice"] == 2401 and "skip" not in out.columns


# --- joins and unions ---

def test_join_split(customers, regions):
    out = op.join_split(customers, regions, ["region"])
    assert (out.join.count(), out.left_only.count(), out.right_only.count()) == (8, 0, 1)
    assert out.join.columns == ["id", "name", "status", "region", "spend", "manager", "quota"]


def test_join_null_keys_suffix_and_names(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (3, "w")], "key int, v string")
    out = op.join_split(left, right, [("k", "key")])
    assert out.join.columns == ["k", "v", "v_right"]
    assert rows_of(out.join) == [(1, "a", "x"), (1, "a", "y")]
    assert rows_of(out.left_only) == [(None, "b"), (2, "c")]
    assert rows_of(out.right_only) == [(None, "z"), (3, "w")]
    with pytest.raises(ValueError):
        op.join_split(left, right, [("k", "")])


def test_anti_join_lets_aqe_split_a_hot_left_key(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        left = spark.range(0, 400_000, 1, 8).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.xxhash64("id").alias("v"))
        right = spark.range(0, 300_000, 1, 8).select(F.when(F.col("id") % 3 == 0, 11).otherwise(F.col("id") * 2).alias("k"))
        out = op.unmatched(left, right, ["k"])
        got = out.count()
        hot = out.agg(F.count("*"), F.bit_xor("v"))
        hot.collect()
        plan = hot._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan
        taken = {11} | {2 * i for i in range(300_000) if i % 3}
        assert got == sum(1 for i in range(400_000) if (7 if i % 3 == 0 else i) not in taken)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        for k, v in before.items():
            spark.conf.set(k, v)


def test_union_by_name(customers, regions):
    out = op.union_by_name(customers, regions)
    assert out.count() == 11
    assert out.columns == ["id", "name", "status", "region", "spend", "manager", "quota"]
    assert out.where("id is not null and manager is null").count() == 8


def test_union_widens_and_falls_back_to_text(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([("q", 2.5)], "x string, y double")
    out = op.union_by_name(a, b)
    assert dict(out.dtypes) == {"x": "string", "y": "double"}
    assert rows_of(out) == [("1", 2.0), ("q", 2.5)]


def test_union_by_position(spark):
    a = spark.createDataFrame([(1, "a")], "x int, y string")
    b = spark.createDataFrame([(2**40, "b")], "p bigint, q string")
    out = op.union_by_position(a, b)
    assert out.columns == ["x", "y"] and rows_of(out) == [(1, "a"), (2**40, "b")]
    with pytest.raises(ValueError):
        op.union_by_position(a, b.select("p"))
    with pytest.raises(ValueError):
        op.union_by_name()
    assert op.union_by_name(a) is a


# --- aggregation ---

def test_summarize_region(customers):
    out = op.summarize(customers, ["region"], [Agg("spend", "sum", "total"), Agg("id", "count")])
    assert dict((r["region"], (r["total"], r["count_id"])) for r in out.collect())["West"] == (10850.5, 4)


def test_aggregates_null_and_nan_rules(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [("a", 1.0, True, 3), ("a", None, False, 1), ("a", nan, True, 2), ("b", None, None, 5), ("c", nan, True, 1)],
        "g string, v double, f boolean, o int",
    )
    out = op.summarize(df, ["g"], [
        Agg("v", "min"), Agg("v", "max"), Agg("v", "count"), Agg("v", "count_distinct"),
        Agg("f", "sum"), Agg("v", "first"), Agg("v", "last"), Agg("v", "std"),
    ], order_by=["o"])
    got = {r["g"]: r.asDict() for r in out.collect()}
    assert (got["a"]["min_v"], got["a"]["max_v"], got["a"]["count_v"]) == (1.0, 1.0, 2)
    assert got["a"]["count_distinct_v"] == 3 and got["b"]["count_distinct_v"] == 1
    assert got["a"]["sum_f"] == 2 and got["b"]["sum_f"] == 0
    assert got["a"]["first_v"] is None and got["a"]["last_v"] == 1.0
    assert got["b"]["min_v"] is None and got["b"]["std_v"] is None
    assert got["c"]["max_v"] != got["c"]["max_v"]


def test_summarize_without_keys_or_aggs(customers):
    assert op.summarize(customers, ["region"]).count() == 2
    assert op.summarize(customers) is customers
    empty = op.summarize(customers.where("false"), [], [Agg("spend", "sum"), Agg("spend", "median"), Agg("id", "count_distinct")]).collect()
    assert [tuple(r) for r in empty] == [(0.0, None, 0)]


@pytest.mark.parametrize("ranges", [2, 16, 1024])
def test_exact_median(spark, ranges):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", "b", None]), rnd.choice([1.5, 2.5, rnd.random() * 100, None])) for _ in range(3000)]
    rows.append(("void", None))
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r[0]: r[1] for r in op.exact_median(df, ["g"], "v", "m", ranges).collect()}
    want = {r[0]: r[1] for r in df.groupBy("g").agg(F.median("v")).collect() if r[1] is not None}
    assert got == pytest.approx(want)
    aggs = [Agg("v", "median"), Agg("v", "count"), Agg("v", "median", "again")]
    plain, split = (op.summarize(df, ["g"], aggs, hot_rows=h) for h in (10**9, 800))
    assert split.columns == plain.columns == ["g", "median_v", "count_v", "again"]
    assert rows_of(split) == rows_of(plain) and plain.where("g = 'void'").first()[1] is None
    whole = op.summarize(df, [], aggs, hot_rows=5)
    assert tuple(whole.first()) == pytest.approx(tuple(op.summarize(df, [], aggs).first()))
    assert op.exact_median(df, [], "v", "m", ranges).first()[0] == pytest.approx(df.agg(F.median("v")).first()[0])


# --- reshape ---

def test_crosstab(customers):
    out = op.crosstab(customers, ["region"], "status", "spend")
    assert out.columns == ["region", "active", "inactive"]
    assert {r["region"]: r["inactive"] for r in out.collect()} == {"West": 50.0, "East": 315.25}
    counts = op.crosstab(customers.where("id <> 5"), ["region"], "status", "spend", "count", values=["active", "inactive"])
    assert {r["region"]: r["inactive"] for r in counts.collect()} == {"West": None, "East": 2}
    first = op.crosstab(customers, ["region"], "status", "name", "first", order_by=[("spend", "desc")])
    assert {r["region"]: r["active"] for r in first.collect()} == {"West": "Cedar", "East": "Dune"}
    with pytest.raises(ValueError):
        op.crosstab(customers, [], "status", "spend")


def test_crosstab_too_wide_is_refused(spark):
    spark.conf.set("spark.sql.pivotMaxValues", "10")
    try:
        df = spark.range(50).selectExpr("1 as k", "id as h", "id as v")
        with pytest.raises(ValueError):
            op.crosstab(df, ["k"], "h", "v")
        with pytest.raises(ValueError):
            op.transpose(df, order_by=["h"])
    finally:
        spark.conf.set("spark.sql.pivotMaxValues", "10000")


def test_unpivot(spark):
    df = spark.createDataFrame([("W", 1.0, 2.0), ("E", None, 4.0)], "region string, active double, inactive double")
    out = op.unpivot(df, ["region", "nope"], ["active", "inactive", "gone"])
    assert out.columns == ["region", "name", "value"]
    assert rows_of(out) == [("E", "active", None), ("E", "inactive", 4.0), ("W", "active", 1.0), ("W", "inactive", 2.0)]
    mixed = op.unpivot(df, ["region"], ["region", "active"], "n", "v")
    assert mixed.dtypes[-1] == ("v", "string") and mixed.count() == 4
    assert op.unpivot(df, ["region"], ["gone"]) is df


def test_bounds_become_one_shared_literal(spark):
    from weftline.operators.ordering import OrderRanges
    df = spark.range(1000).withColumn("t", F.timestamp_micros(F.col("id")).cast("timestamp_ntz"))
    ranges = OrderRanges.sampled(df, order_items(["t", ("id", "desc")]), 8, 1000)
    tagged = df.withColumn("r", ranges.number(df))
    assert "from_json" not in tagged._jdf.queryExecution().optimizedPlan().toString()
    sizes = [r["count"] for r in tagged.groupBy("r").count().orderBy("r").collect()]
    assert len(sizes) == ranges.bounds.count + 1 == 8 and max(sizes) < 400
    assert tagged.selectExpr("bool_and(r >= 0)").first()[0]


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_ranges_of_texts_with_one_beginning(spark, direction):
    """Texts that differ behind the sampled width, and a number that runs the other way, keep their positions."""
    from weftline.operators.ordering import OrderedBuckets
    same = "https://example.org/" + "p" * 44
    rows = [(same + f"{i:03d}" if i % 5 else same, 200 - i) for i in range(120)]
    df = spark.createDataFrame(rows, "t string, id int").repartition(4)
    buckets = OrderedBuckets(df, [("t", direction), "id"], rows_per_bucket=5)
    want = sorted(sorted(rows, key=lambda r: r[1]), key=lambda r: r[0], reverse=direction == "desc")
    assert [(r["t"], r["id"]) for r in sorted(buckets.positions("at").collect(), key=lambda r: r["at"])] == want
    assert sorted(map(tuple, buckets.between(0, 13).collect())) == sorted(want[:13])
    assert max(buckets.counts) <= 40


def test_unpivot_odd_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a.b` int, `c d` int, kept_0 int")
    assert rows_of(op.unpivot(df, ["a.b", "kept_0"], ["c d", "a.b"])) == [(1, 3, "a.b", 1), (1, 3, "c d", 2)]


def test_transpose(regions):
    out = op.transpose(regions, "region")
    assert out.columns == ["column", "East", "North", "West"]
    assert {r["column"]: r["West"] for r in out.collect()} == {"manager": "Wendy", "quota": "10000"}
    plain = op.transpose(regions.select("quota"), order_by=["quota"], include_names=False)
    assert plain.columns == ["column_0", "column_1", "column_2"] and rows_of(plain) == [(5000, 8000, 10000)]
    with pytest.raises(ValueError):
        op.transpose(regions.union(regions), "region")


# --- order ---

def test_sort_nulls_first_both_ways(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert [r[0] for r in op.sort_rows(df, ["x"]).collect()] == [None, 1, 2]
    assert [r[0] for r in op.sort_rows(df, [("x", "desc")]).collect()] == [None, 2, 1]
    assert op.sort_rows(df, []) is df


def test_first_last_top(customers):
    assert op.top_k(customers, [("spend", "descending")], 1).first()["spend"] == 9800.75
    assert [r["id"] for r in op.sample_first(customers, 3, ["id"]).collect()] == [1, 2, 3]
    assert [r["id"] for r in op.sample_last(customers, 3, ["id"]).collect()] == [6, 7, 8]
    with pytest.raises(ValueError):
        op.sample_first(customers, 3, None)


def hot_table(spark, n=6000):
    """One order value on a third of the rows, copies of one row on another third."""
    return spark.range(0, n, 1, 7).select(
        F.when(F.col("id") % 3 == 0, 500).when(F.col("id") % 3 == 1, 900).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") % 3 == 1, F.lit("same")).otherwise(F.col("id").cast("string")).alias("v"),
    )


@pytest.mark.parametrize("order", [["k"], [("k", "desc"), "v"], [("v", "desc")]])
@pytest.mark.parametrize("per_bucket", [100_000, 50])
def test_ranges_agree_with_a_plain_sort(spark, order, per_bucket):
    df = hot_table(spark)
    items = order_items(order)
    tied = items + [(c, False) for c in df.columns if c not in {n for n, _ in items}]
    truth = [tuple(r) for r in df.orderBy(*sort_columns(tied)).collect()]
    rows = OrderedBuckets(df, order, per_bucket)
    assert rows.total == len(truth)
    for step in (1, 7, 1000):
        assert Counter(map(tuple, rows.every(step).collect())) == Counter(truth[::step])
    for low, high in ((0, 2500), (1777, 4555), (5990, 6000), (0, 6000), (10, 10)):
        assert Counter(map(tuple, rows.between(low, high).collect())) == Counter(truth[low:high])
    placed = {r["p"]: (r["k"], r["v"]) for r in rows.positions("p").collect()}
    assert [placed[i] for i in range(len(truth))] == truth


def test_large_first_last_every(spark):
    df = hot_table(spark)
    truth = sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))
    assert Counter(map(tuple, op.sample_first(df, 2000, ["k", "v"], 200).collect())) == Counter(truth[:2000])
    assert Counter(map(tuple, op.sample_last(df, 2000, ["k", "v"], 200).collect())) == Counter(truth[-2000:])
    assert Counter(map(tuple, op.sample_every_n(df, 13, ["k", "v"], 200).collect())) == Counter(truth[::13])


@pytest.mark.parametrize("hot_rows", [10**9, 100])
def test_random_samples_are_exact_and_repeatable(spark, hot_rows):
    df = hot_table(spark)
    source = Counter(map(tuple, df.collect()))
    for n in (10, 1500, 2345, 6000, 9000):
        a = Counter(map(tuple, op.sample_random_n(df, n, seed=42, hot_rows=hot_rows).collect()))
        b = Counter(map(tuple, op.sample_random_n(df.repartition(3), n, seed=42).collect()))
        assert a == b and sum(a.values()) == min(n, 6000) and not a - source
    assert op.sample_random_pct(df, 12.5, seed=1).count() == 750
    assert op.sample_random_pct(df, 250, seed=1).count() == 6000
    assert op.sample_random_pct(df, 0, seed=1).count() == 0
    assert op.sample_random_n(df, 5).count() == 5


def test_repeat_rows_in_chunks(spark):
    df = spark.createDataFrame([("a", 200_000), ("b", 1), ("c", 0), ("d", 65_536)], "v string, t bigint")
    assert {r[0]: r[1] for r in repeat_rows(df, "t").groupBy("v").count().collect()} == {"a": 200_000, "b": 1, "d": 65_536}


def test_unique_split(customers):
    out = op.unique_split(customers, ["region"], ["id"])
    assert [r["id"] for r in out.unique.orderBy("id").collect()] == [1, 2]
    assert out.duplicates.count() == 6


@pytest.mark.parametrize("hot_rows", [10**9, 2])
def test_unique_split_copies_and_nulls(spark, hot_rows):
    df = spark.createDataFrame([(None, 1), (None, 1), (None, 2), (5, 1), (5, 1), (6, 9)], "k int, o int")
    out = op.unique_split(df, ["k"], ["o"], hot_rows)
    assert rows_of(out.unique) == [(None, 1), (5, 1), (6, 9)]
    assert rows_of(out.duplicates) == [(None, 1), (None, 2), (5, 1)]
    last = op.unique_split(df, ["k"], [("o", "desc")], hot_rows)
    assert rows_of(last.unique) == [(None, 2), (5, 1), (6, 9)]
    assert rows_of(last.duplicates) == [(None, 1), (None, 1), (5, 1)]
    whole = op.unique_split(df)
    assert whole.unique.count() == 4 and rows_of(whole.duplicates) == [(None, 1), (5, 1)]
    with pytest.raises(ValueError):
        op.unique_split(df, ["k"])


def test_unique_sends_one_row_per_hot_key_and_task(customers):
    plan = op.unique_rows(customers, ["region"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")


@pytest.mark.parametrize("order", [["k"], [("v", "desc")]])
def test_hot_duplicates(spark, order):
    df = hot_table(spark).withColumn("g", F.col("k") % 2)
    plain = op.unique_split(df, ["g"], order)
    split = op.unique_split(df, ["g"], order, hot_rows=500)
    assert Counter(map(tuple, split.duplicates.collect())) == Counter(map(tuple, plain.duplicates.collect()))
    assert Counter(map(tuple, split.duplicates.unionByName(split.unique).collect())) == Counter(map(tuple, df.collect()))
