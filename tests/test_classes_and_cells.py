"""Ordered texts, class sizes, bad cells and partitioned folders against plain versions."""
import random
from collections import Counter

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from weftline import operators as op
from weftline import sources as src
from weftline.operators import balance


def firsts_null(v):
    return (v is not None, v if v is not None else 0)


@pytest.mark.parametrize("hot", [10**6, 30])
@pytest.mark.parametrize("keys", [["k"], []])
def test_concat_text(spark, hot, keys):
    rng = random.Random(3)
    data = [(rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, 1, 2, 3]), rng.choice(["x", "", "é,", None, "zz"]), i) for i in range(300)]
    data += [("nulls", 1, None, 0)]
    df = spark.createDataFrame(data, "k string, part int, value string, n int").repartition(5)
    got = op.concat_text(df, keys, "value", [("part", "desc"), "n"], "out", "|", hot_rows=hot)
    assert got.columns == [*keys, "out"]
    groups = {}
    for k, p, v, n in data:
        groups.setdefault(k if keys else (), []).append(((0, 0) if p is None else (1, -p), n, v))
    want = []
    for k, rows in groups.items():
        texts = [v for _, _, v in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "")) if v is not None]
        want.append(((k,) if keys else ()) + ("|".join(texts) if texts else None,))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_concat_text_of_one_hot_group_uses_many_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id"), F.col("id").cast("string").alias("v"))
    out = op.concat_text(df, ["k"], "v", ["id"], hot_rows=500)
    assert out.first()["concat_v"] == ", ".join(map(str, range(20_000)))


def test_concat_text_bounds_and_empty(spark):
    empty = spark.createDataFrame([], "k string, v string")
    assert op.concat_text(empty, ["k"], "v", ["v"]).count() == 0
    assert rows_of(op.concat_text(empty, [], "v", ["v"])) == [(None,)]
    df = spark.createDataFrame([("a", "xxxx"), ("a", "yyyy")], "k string, v string")
    assert rows_of(op.concat_text(df, ["k"], "v", ["v"], separator="--", most_bytes=10)) == [("a", "xxxx--yyyy")]
    with pytest.raises(ValueError, match="10 bytes"):
        op.concat_text(df, ["k"], "v", ["v"], separator="--", most_bytes=9)
    with pytest.raises(ValueError):
        op.concat_text(df, ["k"], "v", [])


def classes(spark, copies=1):
    rows = [("big", i) for i in range(900)] + [("mid", i) for i in range(70)] + [(None, i) for i in range(9)]
    return spark.createDataFrame(rows * copies, "kind string, batch int")


@pytest.mark.parametrize("broadcast", [10**6, 0])
@pytest.mark.parametrize("sizes", [50, "smallest", "largest", {"big": 13, None: 40}, {"mid": 0}, 0])
def test_class_sizes_are_exact(spark, monkeypatch, sizes, broadcast):
    monkeypatch.setattr(balance, "BROADCAST_CLASSES", broadcast)
    own = {"big": 900, "mid": 70, None: 9}
    want = {k: sizes.get(k, n) if isinstance(sizes, dict) else {"smallest": 9, "largest": 900}.get(sizes, sizes) for k, n in own.items()}
    got = Counter(map(tuple, op.resample_classes(classes(spark), "kind", sizes, seed=5).collect()))
    for kind, n in want.items():
        times = [c for (k, _), c in got.items() if k == kind]
        assert sum(times) == n
        # No row is more than one copy ahead of another, and none is left out when the class grows.
        assert not n or max(times) - (min(times) if len(times) == own[kind] else 0) <= 1
    for parts in (1, 7):
        again = op.resample_classes(classes(spark).repartition(parts, "batch"), "kind", sizes, seed=5)
        assert Counter(map(tuple, again.collect())) == got


def test_class_sizes_with_equal_rows_and_long_runs(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1)] * 500 + [("a", 2)] * 3 + [("b", 1)], "class string, prefix int")
    got = Counter(map(tuple, op.resample_classes(df, "class", 100, seed=2).collect()))
    assert sum(n for (k, _), n in got.items() if k == "a") == 100 and got["b", 1] == 100
    monkeypatch.setattr(balance, "CHUNK_OF_COPIES", 32)
    assert Counter(map(tuple, op.resample_classes(df, "class", 100, seed=2).collect())) == got
    assert op.resample_classes(df.limit(0), "class", 5, seed=1).count() == 0
    with pytest.raises(ValueError):
        op.resample_classes(df, "class", "median")
    with pytest.raises(ValueError):
        op.resample_classes(df, "class", {"a": -1})


CELLS = [("1", "x", "2020-01-01"), (" 2 ", None, ""), ("two", "y", "2020-13-01"), (None, "", "soon"), ("3", "z", None)]
TYPES = {"n": "int64", "s": "string", "day": "date"}


def cells(spark):
    return spark.createDataFrame(CELLS, "n string, s string, day string").withColumn("row", F.lit(7))


def test_bad_cells_null_and_drop(spark):
    import datetime as dt

    day = dt.date(2020, 1, 1)
    kept = src.checked_text(cells(spark), TYPES, "null")
    assert kept.good.columns == ["n", "s", "day"]
    assert set(map(tuple, kept.good.collect())) == {(1, "x", day), (2, None, None), (None, "y", None), (None, None, None), (3, "z", None)}
    assert kept.seen.get == {"rows": 5, "bad_rows": 2, "bad_cells": 3}
    dropped = src.checked_text(cells(spark), TYPES, "drop")
    assert set(map(tuple, dropped.good.collect())) == {(1, "x", day), (2, None, None), (3, "z", None)}
    assert dropped.seen.get == {"rows": 5, "bad_rows": 2, "bad_cells": 3}
    told = {(r["n"], r["row"], tuple(map(tuple, r["reasons"]))) for r in dropped.rejected.collect()}
    assert told == {("two", 7, (("n", "int64", "two"), ("day", "date", "2020-13-01"))), (None, 7, (("day", "date", "soon"),))}


def test_bad_cells_error(spark):
    bad = src.checked_text(cells(spark), TYPES, "error")
    with pytest.raises(Exception, match="is no"):
        bad.good.select("s").collect()
    fine = src.checked_text(cells(spark).where("s = 'x'"), TYPES, "error")
    assert fine.good.count() == 1
    none = src.checked_text(cells(spark).limit(0), TYPES, "drop")
    assert none.good.count() == 0 and none.seen.get["bad_cells"] == 0
    with pytest.raises(ValueError):
        src.checked_text(cells(spark), TYPES, "ignore")
    with pytest.raises(ValueError):
        src.checked_text(cells(spark), {})


def test_counts_come_from_the_sink(spark, tmp_path):
    checked = src.checked_text(cells(spark), TYPES, "drop")
    src.write_parquet(checked.good, str(tmp_path / "out"))
    assert checked.seen.get == {"rows": 5, "bad_rows": 2, "bad_cells": 3}


def test_partitions(spark, tmp_path):
    path = str(tmp_path / "parts")
    df = spark.createDataFrame([(i, ["a", "b", None][i % 3], i % 4) for i in range(120)], "v int, k string, g int")
    src.write_partitioned(df, path, ["k", "g"], rows_per_file=4)
    back = src.read_partitioned(spark, path)
    assert rows_of(back.select("v", "k", "g")) == rows_of(df)
    files = {r["f"] for r in back.select(F.input_file_name().alias("f")).collect()}
    src.write_partitioned(df.where("k = 'a' and g = 0").withColumn("v", -F.col("v")), path, ["k", "g"], mode="replace")
    back = src.read_partitioned(spark, path)
    changed = df.withColumn("v", F.when((F.col("k") == "a") & (F.col("g") == 0), -F.col("v")).otherwise(F.col("v")))
    assert rows_of(back.select("v", "k", "g")) == rows_of(changed)
    left = {r["f"] for r in back.select(F.input_file_name().alias("f")).collect()}
    assert {f for f in files if "k=a/g=0" not in f} == {f for f in left if "k=a/g=0" not in f}  # others were not touched
    src.write_partitioned(df.where("g = 1"), path, ["k", "g"], mode="append")
    assert src.read_partitioned(spark, path).count() == 150
    with pytest.raises(ValueError):
        src.write_partitioned(df, path, ["v", "k", "g"])


def test_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "pruned")
    df = spark.range(3000).select("id", (F.col("id") % 10).cast("int").alias("g"))
    src.write_partitioned(df, path, ["g"])
    few = src.read_partitioned(spark, path).where("g < 2")
    scan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(g" in scan and few.count() == 600
    names = str(tmp_path / "names")
    spark.createDataFrame([(1, "one"), (2, "two")], "g int, name string").write.parquet(names)
    joined = src.read_partitioned(spark, path).join(spark.read.parquet(names).where("name = 'two'"), "g", "left_semi")
    assert "dynamicpruning" in joined._jdf.queryExecution().optimizedPlan().toString().lower()
    assert joined.count() == 300


@pytest.mark.parametrize("keys", [["k"], []])
def test_concat_text_follows_the_order_across_ranges_of_long_texts(spark, keys):
    """Texts that share their first 64 characters, with keys behind them, in both directions."""
    rng = random.Random(5)
    data = [(rng.choice([1.5, 0.0, -0.0, None]), "p" * rng.choice([1, 63, 64, 65, 66]) + rng.choice("AB"), rng.choice([None, 1.5, -2.0]), rng.choice(["x", "é" * 70 + "1", "é" * 70 + "2"])) for _ in range(900)]
    df = spark.createDataFrame(data, "k double, t string, x double, v string").repartition(5)
    for down in (False, True):
        got = op.concat_text(df, keys, "v", [("t", "desc" if down else "asc"), ("x", "desc")], "out", "|", hot_rows=40)
        want = {}
        for k, t, x, v in data:
            want.setdefault(k if keys else 0, []).append((t, x is not None, -(x or 0), v))
        plain = lambda rows: sorted(sorted(rows, key=lambda r: r[1:]), key=lambda r: r[0], reverse=down)
        assert {r[0] if keys else 0: r["out"] for r in got.collect()} == {k: "|".join(r[3] for r in plain(rows)) for k, rows in want.items()}


def test_concat_text_sorts_no_long_list_by_a_lambda_and_cuts_groups_of_half_a_million(spark):
    df = spark.range(600_000).select(F.lit(1).alias("k"), (F.col("id") % 1000).alias("o"), F.col("id").cast("string").alias("v"))
    out = op.concat_text(df, ["k"], "v", [("o", "desc")])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan and "RepartitionByExpression" in plan
    want = sorted(range(600_000), key=lambda i: (-(i % 1000), str(i)))
    assert out.first()["concat_v"] == ", ".join(map(str, want))


def test_concat_text_refuses_no_text_that_a_cell_holds(spark):
    df = spark.range(70).select(F.lit(1).alias("k"), "id", F.repeat(F.lit("x"), 1_000_000).alias("v"))
    assert op.concat_text(df, ["k"], "v", ["id"]).columns == ["k", "concat_v"]
    with pytest.raises(ValueError):
        op.concat_text(df, ["k"], "v", ["id"], most_bytes=70_000_000)
