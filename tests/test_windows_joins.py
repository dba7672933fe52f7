import random
from collections import Counter

import pytest
from conftest import rows_of
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline import operators as op
from weftline.operators import Win


@pytest.fixture(scope="module")
def visits(spark):
    rnd = random.Random(11)
    rows = [
        (rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None, 5, 5, *range(60)]), i, rnd.choice([None, 1, 2, 3]))
        for i in range(1500)
    ]
    return spark.createDataFrame(rows, "u int, t int, id int, v int").cache()


SPECS = {
    "rn": Win("row_number"), "pr": Win("percent_rank"), "cd": Win("cume_dist"), "nt": Win("ntile", n=7),
    "lag": Win("lag", "v"), "lead": Win("lead", "v"), "first": Win("first", "v"), "last": Win("last", "v"),
    "n3": Win("nth", "id", 3), "n1": Win("nth", "v", 1), "far": Win("nth", "v", 5000),
    "f1": Win("sum", "v", frame=(-3, 0)), "f2": Win("max", "id", frame=(1, 2)), "f3": Win("count", "v", frame=(-40, 25)),
    "f4": Win("min", "id", frame=(-9, -4)), "s": Win("sum", "v"), "c": Win("count", "v"), "lo": Win("min", "v"), "hi": Win("max", "v"),
}


@pytest.mark.parametrize("order", [["t", "id"], [("t", "desc"), "id"]])
@pytest.mark.parametrize("keys", [["u"], []])
def test_split_window_equals_plain_window(visits, order, keys):
    plain = op.ordered_window(visits, keys, order, SPECS)
    split = op.ordered_window(visits, keys, order, SPECS, hot_rows=100)
    assert split.columns == plain.columns and "order_range" not in split.columns
    assert rows_of(split) == rows_of(plain)


def test_split_ranks_with_ties(visits):
    specs = {"r": Win("rank"), "d": Win("dense_rank"), "p": Win("percent_rank"), "c": Win("cume_dist")}
    df = visits.select("u", "t")
    assert rows_of(op.ordered_window(df, ["u"], ["t"], specs, hot_rows=100)) == rows_of(op.ordered_window(df, ["u"], ["t"], specs))


def test_window_arguments():
    with pytest.raises(ValueError):
        Win("median")
    with pytest.raises(ValueError):
        Win("lag")
    with pytest.raises(ValueError):
        Win("lag", "v", frame=(0, 1))


def test_qualify(customers):
    w = Window.partitionBy("region").orderBy(F.desc("spend"))
    out = op.qualify(customers, "rk <= 1", rk=F.row_number().over(w))
    assert out.columns == customers.columns
    assert {r["name"] for r in out.collect()} == {"Cedar", "Dune"}


def asof_truth(left, right, strict):
    out = Counter()
    for k, t, v in left:
        ok = [] if k is None or t is None else [
            r for r in right if r[0] == k and r[1] is not None and (r[1] < t if strict else r[1] <= t)
        ]
        best = max(ok, key=lambda r: (r[1], r[2])) if ok else None
        out[(k, t, v) + ((best[1], best[2]) if best else (None, None))] += 1
    return out


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("hot_rows", [10**9, 40])
def test_asof_join(spark, strict, hot_rows):
    rnd = random.Random(5)
    left = [(rnd.choice([1, 1, 1, 2, None]), rnd.choice([None, *range(80)]), rnd.randrange(3)) for _ in range(400)]
    right = [(rnd.choice([1, 1, 2, 3]), rnd.choice([None, *range(0, 80, 3)]), rnd.randrange(100)) for _ in range(200)]
    l = spark.createDataFrame(left, "k int, t int, v int")
    r = spark.createDataFrame(right, "k int, t int, w int")
    truth = asof_truth(left, right, strict)
    got = op.asof_join(l, r, ["k"], "t", "t", how="left", strict=strict, hot_rows=hot_rows)
    assert got.columns == ["k", "t", "v", "t_right", "w"]
    assert Counter(map(tuple, got.collect())) == truth
    inner = op.asof_join(l, r, ["k"], "t", "t", strict=strict, hot_rows=hot_rows)
    assert Counter(map(tuple, inner.collect())) == Counter({k: n for k, n in truth.items() if k[3] is not None})


@pytest.mark.parametrize("closed", [False, True])
def test_range_join(spark, closed):
    rnd = random.Random(6)
    points = [(i, rnd.choice([None, 7.0, rnd.uniform(-50, 50)])) for i in range(200)]
    spans = [(i, a, a + rnd.choice([-1.0, 0.0, 3.0, 40.0])) for i, a in enumerate(rnd.choice([7.0, rnd.uniform(-50, 50)]) for _ in range(60))]
    p = spark.createDataFrame(points, "id int, x double")
    s = spark.createDataFrame(spans, "id int, lo double, hi double")
    got = op.range_join(p, s, "x", "lo", "hi", bin_width=5.0, closed=closed)
    assert got.columns == ["id", "x", "id_right", "lo", "hi"]
    truth = Counter(
        (i, x, j, a, b) for i, x in points if x is not None for j, a, b in spans if a <= x and (x <= b if closed else x < b)
    )
    assert Counter(map(tuple, got.collect())) == truth


def test_sql_inputs(spark, customers, regions):
    out = op.sql_inputs("SELECT c.*, r.manager FROM input1 c JOIN input2 r USING (region);", customers, regions)
    assert out.count() == 8
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("input")]
    assert op.sql_schema("SELECT id FROM people", people=customers).names == ["id"]
    with pytest.raises(ValueError):
        op.sql_inputs(" ; ", customers)
    with pytest.raises(ValueError):
        op.sql_inputs("SELECT 1")
    with pytest.raises(Exception):
        op.sql_schema("SELECT nothing FROM input1", customers)


def test_range_join_of_long_intervals(spark):
    """Intervals of every length, to infinity: each goes to a few bins only."""
    points = [(i, x) for i, x in enumerate([None, -9e15, -3.0, 0.0, 9.5, 10.0, 77.0, 4e9, 3.9e12, 4e12, 1e17])]
    spans = [(j, lo, hi) for j, (lo, hi) in enumerate([
        (0.0, 4e12), (-1e16, 1e16), (9.5, 10.0), (10.0, 10.0), (-3.0, 77.0), (5.0, 4.0), (None, 3.0), (3.0, None), (7.0, float("inf")), (float("-inf"), float("inf")), (0.0, 2.0 ** 33)])]
    p = spark.createDataFrame(points, "i int, x double")
    s = spark.createDataFrame(spans, "j int, lo double, hi double")
    for closed in (False, True):
        got = sorted((r["i"], r["j"]) for r in op.range_join(p, s, "x", "lo", "hi", bin_width=10.0, closed=closed).collect())
        assert got == sorted((i, j) for i, x in points for j, lo, hi in spans
                             if None not in (x, lo, hi) and lo <= x and (x <= hi if closed else x < hi))
    whole = spark.createDataFrame([(0, 4_000_000_000_000)], "lo bigint, hi bigint")
    assert op.range_join(spark.range(1000), whole, "id", "lo", "hi", bin_width=10).count() == 1000
