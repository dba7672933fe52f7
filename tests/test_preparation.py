"""Fuzzy matching, recurrences, replacing, tiles, gap filling and profiles against plain versions."""
import datetime as dt
import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from weftline import operators as op
from weftline.operators import fuzzy, gaps, replacing


def largest_task(spark, run):
    """Most rows that one partition of the result holds, with nothing merged after the shuffle."""
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "101"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        out = run()
        return max(r["n"] for r in out.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(seed, n):
    rng = random.Random(seed)
    out = ["", "a", "ab", "ba", "abc", "é", "日本", None, "\u0001x"]
    for _ in range(n):
        w = [rng.choice("aabbcé") for _ in range(rng.randrange(12))]
        out.append("".join(w))
        for _ in range(rng.randrange(5)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(["", "c", "ab"])
        out.append("".join(w))
    return out


@pytest.mark.parametrize(("k", "q", "hot", "few"), [(0, 2, 10**6, 10**6), (1, 2, 10**6, 10**6), (2, 2, 40, 10**6), (3, 2, 10**6, 0), (2, 3, 25, 0)])
def test_fuzzy_pairs_against_all_pairs(spark, monkeypatch, k, q, hot, few):
    monkeypatch.setattr(fuzzy, "HOT_POSTINGS", hot)
    monkeypatch.setattr(fuzzy, "BROADCAST_GRAMS", few)
    a, b = words(1, 60), words(2, 60)
    left = spark.createDataFrame([(x, 1) for x in a + a[:9]], "t string, text int")
    right = spark.createDataFrame([(x,) for x in b], "t string")
    got = rows_of(op.fuzzy_pairs(left, right, "t", "t", k, q))
    want = [(x, y, d) for x in set(a) - {None} for y in set(b) - {None} if (d := edits(x, y)) <= k]
    assert got == sorted(want, key=lambda r: [(True, str(v)) for v in r])


def test_fuzzy_match_keeps_rows_and_empty_tables(spark):
    left = spark.createDataFrame([(1, "Jon Smith"), (1, "Jon Smith"), (2, None), (3, "")], "id int, name string")
    right = spark.createDataFrame([(7, "John Smith"), (8, "Smith"), (9, None), (9, "x")], "id int, name string")
    assert rows_of(op.fuzzy_match(left, right, "name", "name")) == [(1, "Jon Smith", 7, "John Smith", 1)] * 2 + [(3, "", 9, "x", 1)]
    assert op.fuzzy_match(left, right.limit(0), "name", "name").collect() == [] == op.fuzzy_pairs(left.limit(0), right, "name", "name").collect()


def test_fuzzy_plan_compares_no_all_pairs(spark):
    left = spark.createDataFrame([("ab",)], "t string")
    plan = op.fuzzy_pairs(left, left, "t", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def plain_recurrence(rows, kind, start):
    """rows: (key, order, a, b, reset)."""
    out, last = [], {}
    step = {"affine": lambda a, b, y: a * y + b, "max_plus": lambda a, b, y: max(y + a, b), "min_plus": lambda a, b, y: min(y + a, b)}[kind]
    for key, order, a, b, reset in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        y = start if reset or key not in last else last[key]
        y = None if a is None or b is None or y is None else step(a, b, y)
        last[key] = y
        out.append((key, order, y))
    return out


@pytest.mark.parametrize("kind", ["affine", "max_plus", "min_plus"])
@pytest.mark.parametrize("hot_rows", [10**6, 30])
def test_recurrence_against_row_by_row(spark, kind, hot_rows):
    rng = random.Random(4)
    rows = [(k, i if i else None, None if rng.random() < 0.02 else rng.choice([-1, 0, 1, 1, 2]) if kind == "affine" and i % 9 == 0 else 1 if kind == "affine" else rng.randrange(-9, 9),
             rng.randrange(-50, 50), rng.random() < 0.1) for k, n in ((1, 400), (2, 7), (None, 90)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i int, a bigint, b bigint, key boolean").repartition(5)
    got = op.recurrence(df, ["k"], ["i"], "y", "a", "b", kind, start=3, reset="key", hot_rows=hot_rows)
    assert got.columns == ["k", "i", "a", "b", "key", "y"]
    assert rows_of(got.select("k", "i", "y")) == rows_of(spark.createDataFrame(plain_recurrence(rows, kind, 3), "k int, i int, y bigint"))


def test_recurrence_of_one_hot_key_is_worked_on_by_many_tasks(spark):
    df = spark.range(20_000).selectExpr("id", "1.0D AS a", "double(id) AS b")
    got = op.recurrence(df, [], ["id"], "y", "a", "b", hot_rows=4000)
    assert [r.y for r in got.where("id in (0, 9999, 19999)").orderBy("id").collect()] == [0.0, 9999 * 10000 / 2, 19999 * 20000 / 2]
    assert largest_task(spark, lambda: op.recurrence(df, [], ["id"], "y", "a", "b", hot_rows=1000)) <= 4000
    assert op.recurrence(df.limit(0), [], ["id"], "y", "a", "b").collect() == []
    with pytest.raises(ValueError):
        op.recurrence(df, [], ["id"], "a", "a", "b")


def plain_replace(text, entries):
    if text is None:
        return None
    out, i = [], 0
    while i < len(text):
        fits = [f for f in entries if f and text.startswith(f, i)]
        f = max(fits, key=len, default=None)
        out.append(entries[f] if f else text[i])
        i += len(f) if f else 1
    return "".join(out)


@pytest.mark.parametrize("limit", [replacing.BROADCAST_BYTES, 0])
def test_find_replace_against_plain_replacing(spark, monkeypatch, limit):
    monkeypatch.setattr(replacing, "BROADCAST_BYTES", limit)
    rng = random.Random(6)
    entries = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 6))): rng.choice(["", "X", "ab", "<é>"]) for _ in range(40)} | {"a.b": "dot", "$1": "\\1", "long " * 50: "L"}
    rows = [*entries.items(), ("", "never"), (None, "never"), ("aab", None if "aab" in entries else "zz")]
    entries.setdefault("aab", "zz")
    entries = {f: min(v or "" for g, v in rows if g == f) for f in entries}
    texts = ["".join(rng.choice("abé c") for _ in range(rng.randrange(30))) for _ in range(150)] + ["", None, "a.b$1 axb", "long " * 120, "ab" * 40_000, "abé", "abé"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "put int, text string, find string")
    lookup = spark.createDataFrame(rows, "f string, text string")
    got = op.find_replace(df, "text", lookup, "f", "text")
    assert got.columns == df.columns
    assert {r.put: r.text for r in got.collect()} == {i: plain_replace(t, entries) for i, t in enumerate(texts)}
    whole = op.find_replace(df, "text", lookup, "f", "text", whole=True)
    assert {r.put: r.text for r in whole.collect()} == {i: entries.get(t, t) for i, t in enumerate(texts)}
    assert rows_of(op.find_replace(df, "text", lookup.limit(0), "f", "text")) == rows_of(df)
    assert op.find_replace(df.limit(0), "text", lookup, "f", "text").collect() == []


def test_find_replace_sorts_no_copies_of_entries(spark):
    """A hash aggregate leaves one of each entry before the least replacement is found, for which Spark sorts."""
    lookup = spark.range(1000).selectExpr("concat('f', id % 3) AS f", "concat('p', id % 6) AS p")
    df = spark.createDataFrame([("f0",), ("f1 f2",), ("x",), (None,)], "t string")
    out = op.find_replace(df, "t", lookup, "f", "p", whole=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan
    assert rows_of(out) == [(None,), ("f1 f2",), ("p0",), ("x",)]
    assert rows_of(op.find_replace(df, "t", lookup, "f", "p")) == [(None,), ("p0",), ("p1 p2",), ("x",)]


@pytest.mark.parametrize("hot_rows", [10**6, 20])
def test_tiles_against_plain_sums(spark, hot_rows):
    rng = random.Random(7)
    rows = [(i, rng.choice(["p", "q", None]), None if rng.random() < 0.1 else float("nan") if rng.random() < 0.05 else rng.randrange(-300, 3000) / 100) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, x double").repartition(6)
    got = op.tile(df, 9, "c", order_by=["id"], hot_rows=hot_rows)
    got = op.tile(got, 5, "s", "sum", "x", [("id", "desc")], ["k"], hot_rows)
    got = op.tile(got, 6, "w", "width", "x", partition_by=["k"])
    found = {r.id: (r.c, r.s, r.w) for r in got.collect()}
    weight = lambda x: round(max(x, 0) * 10**6) if x is not None and x == x else 0
    assert len(found) == 400
    for key in ("p", "q", None):
        mine = sorted((r for r in rows if r[1] == key), reverse=True)
        total, upto = sum(weight(x) for *_, x in mine), 0
        real = [x for *_, x in mine if x is not None and x == x]
        for i, _, x in mine:
            assert found[i][1] == min(5, 1 + upto * 5 // total)
            upto += weight(x)
            assert found[i][2] == (None if x is None or x != x else min(6, 1 + int((x - min(real)) * 6 / (max(real) - min(real)))))
    assert [found[i][0] for i in range(400)] == sorted([1 + i % 9 for i in range(400)])
    zero = spark.createDataFrame([(1, 0.0), (2, -5.0), (3, None)], "id int, x double")
    assert rows_of(op.tile(op.tile(zero, 4, "s", "sum", "x", ["id"]), 3, "w", "width", "x").select("s", "w")) == [(1, None), (1, 1), (1, 3)]
    assert op.tile(zero.limit(0), 4, "s", "sum", "x", ["id"]).collect() == []


def plain_fill(rows, step):
    """rows: (key, at, value); the last known value is carried."""
    out = [(k, t, v, False) for k, t, v in rows if t is None]
    for key in {r[0] for r in rows}:
        mine = sorted(((t, (v is not None, v), v) for k, t, v in rows if k == key and t is not None))
        known = None
        for i, (t, _, v) in enumerate(mine):
            known = v if v is not None else known
            out.append((key, t, known, False))
            at = t + step
            while i + 1 < len(mine) and at < mine[i + 1][0]:
                out.append((key, at, known, True))
                at += step
    return out


@pytest.mark.parametrize(("hot_rows", "chunk"), [(10**6, 65_536), (15, 3)])
def test_ts_fill_against_plain_loop(spark, monkeypatch, hot_rows, chunk):
    monkeypatch.setattr(gaps, "CHUNK_OF_COPIES", chunk)
    rng = random.Random(8)
    rows = [(rng.choice(["a", "a", "b", None]), None if rng.random() < 0.05 else rng.randrange(2000), None if rng.random() < 0.4 else rng.randrange(9)) for _ in range(120)] + [("one", 5, 1)]
    df = spark.createDataFrame(rows, "k string, at bigint, v int").repartition(4)
    got = op.ts_fill(df, ["k"], "at", 7, carried=["v"], filled="chunk", hot_rows=hot_rows)
    assert rows_of(got) == rows_of(spark.createDataFrame(plain_fill(rows, 7), "k string, at bigint, v int, chunk boolean"))
    day = dt.datetime(2024, 2, 28, 12)
    stamps = spark.createDataFrame([(day, 1, "x"), (day + dt.timedelta(days=3), 2, "y")], "at timestamp_ntz, n int, s string")
    filled = op.ts_fill(stamps, [], "at", (1, "day"), carried=["n"])
    assert rows_of(filled) == [(day, 1, "x"), (day + dt.timedelta(days=1), 1, None), (day + dt.timedelta(days=2), 1, None), (day + dt.timedelta(days=3), 2, "y")]
    assert op.ts_fill(stamps.selectExpr("cast(at as timestamp) as at"), [], "at", (12, "hour")).count() == 7
    assert op.ts_fill(stamps.limit(0), [], "at", (1, "day")).collect() == []
    with pytest.raises(ValueError):
        op.ts_fill(stamps.selectExpr("cast(at as date) as d"), [], "d", (1, "hour"))


def test_a_long_gap_is_filled_by_many_tasks(spark):
    df = spark.createDataFrame([(0, 1), (10_000_001, None)], "at bigint, v int")
    run = lambda: op.ts_fill(df, [], "at", 1, carried=["v"])
    assert run().agg(F.count("*"), F.sum("v"), F.sum("at")).first()[:] == (10_000_002, 10_000_002, 10_000_001 * 10_000_002 // 2)
    assert largest_task(spark, run) < 1_000_000


def test_column_profile_against_exact_values(spark):
    rng = random.Random(9)
    rows = [(i, None if rng.random() < 0.2 else int(rng.expovariate(0.3)), rng.gauss(0, 9) if rng.random() < 0.9 else float("nan"), rng.choice(["a", "b", None, "x" * 600, "x" * 600 + "y"]),
             i % 7 == 0, [i % 3], bytes([i % 5])) for i in range(30_000)]
    df = spark.createDataFrame(rows, "id bigint, `a.b` int, x double, s string, f boolean, l array<int>, raw binary").repartition(7)
    got = {r.name: r for r in op.column_profile(df, bins=8, top=3).collect()}
    assert list(got) == df.columns and all(r.rows == 30_000 for r in got.values())
    for i, name in enumerate(df.columns):
        values = [r[i] for r in rows if r[i] is not None]
        r = got[name]
        assert r.nulls == 30_000 - len(values) and abs(r.null_pct - r.nulls / 30_000) < 1e-12
        distinct = len({str(v) for v in values})
        assert abs(r.distinct - distinct) <= 0.1 * distinct
        if name not in ("id", "x"):
            counts = sorted(([str(v) for v in values].count(k) for k in {str(v) for v in values}), reverse=True)
            assert [f["count"] for f in r.frequent] == counts[:3]
    for i in (0, 1, 2):
        values = sorted(r[i] for r in rows if r[i] is not None and r[i] == r[i])
        r = got[df.columns[i]]
        assert abs(r.mean - sum(values) / len(values)) < 1e-6
        for share, q in zip((0, 0.25, 0.5, 0.75, 1), r.quantiles):
            below, upto = sum(v < q for v in values), sum(v <= q for v in values)
            assert below - len(values) / 5000 <= share * len(values) <= upto + len(values) / 5000
        edges = [b.low for b in r.histogram] + [r.histogram[-1].high]
        assert (edges[0], edges[-1], len(edges)) == (values[0], values[-1], 9) and sum(b["count"] for b in r.histogram) == len(values)
        assert [b["count"] for b in r.histogram] == [sum(min(7, int((v - edges[0]) / ((edges[-1] - edges[0]) / 8))) == j for v in values) for j in range(8)]
    assert got["f"].min == "false" and got["s"].type == "string" and got["l"].type == "list"


def test_column_profile_of_odd_tables(spark):
    empty = op.column_profile(spark.createDataFrame([], "a int, b string")).collect()
    assert [(r.name, r.rows, r.nulls, r.null_pct, r.distinct, r.min, r.quantiles, r.frequent, r.histogram) for r in empty] == [("a", 0, 0, None, 0, None, None, [], []), ("b", 0, 0, None, 0, None, None, [], [])]
    same = op.column_profile(spark.createDataFrame([(5.0, None), (5.0, None), (float("inf"), None)], "x double, n int")).collect()
    assert [tuple(b) for b in same[0].histogram] == [(5.0, float("inf"), 3)] and same[1].nulls == 3 and same[1].histogram == []
