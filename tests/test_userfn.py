import pyarrow.compute as pc
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from weftline import operators as op
from weftline.plans import QUERIES


def test_python_frames(customers):
    both = op.python_frames(lambda a, b: (a.where("id < 3"), None), customers, None)
    assert both[0].count() == 2 and both[1].columns == [] and both[1].count() == 0
    with pytest.raises(ValueError):
        op.python_frames(lambda a: 3, customers)


def test_python_batches(customers):
    pandas = op.python_batches(customers, lambda b: b[b.spend > 1000][["id"]], "id bigint")
    arrow = op.python_batches(customers, lambda b: b.filter(pc.greater(b["spend"], 1000)).select(["id"]), "id bigint", arrow=True)
    assert rows_of(pandas) == rows_of(arrow) == [(1,), (3,), (4,), (8,)]


def test_python_groups_and_their_limit(customers):
    def best(g):
        return g.nlargest(1, "spend")[["region", "name"]]

    out = op.python_groups(customers, ["region"], best, "region string, name string")
    assert rows_of(out) == [("East", "Dune"), ("West", "Cedar")]
    with pytest.raises(ValueError, match="python_aggregate"):
        op.python_groups(customers, ["region"], best, "region string, name string", max_group_rows=3)


@pytest.mark.parametrize("state_rows", [1, 10, 100_000])
def test_python_aggregate_combines_before_the_shuffle(spark, state_rows):
    df = spark.range(0, 30_000, 1, 5).select(
        F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 40 > 0, F.col("id") % 40).cast("string").alias("k"), "id"
    )

    def partial(b):
        return b.groupby("k", as_index=False, dropna=False).agg(n=("id", "size"), s=("id", "sum"))

    def merge(p):
        return p.groupby("k", as_index=False, dropna=False).agg(n=("n", "sum"), s=("s", "sum"))

    got = op.python_aggregate(df, ["k"], partial, merge, lambda m: m.assign(s=m.s / m.n)[["k", "s"]], "k string, n bigint, s bigint", "k string, s double", state_rows)
    want = {r[0]: r[1] for r in df.groupBy("k").agg(F.avg("id")).collect()}
    assert {r[0]: r[1] for r in got.collect()} == pytest.approx(want)


def test_preview(customers):
    seen = op.preview(customers, 3, order_by=[("spend", "desc")])
    assert seen.schema[0] == ("id", "int64") and [r["id"] for r in seen.sample.collect()] == [4, 3, 8]
    assert op.preview(customers).sample.count() == 8


def test_step_counts(customers, tmp_path):
    counts = op.StepCounts()
    out = counts.watch("west", counts.watch("all", customers).where("region = 'West'"))
    out.write.parquet(str(tmp_path / "o"))
    assert counts.rows() == {"all": 8, "west": 4}
    with pytest.raises(ValueError):
        counts.watch("all", customers)


@pytest.mark.parametrize("keys", [["k"], ["k", "x"], []])
def test_python_groups_takes_many_whole_groups_in_one_call(spark, keys):
    """Null and NaN keys are groups; one goes over many batches; another group's nulls change no integer."""
    big = 2**53 + 1
    rows = [(big + i % 900, float("nan") if i % 900 < 2 else i % 2 * 1.0, i if i % 7 else None, f"s{i}") for i in range(2700)]
    rows += [(None, 0.5, big, "n")] * 40 + [(7, -0.0, 3, None), (7, 0.0, 4, None)] + [(-5, 1.0, i, "hot") for i in range(1500)]
    df = spark.createDataFrame(rows, "k bigint, x double, first bigint, s string").repartition(7)
    held = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(held, 200)
    try:
        def sums(g):
            made = g.groupby(keys, dropna=False, as_index=False) if keys else g.assign(all=0).groupby("all", as_index=False)
            made = made.agg(rows=("s", "size"), total=("first", "sum"), least=("k", "min"))
            return made.assign(call=str(sorted(g.s.fillna("")))[:300] + str(len(g)))[["least", "rows", "total", "call"]]

        out = op.python_groups(df, keys, sums, "least bigint, rows bigint, total bigint, call string", many=True).collect()
        empty = op.python_groups(df.limit(0), keys, sums, "least bigint, rows bigint, total bigint, call string", many=True).collect()
    finally:
        spark.conf.unset(held)
    want = df.groupBy(*keys).agg(F.min("k"), F.count("*"), F.coalesce(F.sum("first"), F.lit(0)))
    assert sorted((r.least or 0, r.rows, r.total) for r in out) == sorted((r[-3] or 0, r[-2], r[-1]) for r in want.collect())
    assert len({r.call for r in out}) <= 30 and empty == []


def test_udtf_takes_rows_in_batches(spark, tmp_path):
    """With Arrow each call made a table of its own; here thousands of rows share a batch."""
    rows = [(1, "red bolt", 3), (2, None, 3), (3, "", 3), (4, "a  é", 3), (5, "left out", 7), (6, "x", None)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    out = QUERIES["udtf"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan
    assert out.schema.simpleString() == "struct<p_partkey:bigint,place:int,word:string>"
    assert rows_of(out) == [(1, 1, "red"), (1, 2, "bolt"), (2, None, None), (3, 1, ""), (4, 1, "a"), (4, 2, ""), (4, 3, "é"), (5, None, None), (6, None, None)]
