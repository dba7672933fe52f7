"""Sorting, sampling, duplicates, previews."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import operators as op
from weftline.plans.registry import Tables, query

_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


def _orders(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("sort_rows", f"""
SELECT {_ORDERS}, nullif(o_orderstatus, 'P') AS state FROM orders
ORDER BY state DESC NULLS FIRST, o_totalprice NULLS FIRST, o_orderkey""")
def sort_rows(t: Tables) -> DataFrame:
    orders = _orders(t).withColumn("state", F.nullif("o_orderstatus", F.lit("P")))
    return op.sort_rows(orders, [("state", "desc"), "o_totalprice", "o_orderkey"])


@query("top_k", f"SELECT {_ORDERS} FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k(t: Tables) -> DataFrame:
    return op.top_k(_orders(t), [("o_totalprice", "desc"), "o_orderkey"], 100)


@query("sample_first", f"SELECT {_ORDERS} FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 2500")
def sample_first(t: Tables) -> DataFrame:
    return op.sample_first(_orders(t), 2_500, ["o_totalprice", "o_orderkey"])


@query("sample_last", f"SELECT {_ORDERS} FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 500")
def sample_last(t: Tables) -> DataFrame:
    return op.sample_last(_orders(t), 500, ["o_totalprice", "o_orderkey"])


@query("sample_every_n", f"SELECT {_ORDERS} FROM orders QUALIFY (row_number() OVER (ORDER BY o_orderkey) - 1) % 7 = 0")
def sample_every_n(t: Tables) -> DataFrame:
    return op.sample_every_n(_orders(t), 7, ["o_orderkey"])


_BY_DIGEST = f"SELECT {_ORDERS} FROM orders ORDER BY md5(concat_ws('|', '42', o_orderkey)), o_orderkey"


@query("sample_random_n", f"{_BY_DIGEST} LIMIT 3000")
def sample_random_n(t: Tables) -> DataFrame:
    return op.sample_random_n(_orders(t), 3_000, seed=42, keys=["o_orderkey"])


@query("sample_random_pct", f"{_BY_DIGEST} LIMIT (SELECT CAST(floor(count(*) * 0.125) AS BIGINT) FROM orders)")
def sample_random_pct(t: Tables) -> DataFrame:
    return op.sample_random_pct(_orders(t), 12.5, seed=42, keys=["o_orderkey"])


_RANKED = """
SELECT user_id, event_type, ts, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) {} 1"""


def _events(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_type", "ts", "event_id", "value")


@query("unique_rows", _RANKED.format("="))
def unique_rows(t: Tables) -> DataFrame:
    return op.unique_rows(_events(t), ["user_id", "event_type"], ["ts", "event_id"])


@query("duplicate_rows", _RANKED.format(">"))
def duplicate_rows(t: Tables) -> DataFrame:
    return op.duplicate_rows(_events(t), ["user_id", "event_type"], ["ts", "event_id"])


@query("preview", f"SELECT {_ORDERS} FROM orders ORDER BY o_orderkey LIMIT 1000")
def preview(t: Tables) -> DataFrame:
    return op.preview(_orders(t), order_by=["o_orderkey"]).sample


@query("step_row_counts", """
SELECT 'read' AS step, count(*) AS "rows" FROM lineitem
UNION ALL SELECT 'kept', count(*) FROM lineitem WHERE l_quantity > 25
UNION ALL SELECT 'grouped', count(*) FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity > 25)""")
def step_row_counts(t: Tables) -> DataFrame:
    """Row counts of three steps, gathered by the one job that runs the pipeline."""
    counts = op.StepCounts()
    lines = counts.watch("read", t.lineitem.select("l_suppkey", "l_quantity"))
    kept = counts.watch("kept", lines.where("l_quantity > 25"))
    grouped = counts.watch("grouped", kept.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("quantity")))
    grouped.write.format("noop").mode("overwrite").save()
    return t.spark.createDataFrame(list(counts.rows().items()), "step string, rows bigint")
