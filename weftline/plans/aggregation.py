"""Grouped and global aggregates."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import operators as op
from weftline.operators import Agg
from weftline.plans.registry import Tables, query

KEYS = ["l_returnflag", "l_linestatus"]


def _lines(t: Tables) -> DataFrame:
    """Line items with a discount that is null instead of zero."""
    return t.lineitem.select(
        *KEYS, "l_quantity", "l_extendedprice", "l_orderkey",
        F.expr("nullif(l_discount, 0)").alias("discount"),
        F.expr("nullif(l_linenumber, 3)").alias("line"),
    )


def _sql(aggregate: str, alias: str) -> str:
    return f"""
SELECT l_returnflag, l_linestatus, {aggregate} AS {alias}
FROM (SELECT *, nullif(l_discount, 0) AS discount, nullif(l_linenumber, 3) AS line FROM lineitem)
GROUP BY ALL"""


@query("agg_sum", _sql("coalesce(sum(CASE WHEN l_returnflag <> 'A' THEN l_quantity END), 0)", "sum_l_quantity"))
def agg_sum(t: Tables) -> DataFrame:
    """The quantities of one flag are all null and sum to zero."""
    lines = _lines(t).withColumn("l_quantity", F.when(F.col("l_returnflag") != "A", F.col("l_quantity")))
    return op.summarize(lines, KEYS, [Agg("l_quantity", "sum")])


@query("agg_count", _sql("count(discount)", "count_discount"))
def agg_count(t: Tables) -> DataFrame:
    return op.summarize(_lines(t), KEYS, [Agg("discount", "count")])


@query("agg_count_distinct", _sql("count(DISTINCT discount) + max(CAST(discount IS NULL AS INTEGER))", "kinds"))
def agg_count_distinct(t: Tables) -> DataFrame:
    return op.summarize(_lines(t), KEYS, [Agg("discount", "count_distinct", "kinds")])


@query("agg_min", _sql("min(discount)", "min_discount"))
def agg_min(t: Tables) -> DataFrame:
    return op.summarize(_lines(t), KEYS, [Agg("discount", "min")])


@query("agg_max", _sql("max(l_extendedprice)", "max_l_extendedprice"))
def agg_max(t: Tables) -> DataFrame:
    return op.summarize(_lines(t), KEYS, [Agg("l_extendedprice", "max")])


@query("agg_mean", _sql("avg(line)", "mean_line"))
def agg_mean(t: Tables) -> DataFrame:
    return op.summarize(_lines(t), KEYS, [Agg("line", "mean")])


@query("agg_median", _sql("round(median(l_extendedprice), 4)", "median_l_extendedprice"))
def agg_median(t: Tables) -> DataFrame:
    out = op.summarize(_lines(t), KEYS, [Agg("l_extendedprice", "median")])
    return out.withColumn("median_l_extendedprice", F.round("median_l_extendedprice", 4))


@query("agg_std", _sql("round(stddev_samp(l_quantity), 6)", "std_l_quantity"))
def agg_std(t: Tables) -> DataFrame:
    out = op.summarize(_lines(t), KEYS, [Agg("l_quantity", "std")])
    return out.withColumn("std_l_quantity", F.round("std_l_quantity", 6))


_EVENTS = "(SELECT *, nullif(user_id % 3, 0) AS part FROM events)"


def _events(t: Tables) -> DataFrame:
    return t.events.withColumn("part", F.expr("nullif(user_id % 3, 0)"))


@query("agg_first", f"SELECT event_type, first(part ORDER BY ts, event_id) AS first_part FROM {_EVENTS} GROUP BY ALL")
def agg_first(t: Tables) -> DataFrame:
    return op.summarize(_events(t), ["event_type"], [Agg("part", "first")], order_by=["ts", "event_id"])


@query("agg_last", f"SELECT event_type, last(part ORDER BY ts, event_id) AS last_part FROM {_EVENTS} GROUP BY ALL")
def agg_last(t: Tables) -> DataFrame:
    return op.summarize(_events(t), ["event_type"], [Agg("part", "last")], order_by=["ts", "event_id"])


@query("agg_global", """
SELECT sum(l_quantity) AS quantity, count(l_orderkey) AS "lines", count(DISTINCT l_orderkey) AS orders,
       max(l_extendedprice) AS top_price, median(l_quantity) AS middle
FROM lineitem""")
def agg_global(t: Tables) -> DataFrame:
    return op.summarize(t.lineitem, [], [
        Agg("l_quantity", "sum", "quantity"), Agg("l_orderkey", "count", "lines"),
        Agg("l_orderkey", "count_distinct", "orders"), Agg("l_extendedprice", "max", "top_price"),
        Agg("l_quantity", "median", "middle"),
    ])


@query("agg_distinct_keys", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def agg_distinct_keys(t: Tables) -> DataFrame:
    return op.summarize(t.lineitem, ["l_suppkey", "l_returnflag"])
