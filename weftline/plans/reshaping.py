"""Cross tabs, unpivot and transpose."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import operators as op
from weftline.plans.registry import Tables, query

STATES = ("F", "O", "P")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _orders(t: Tables) -> DataFrame:
    """Orders with whole cents, null for one customer in seven."""
    return t.orders.select(
        "o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderdate",
        F.expr("CASE WHEN o_custkey % 7 > 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END").alias("cents"),
    )


def _sql(cell: str) -> str:
    cells = ", ".join(f'{cell.format(c=f"FILTER (WHERE o_orderstatus = {s!r})")} AS "{s}"' for s in STATES)
    return f"""
SELECT o_orderpriority, {cells}
FROM (SELECT *, CASE WHEN o_custkey % 7 > 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS cents FROM orders)
GROUP BY ALL"""


def _tab(t: Tables, aggregation: str, **options) -> DataFrame:
    return op.crosstab(_orders(t), ["o_orderpriority"], "o_orderstatus", "cents", aggregation, **options)


@query("crosstab_sum", _sql("CAST(sum(cents) {c} AS BIGINT)"))
def crosstab_sum(t: Tables) -> DataFrame:
    return _tab(t, "sum")


@query("crosstab_mean", _sql("avg(cents) {c}"))
def crosstab_mean(t: Tables) -> DataFrame:
    return _tab(t, "mean")


@query("crosstab_min", _sql("min(cents) {c}"))
def crosstab_min(t: Tables) -> DataFrame:
    return _tab(t, "min", values=STATES)


@query("crosstab_max", _sql("max(cents) {c}"))
def crosstab_max(t: Tables) -> DataFrame:
    return _tab(t, "max", values=STATES)


@query("crosstab_count", _sql("nullif(count(*) {c}, 0)"))
def crosstab_count(t: Tables) -> DataFrame:
    return _tab(t, "count")


@query("crosstab_first", _sql("first(cents ORDER BY o_orderdate, o_orderkey) {c}"))
def crosstab_first(t: Tables) -> DataFrame:
    return _tab(t, "first", order_by=["o_orderdate", "o_orderkey"])


@query("crosstab_last", _sql("last(cents ORDER BY o_orderdate, o_orderkey) {c}"))
def crosstab_last(t: Tables) -> DataFrame:
    return _tab(t, "last", order_by=["o_orderdate", "o_orderkey"])


@query("unpivot", """
SELECT l_orderkey, l_linenumber, 'discount' AS measure, nullif(l_discount, 0) AS amount FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""")
def unpivot(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumn("discount", F.expr("nullif(l_discount, 0)"))
    return op.unpivot(lines, ["l_orderkey", "l_linenumber"], ["discount", "l_tax"], "measure", "amount")


def _segments(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("customers"), F.max("c_custkey").alias("newest"), F.countDistinct("c_nationkey").alias("nations")
    )


_SEGMENT_SQL = """
WITH s AS (SELECT c_mktsegment, count(*) AS customers, max(c_custkey) AS newest, count(DISTINCT c_nationkey) AS nations
           FROM customer GROUP BY ALL)"""


def _transpose_sql(rows: dict[str, str], names: tuple[str, ...]) -> str:
    parts = []
    for row, cell in rows.items():
        cells = ", ".join(f"max(CASE WHEN c_mktsegment = '{s}' THEN {cell} END) AS \"{n}\"" for s, n in zip(SEGMENTS, names))
        parts.append(f"SELECT '{row}' AS \"column\", {cells} FROM s")
    return _SEGMENT_SQL + " UNION ALL ".join(parts)


_MEASURES = ("customers", "newest", "nations")


@query("transpose_header", _transpose_sql({m: m for m in _MEASURES}, SEGMENTS))
def transpose_header(t: Tables) -> DataFrame:
    return op.transpose(_segments(t), "c_mktsegment")


@query("transpose_plain", _transpose_sql(
    {m: f"CAST({m} AS VARCHAR)" for m in ("c_mktsegment", *_MEASURES)}, tuple(f"column_{i}" for i in range(5))
))
def transpose_plain(t: Tables) -> DataFrame:
    """No header column: the mixed types become text."""
    return op.transpose(_segments(t), order_by=["c_mktsegment"])
