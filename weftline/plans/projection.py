"""Projection and filter."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import operators as op
from weftline.operators import Field
from weftline.plans.registry import Tables, query


@query("select_fields", """
SELECT o_orderdate AS ordered, o_orderkey AS id, CAST(trunc(o_totalprice) AS INTEGER) AS price,
       TRY_CAST(o_orderstatus AS DOUBLE) AS status
FROM orders""")
def select_fields(t: Tables) -> DataFrame:
    return op.select_fields(t.orders, [
        Field("o_orderdate", "ordered"), Field("o_orderkey", "id"), Field("o_totalprice", "price", "int32"),
        Field("o_orderstatus", "status", "float64"), Field("o_orderpriority", include=False),
    ])


@query("formula", """
SELECT p_partkey, p_name, p_brand, p_type, p_size + 1 AS p_size, p_retailprice,
       p_size * 2 AS double_size, upper(p_name) AS shout, TRY_CAST(p_brand AS BIGINT) AS brand_number
FROM part""")
def formulas(t: Tables) -> DataFrame:
    return op.formula(t.part, {
        "p_size": F.col("p_size") + 1,
        "double_size": "p_size * 2",
        "shout": "upper(p_name)",
        "brand_number": ("p_brand", "int64"),
    })


_FILTER_SQL = "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE {}(nullif(l_discount, 0) > 0.05)"


@query("filter_true", _FILTER_SQL.format(""))
def filter_true(t: Tables) -> DataFrame:
    return _split(t).true


@query("filter_false", _FILTER_SQL.format("NOT "))
def filter_false(t: Tables) -> DataFrame:
    return _split(t).false


def _split(t: Tables) -> op.FilterSplit:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return op.filter_split(lines, "nullif(l_discount, 0) > 0.05")
