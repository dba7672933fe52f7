"""Reading and writing files, and typing text."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import sources as src
from weftline.plans.registry import Tables, query

PART_SQL = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"
CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"
LINEITEM_SQL = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
       l_tax, l_returnflag, l_linestatus, l_shipdate
FROM lineitem"""


@query("src_parquet", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 25")
def parquet_scan(t: Tables) -> DataFrame:
    lines = src.read_parquet(t.spark, t.path("lineitem"))
    return lines.where("l_quantity > 25").select("l_orderkey", "l_quantity")


@query("src_csv", """
SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice,
  p_partkey + 1234567890123456789 AS wide,
  CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'a' || chr(10) || '"b"' WHEN 3 THEN ' x ' ELSE '7' END AS odd,
  CASE WHEN p_partkey % 150 = 149 THEN 'late' ELSE '1' END AS late
FROM part""")
def csv_scan(t: Tables) -> DataFrame:
    """Written without a header, read back with guessed types and our own names."""
    path = t.scratch("src_csv")
    rest = F.col("p_size") % 5
    odd = F.when(rest == 1, "").when(rest == 2, 'a\n"b"').when(rest == 3, " x ").when(rest == 4, "7")
    late = F.when(F.col("p_partkey") % 150 == 149, "late").otherwise("1")
    part = t.part.withColumns({"wide": F.col("p_partkey") + F.lit(1234567890123456789), "odd": odd, "late": late})
    src.write_csv(part, path, delimiter="|", write_header=False)
    return src.read_csv(t.spark, path, has_header=False, delimiter="|").toDF(*part.columns)


@query("src_json", CUSTOMER_SQL)
def json_scan(t: Tables) -> DataFrame:
    """Array documents of one Arrow batch of customers each."""
    path = t.scratch("src_json")
    customers = t.customer

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(batches):
            yield pd.DataFrame({"chunk": [f"{part}-{k}"], "value": ["[" + ",".join(batch["row"]) + "]"]})

    rows = customers.select(F.to_json(F.struct("*")).alias("row"))
    documents = rows.mapInPandas(arrays, "chunk string, value string")
    documents.write.mode("overwrite").partitionBy("chunk").text(path)
    return src.read_json(t.spark, path, schema=customers.schema).drop("chunk")


@query("src_arrow", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F'")
def arrow_scan(t: Tables) -> DataFrame:
    path = t.scratch("src_arrow")
    src.write_arrow(t.orders, path)
    orders = src.read_arrow(t.spark, path, columns=["o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus"])
    return orders.where("o_orderstatus = 'F'").drop("o_orderstatus")


@query("sink_csv", LINEITEM_SQL)
def csv_sink(t: Tables) -> DataFrame:
    path = t.scratch("sink_csv")
    lines = src.write_csv(t.lineitem, path)
    return src.read_csv(t.spark, path, schema=lines.schema)


@query("sink_parquet", ORDERS_SQL)
def parquet_sink(t: Tables) -> DataFrame:
    path = t.scratch("sink_parquet")
    src.write_parquet(t.orders, path)
    return src.read_parquet(t.spark, path)


@query("sink_arrow", LINEITEM_SQL)
def arrow_sink(t: Tables) -> DataFrame:
    path = t.scratch("sink_arrow")
    src.write_arrow(t.lineitem, path)
    return src.read_arrow(t.spark, path)


@query("sink_ndjson", """
SELECT event_id, ts, user_id, event_type, value, nullif(props, '{"k": 0}') AS props FROM events""")
def ndjson_sink(t: Tables) -> DataFrame:
    path = t.scratch("sink_ndjson")
    events = t.events.withColumn("props", F.nullif("props", F.lit('{"k": 0}')))
    src.write_ndjson(events, path)
    return src.read_json(t.spark, path, lines=True, schema=events.schema)


@query("src_typed_text", """
SELECT o_orderkey, o_custkey,
       CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_totalprice END AS price,
       CAST(o_orderdate AS DATE) AS day, o_orderdate AS at,
       CASE o_orderstatus WHEN 'F' THEN false WHEN 'O' THEN true END AS open,
       o_orderpriority AS priority
FROM orders""")
def typed_cells(t: Tables) -> DataFrame:
    cells = t.orders.select(
        F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("o_orderkey"),
        F.col("o_custkey").cast("string").alias("o_custkey"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("day"),
        F.col("o_orderdate").cast("string").alias("at"),
        F.when(F.col("o_orderstatus") == "O", " Yes ").when(F.col("o_orderstatus") == "F", "f").otherwise("?").alias("open"),
        F.col("o_orderpriority").alias("priority"),
    )
    return src.typed_text(cells, {
        "o_orderkey": "int64", "o_custkey": "int64", "price": "float64", "day": "date", "at": "datetime",
        "open": "bool", "priority": "string",
    })


def _shape_sql(column: str, text: str, table: str) -> str:
    return f"""
SELECT '{column}' AS "column", CASE
    WHEN coalesce(bool_or(regexp_matches(v, '^-?0\\d')), false) THEN 'string'
    WHEN coalesce(bool_and(regexp_matches(v, '^-?\\d+$')), false) THEN 'int64'
    WHEN coalesce(bool_and(regexp_matches(v, '^-?(\\d+\\.\\d*|\\.\\d+|\\d+)([eE][+-]?\\d+)?$')), false) THEN 'float64'
    WHEN coalesce(bool_and(regexp_matches(lower(v), '^(true|false|yes|no|t|f|y|n)$')), false) THEN 'bool'
    WHEN coalesce(bool_and(regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')), false) THEN 'date'
    ELSE 'string' END AS "type"
FROM (SELECT nullif(trim({text}), '') AS v FROM {table})"""


_CELLS = {
    "o_custkey": ("CAST(o_custkey AS STRING)", "CAST(o_custkey AS VARCHAR)"),
    "price": ("CAST(o_totalprice AS STRING)", "CAST(o_totalprice AS VARCHAR)"),
    "code": ("lpad(CAST(o_orderkey AS STRING), 9, '0')", "lpad(CAST(o_orderkey AS VARCHAR), 9, '0')"),
    "day": ("CAST(CAST(o_orderdate AS DATE) AS STRING)", "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)"),
    "open": ("CASE WHEN o_orderstatus = 'O' THEN 'Y' ELSE 'no' END", "CASE WHEN o_orderstatus = 'O' THEN 'Y' ELSE 'no' END"),
    "o_orderpriority": ("o_orderpriority", "o_orderpriority"),
}


@query("infer_text_types", " UNION ALL ".join(_shape_sql(c, duck, "orders") for c, (_, duck) in _CELLS.items()))
def guessed_types(t: Tables) -> DataFrame:
    cells = t.orders.select(*[F.expr(spark).alias(c) for c, (spark, _) in _CELLS.items()])
    found = src.infer_text_types(cells)
    return t.spark.createDataFrame(list(found.items()), "`column` string, `type` string")
