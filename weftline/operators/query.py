"""Spark SQL over named input tables."""
from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from weftline.statements import bare_statement

_VIEWS = threading.Lock()


def sql_inputs(query: str, *inputs: DataFrame, **named: DataFrame) -> DataFrame:
    """Run one query over tables called `input1`, `input2`, ... or by keyword name.

    The inputs stay lazy: Catalyst plans them together with the query.  The
    names exist only while the query is analysed; a view of the caller's that
    has such a name is put back afterwards.
    """
    text = bare_statement(query)
    if not text:
        raise ValueError("the query is empty")
    tables = {f"input{i}": df for i, df in enumerate(inputs, 1)} | named
    if not tables:
        raise ValueError("the query has no input tables")
    spark = next(iter(tables.values())).sparkSession
    with _VIEWS:
        own = {v.name for v in spark.catalog.listTables(pattern="|".join(tables)) if v.isTemporary and not v.namespace}
        kept = {n: spark.table(n) for n in tables if n in own}
        try:
            for name, df in tables.items():
                df.createOrReplaceTempView(name)
            return spark.sql(text)
        finally:
            for name in tables:
                if name in kept:
                    kept[name].createOrReplaceTempView(name)
                else:
                    spark.catalog.dropTempView(name)


def sql_schema(query: str, *inputs: DataFrame, **named: DataFrame) -> StructType:
    """Result schema; errors in the query surface here, no data is read."""
    return sql_inputs(query, *inputs, **named).schema
