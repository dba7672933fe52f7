"""Parquet folders partitioned by column values (`column=value/`)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.types import name_ref

#: Rows of one partition value that one task writes, and so about the rows of a file.
ROWS_PER_FILE = 5_000_000


def read_partitioned(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A partitioned folder; partition columns come last.

    Filters on partition columns skip folders when planned, joins on them skip folders at run time
    (once the other side's keys are known).  Types of partition columns are guessed from the folder
    names unless `schema` names them.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite", rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Write a folder partitioned by `by`; returns the input.

    overwrite: replaces the whole folder.  replace: replaces the partitions that `df` has rows of, others
    stay.  append: adds files.  Nulls and empty texts share one partition, read back as null.

    Rows are dealt out by partition value before they are written, so that a value does not get a file from
    every task; values of more than `rows_per_file` rows are dealt to several tasks.
    """
    if mode not in ("overwrite", "replace", "append"):
        raise ValueError(f"unknown mode {mode!r}")
    if not by or len(by) >= len(df.columns):
        raise ValueError("a partitioned folder needs partition columns and others")
    # A salt from the row itself, so that a repeated task deals its rows out alike.
    keyed = [name_ref(c) for c in by]
    most = df.groupBy(*keyed).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    salts = max(1, -(-most // rows_per_file))
    hashed = [name_ref(f.name) for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    dealt = df.repartition(*keyed, *([F.pmod(F.xxhash64(*hashed), F.lit(salts))] if salts > 1 else []))
    writer = dealt.write.partitionBy(*by).mode("append" if mode == "append" else "overwrite")
    writer.option("partitionOverwriteMode", "dynamic" if mode == "replace" else "static").parquet(path)
    return df
