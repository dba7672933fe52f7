"""CSV, Parquet and JSON files: folders or globs on any storage Spark can reach."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.types import TEXT_TIMES, name_ref

# What counts as a number or boolean when a CSV column type is guessed.
_INT = r"^[+-]?\d{1,19}$"
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^(NaN|inf|-inf)$"
_BOOL = r"^(true|false)$"


# Spark would take a quoted empty cell for null as well if the mark for null were the empty text.
NO_CELL = "\x00"


def _all_match(name: str, pattern: str) -> Column:
    """True when every filled cell fits; false when no cell is filled."""
    return F.coalesce(F.bool_and(name_ref(name).rlike(pattern)), F.lit(False))


def _guess_types(sample: DataFrame) -> list[T.DataType]:
    checks = []
    for c in sample.columns:
        fits = _all_match(c, _INT) & F.coalesce(F.bool_and(name_ref(c).try_cast("bigint").isNotNull() | name_ref(c).isNull()), F.lit(False))
        checks.append(F.array(fits, *[_all_match(c, p) for p in (_FLOAT, _BOOL)]).alias(c))
    found = sample.agg(*checks).first()
    order = (T.LongType(), T.DoubleType(), T.BooleanType())
    return [next((t for t, ok in zip(order, flags) if ok), T.StringType()) for flags in found]


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    has_header: bool = True,
    delimiter: str = ",",
    schema: T.StructType | str | None = None,
    mode: str = "FAILFAST",
    multiline: bool | None = None,
) -> DataFrame:
    """CSV with typed columns.

    Without a `schema`, one aggregate job over all rows finds the types: whole
    numbers that fit 64 bits, numbers, true / false, else text; dates stay text.  A
    value that does not fit a given schema fails the job (`mode="PERMISSIVE"` makes
    it null).  An empty cell is null, a quoted empty one is the empty text.

    `multiline` allows line breaks inside quotes at the price of unsplittable
    files; None looks for a line with an odd number of quotes first, which costs a
    pass over the text.
    """
    if multiline is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multiline = bool(spark.read.text(path).where(quotes % 2 == 1).limit(1).count())
    options = dict(header=has_header, sep=delimiter, quote='"', escape='"', multiLine=multiline, nullValue=NO_CELL, emptyValue="")
    if schema is None:
        raw = spark.read.csv(path, **options)
        names = raw.columns if has_header else [f"column_{i + 1}" for i in range(len(raw.columns))]
        types = _guess_types(raw.toDF(*names))
        schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types)])
    return spark.read.csv(path, schema=schema, mode=mode, nanValue="NaN", positiveInf="inf", negativeInf="-inf", **options)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(
    spark: SparkSession,
    path: str,
    lines: bool = False,
    schema: T.StructType | str | None = None,
    sampling_ratio: float | None = None,
) -> DataFrame:
    """A JSON array document, or one object per line with `lines`.

    An array document cannot be split: one file is one task.  Give a `schema` or
    a `sampling_ratio` to avoid a full pass for the types.
    """
    return spark.read.json(path, multiLine=not lines, schema=schema, samplingRatio=sampling_ratio)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", write_header: bool = True) -> DataFrame:
    """Write a folder of CSV files, replacing what is there; returns the input."""
    options = dict(quote='"', escape='"', nullValue="", emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df.write.mode("overwrite").options(**TEXT_TIMES).csv(path, sep=delimiter, header=write_header, **options)
    return df


def write_parquet(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df


def write_ndjson(df: DataFrame, path: str) -> DataFrame:
    """One JSON object per line; null fields are written too."""
    df.write.mode("overwrite").options(**TEXT_TIMES).json(path, ignoreNullFields=False)
    return df
