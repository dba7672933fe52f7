"""Column profiles: counts, bounds, mergeable sketches and histograms of all columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.types import logical_name, name_ref

QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
#: Relative error of the distinct count, accuracy of quantiles (their rank is off by 1 / ACCURACY at most), items a sketch of frequent ones tracks.
DISTINCT_ERROR, ACCURACY, TRACKED = 0.02, 10_000, 10_000
#: Text, JSON and binary values longer than this are profiled by their beginning and a digest, so that sketches stay small.
LONGEST = 256

SCHEMA = ("name string, type string, rows bigint, nulls bigint, null_pct double, distinct bigint, min string, max string, mean double, "
          "quantiles array<double>, frequent array<struct<item: string, count: bigint>>, histogram array<struct<low: double, high: double, count: bigint>>")


def _numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def _value(col: Column, dtype: T.DataType) -> Column:
    """A value that sketches can hold: plain types as they are, others as JSON; long texts as a beginning and a digest."""
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        col, dtype = F.to_json(F.struct(col.alias("v"))), T.StringType()
    if isinstance(dtype, T.VariantType):
        col, dtype = F.to_json(col), T.StringType()
    if isinstance(dtype, T.BinaryType):
        col, dtype = F.hex(col), T.StringType()
    if not isinstance(dtype, (T.NumericType, T.BooleanType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return col.cast("string")
    if isinstance(dtype, T.StringType):
        return F.when(F.length(col) > LONGEST, F.concat(F.left(col, F.lit(LONGEST)), F.lit("…"), F.sha2(col.cast("binary"), 256))).otherwise(col)
    return col


def column_profile(df: DataFrame, bins: int = 10, top: int = 5) -> DataFrame:
    """One row for each column of `df`, in their order, with the columns of SCHEMA.

    rows, nulls, null_pct (0 to 1), min, max (as text) and mean are exact.  distinct is
    a sketch with a relative standard error of DISTINCT_ERROR; quantiles (of numbers, at QUANTILES) are
    values whose rank is right to 1 / ACCURACY; frequent holds the `top` values found most
    often, whose counts are exact while a column has at most TRACKED different values and
    estimates beyond; ties come in no fixed order.  Null is no value.  NaN is left out of
    mean, quantiles and histogram, and is the greatest value.  Texts longer than LONGEST are told apart by a digest.

    histogram counts numbers in `bins` parts of equal width from min to max, the greatest
    in the last; exact.  It needs the bounds, so two jobs read the table: one aggregates
    all sketches of all columns, one all histograms.  Sketches merge, so partial results
    are one row per task.  An empty table has rows 0, null bounds, and empty arrays.
    """
    if not df.columns:
        return df.sparkSession.createDataFrame([], SCHEMA)
    fields = df.schema.fields
    facts = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        col = name_ref(f.name)
        value = _value(col, f.dataType)
        facts += [F.count(col).alias(f"n{i}"), F.approx_count_distinct(value, DISTINCT_ERROR).alias(f"d{i}"), F.call_function("approx_top_k", value, F.lit(top + 1), F.lit(max(TRACKED, top + 1))).alias(f"t{i}"),
                  F.min(value).cast("string").alias(f"lo{i}"), F.max(value).cast("string").alias(f"hi{i}")]
        if _numeric(f.dataType):
            number = _real(col, f.dataType)
            facts += [F.avg(number).cast("double").alias(f"m{i}"), F.percentile_approx(number.cast("double"), list(QUANTILES), ACCURACY).alias(f"q{i}"),
                      F.min(number).cast("double").alias(f"low{i}"), F.max(number).cast("double").alias(f"high{i}")]
    # One row, whatever the table's size: bounds, sketches' results and `top` values of each column.
    [found] = df.agg(*facts).collect()
    bounded = [i for i, f in enumerate(fields) if _numeric(f.dataType) and found[f"low{i}"] is not None]
    parts = _histograms(df, [(i, fields[i].name, fields[i].dataType, found[f"low{i}"], found[f"high{i}"]) for i in bounded], bins)
    rows = []
    for i, f in enumerate(fields):
        total, filled = found["rows"], found[f"n{i}"]
        numeric = _numeric(f.dataType)
        # Null may be among the items.
        frequent = [(_shown(e["item"]), e["count"]) for e in found[f"t{i}"] or [] if e["item"] is not None][:top]
        rows.append((f.name, logical_name(f.dataType), total, total - filled, (total - filled) / total if total else None, found[f"d{i}"], found[f"lo{i}"], found[f"hi{i}"],
                     found[f"m{i}"] if numeric else None, found[f"q{i}"] if numeric else None, frequent, parts.get(i, [])))
    return df.sparkSession.createDataFrame(rows, SCHEMA).coalesce(1)


def _real(col: Column, dtype: T.DataType) -> Column:
    return F.when(~F.isnan(col), col) if isinstance(dtype, (T.FloatType, T.DoubleType)) else col


def _shown(item) -> str:
    return str(item).lower() if isinstance(item, bool) else str(item)


def _histograms(df: DataFrame, columns: list[tuple], bins: int) -> dict[int, list[tuple]]:
    """(low, high, count) of each column's parts; infinities stand in the first and last part."""
    counts, edges = [], {}
    for i, name, dtype, low, high in columns:
        finite = float("-inf") < low and high < float("inf") and high - low < float("inf")
        n = bins if finite and high > low else 1
        width = (high - low) / n if n > 1 else 0.0
        edges[i] = [(low + width * j, high if j == n - 1 else low + width * (j + 1)) for j in range(n)]
        number = _real(name_ref(name), dtype).cast("double")
        place = F.when(number.isNotNull(), F.least(F.floor((number - F.lit(low)) / F.lit(width)), F.lit(n - 1)) if n > 1 else F.lit(0))
        counts += [F.count_if(place == j).alias(f"c{i}_{j}") for j in range(n)]
    if not counts:
        return {}
    [found] = df.agg(*counts).collect()
    return {i: [(*e, found[f"c{i}_{j}"]) for j, e in enumerate(parts)] for i, parts in edges.items()}
