"""Grouped and global aggregation."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.ordering import (
    OrderBy, even_bounds, order_struct, require_order,
)
from weftline.operators.windows import hot_keys, same_keys
from weftline.types import fields_of, fresh_name, name_ref

FUNCS = ("sum", "count", "count_distinct", "min", "max", "mean", "median", "std", "first", "last")

MEDIAN_RANGES = 1_024
MEDIAN_HOT_ROWS = 1_000_000


@dataclass(frozen=True)
class Agg:
    """One aggregate; the output name defaults to `{func}_{field}`."""

    field: str
    func: str = "sum"
    output: str = ""

    def __post_init__(self):
        if self.func not in FUNCS:
            raise ValueError(f"unknown aggregate {self.func!r}")

    @property
    def name(self) -> str:
        return self.output or f"{self.func}_{self.field}"


def aggregate_column(df: DataFrame, field: str, func: str, order_by: OrderBy | None = None) -> Column:
    """The Spark aggregate for one function, with the null and NaN rules fixed."""
    dtype = fields_of(df)[field]
    col = name_ref(field)
    if func == "sum":
        # All-null and empty groups sum to zero.
        return F.coalesce(F.sum(col.cast("int") if isinstance(dtype, T.BooleanType) else col), F.lit(0))
    if func == "count":
        return F.count(col)
    if func == "count_distinct":
        # Null counts as one more value.
        return F.count_distinct(col) + F.coalesce(F.max(col.isNull().cast("int")), F.lit(0))
    if func in ("min", "max"):
        pick = F.min if func == "min" else F.max
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            # NaN is skipped unless there is nothing else.
            nan = F.max(F.when(F.isnan(col), col))
            return F.coalesce(pick(F.when(~F.isnan(col), col)), nan)
        return pick(col)
    if func in ("mean", "median") and isinstance(dtype, T.BooleanType):
        col = col.cast("int")
    if func == "mean":
        return F.avg(col)
    if func == "median":
        return F.median(col).cast("double")
    if func == "std":
        return F.stddev_samp(col)
    if func in ("first", "last"):
        rank = order_struct(df, require_order(order_by, func))
        pick = F.min if func == "first" else F.max
        # The struct keeps a null value; ties go to the smallest / largest value.
        return pick(F.struct(rank.alias("o"), col.alias("v"))).getField("v")
    raise ValueError(f"unknown aggregate {func!r}")


def summarize(
    df: DataFrame,
    group_by: Sequence[str] = (),
    aggs: Sequence[Agg] = (),
    order_by: OrderBy | None = None,
    hot_rows: int = MEDIAN_HOT_ROWS,
) -> DataFrame:
    """Group and aggregate.

    No aggregates: the distinct keys, or the table itself without keys.
    No keys: one row.  Null keys form one group.

    Spark's median holds the distinct values of a group in memory, so one job
    counts the groups first, and those above `hot_rows` take `exact_median`.
    """
    aggs = [a for a in aggs if a.field]
    keys = [name_ref(k) for k in group_by]
    if not aggs:
        return df.select(*keys).distinct() if keys else df
    hot = hot_keys(df, group_by, hot_rows) if any(a.func == "median" for a in aggs) else None

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[aggregate_column(df, a.field, a.func, order_by).alias(a.name) for a in aggs])

    if hot is None:
        return grouped(df)
    if not keys:
        return _with_medians(df, group_by, aggs, order_by)
    table = F.broadcast(hot.drop("rows"))
    heavy = df.join(table, same_keys(group_by), "left_semi")
    light = df.join(table, same_keys(group_by), "left_anti")
    return grouped(light).unionByName(_with_medians(heavy, group_by, aggs, order_by))


def _with_medians(df: DataFrame, group_by: Sequence[str], aggs: Sequence[Agg], order_by: OrderBy | None) -> DataFrame:
    """All aggregates of hot groups: the medians apart, joined by key."""
    keys = [name_ref(k) for k in group_by]
    plain = [aggregate_column(df, a.field, a.func, order_by).alias(a.name) for a in aggs if a.func != "median"]
    # The count also keeps groups whose values are all null.
    out = df.groupBy(*keys).agg(*plain, F.count(F.lit(1)).alias(fresh_name("rows", df.columns)))
    for a in aggs:
        if a.func == "median":
            out = _join_on_keys(out, exact_median(df, group_by, a.field, a.name), group_by)
    return out.select(*keys, *[name_ref(a.name) for a in aggs])


def _join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not keys:
        # Both sides are one row.
        return left.join(right, F.lit(True))
    renamed = {k: fresh_name(f"{k}_r", left.columns, right.columns) for k in keys}
    right = right.withColumnsRenamed(renamed)
    cond = reduce(lambda a, b: a & b, [name_ref(k).eqNullSafe(name_ref(r)) for k, r in renamed.items()])
    return left.join(right, cond, "left").drop(*renamed.values())


def exact_median(df: DataFrame, group_by: Sequence[str], field: str, output: str, ranges: int = MEDIAN_RANGES) -> DataFrame:
    """Exact median per group without holding a group in one place.

    Equal values are counted together first.  The value range is cut into
    `ranges` parts; per group the part holding the middle follows from at most
    that many partial counts, and only the rows of that part are ranked.
    Groups without any value are left out (no keys: one null row).
    """
    keys = [f"g{i}" for i in range(len(group_by))]
    values = df.select(
        *[name_ref(g).alias(k) for g, k in zip(group_by, keys)], (name_ref(field).cast("int") if isinstance(fields_of(df)[field], T.BooleanType) else name_ref(field)).alias("v")
    ).where(F.col("v").isNotNull())
    histogram = values.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    bounds = even_bounds(values, F.col("v"), ranges)
    parted = histogram.withColumn("part", F.coalesce(bounds.bucket_of(F.col("v")), F.lit(0)))

    in_group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    cells = parted.groupBy(*keys, "part").agg(F.sum("n").alias("cell"))
    ranked = cells.select(
        *keys, "part",
        (F.sum("cell").over(in_group.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cell")).alias("before"),
        F.col("cell"),
        F.sum("cell").over(in_group).alias("total"),
    )
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)

    def holds(rank: Column, start: Column, size: Column) -> Column:
        return (start <= rank) & (rank < start + size)

    middle = ranked.where(
        holds(low, F.col("before"), F.col("cell")) | holds(high, F.col("before"), F.col("cell"))
    ).drop("cell")
    renamed = middle.withColumnsRenamed({k: f"m{k}" for k in keys}).withColumnRenamed("part", "mpart")
    cond = F.col("part") == F.col("mpart")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"m{k}"))
    near = parted.join(renamed, cond).select(*keys, "part", "v", "n", "before", "total")
    in_part = Window.partitionBy(*keys, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = near.withColumn("start", F.col("before") + F.sum("n").over(in_part) - F.col("n"))
    picked = placed.groupBy(*keys).agg(
        # As doubles, since the sum of two large integers would overflow.
        ((F.max(F.when(holds(low, F.col("start"), F.col("n")), F.col("v"))).cast("double")
          + F.max(F.when(holds(high, F.col("start"), F.col("n")), F.col("v"))).cast("double")) / 2).alias("median")
    )
    return picked.select(*[F.col(k).alias(g) for g, k in zip(group_by, keys)], F.col("median").alias(output))
