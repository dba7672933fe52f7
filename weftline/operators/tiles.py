"""Tiles: rows numbered 1 to n by equal count, equal sum or equal width."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.ordering import OrderBy, require_order
from weftline.operators.windows import HOT_ROWS, Win, ordered_window
from weftline.types import fresh_name, name_ref

#: Digits behind the point that doubles are rounded to for sums, which are exact from there on.
SUM_SCALE = 6


def tile(
    df: DataFrame,
    n: int,
    name: str,
    method: str = "count",
    field: str | None = None,
    order_by: OrderBy | None = None,
    partition_by: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the int column `name`: the tile of each row, from 1 to n.

    count: as equal numbers of rows as can be, in `order_by`, the first tiles one larger.
    sum: tiles of equal sums of `field` in `order_by`: a row is in the tile in which the
    sum of all rows before it falls.  Null and negative values count as 0; if all sum
    to 0 there is one tile.  Sums are exact decimals (doubles are rounded to SUM_SCALE digits first).
    width: parts of equal width between the least and the greatest value of `field`; the greatest
    is in tile n.  Null and NaN are in no tile; if all values are equal there is one.

    Rows that are equal in `order_by` are ordered by all their columns, so only equal rows are exchangeable.
    Whole tables, and partitions of more than `hot_rows` rows, are cut into
    order ranges, whose counts and sums are added up in one small table.
    """
    if n < 1:
        raise ValueError("a table has at least one tile")
    if name in df.columns:
        raise ValueError(f"column {name!r} exists already")
    if method == "width":
        return _by_width(df, n, name, field, partition_by)
    items = require_order(order_by, "a tile")
    named = {c for c, _ in items}
    order = [(c, "desc" if d else "asc") for c, d in items] + [f.name for f in df.schema.fields if f.name not in named and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    if method == "count":
        return ordered_window(df, partition_by, order, {name: Win("ntile", n=n)}, hot_rows)
    if method != "sum":
        raise ValueError(f"unknown method {method!r}")
    weight, upto, total = (fresh_name(c, df.columns, [name]) for c in ("weight", "upto", "total"))
    rows = df.withColumn(weight, _exact(df, field))
    summed = ordered_window(rows, partition_by, order, {upto: Win("sum", weight)}, hot_rows)
    joined = _with_facts(summed, partition_by, {total: F.sum(name_ref(weight))})
    # `div` of decimals is exact, a quotient would be rounded.
    part = F.expr(f"((`{upto}` - `{weight}`) * {n}) div `{total}`")
    number = F.when(name_ref(total) > 0, F.least(part + 1, F.lit(n))).otherwise(1)
    return joined.select(*(name_ref(c) for c in df.columns), number.cast("int").alias(name))


def _exact(df: DataFrame, field: str | None) -> Column:
    if field is None:
        raise ValueError("tiles of equal sums need a field")
    value = name_ref(field)
    if isinstance(df.schema[field].dataType, (T.FloatType, T.DoubleType)):
        value = F.when(~F.isnan(value), value)
    return F.greatest(F.coalesce(value.try_cast(f"decimal(28,{SUM_SCALE})"), F.lit(0).cast(f"decimal(28,{SUM_SCALE})")), F.lit(0).cast(f"decimal(28,{SUM_SCALE})"))


def _with_facts(df: DataFrame, partition_by: Sequence[str], facts: dict[str, Column]) -> DataFrame:
    """Add aggregates of each row's partition; of the whole table they are one row."""
    named = [fact.alias(c) for c, fact in facts.items()]
    if not partition_by:
        return df.join(F.broadcast(df.agg(*named)), F.lit(True))
    keys = {k: fresh_name(f"of_{i}", df.columns, list(facts)) for i, k in enumerate(partition_by)}
    told = df.groupBy(*(name_ref(k).alias(c) for k, c in keys.items())).agg(*named)
    same = F.lit(True)
    for k, c in keys.items():
        same = same & name_ref(k).eqNullSafe(name_ref(c))
    return df.join(told, same, "left").drop(*keys.values())


def _by_width(df: DataFrame, n: int, name: str, field: str | None, partition_by: Sequence[str]) -> DataFrame:
    if field is None:
        raise ValueError("tiles of equal width need a field")
    low, high = (fresh_name(c, df.columns, [name]) for c in ("low", "high"))
    value = name_ref(field).cast("double")
    value = F.when(~F.isnan(value), value)
    joined = _with_facts(df, partition_by, {low: F.min(value), high: F.max(value)})
    width = name_ref(high) - name_ref(low)
    part = F.floor((value - name_ref(low)) * n / F.nullif(width, F.lit(0.0)))
    number = F.when(value.isNotNull(), F.when(width > 0, F.least(part + 1, F.lit(n))).otherwise(1))
    return joined.select(*(name_ref(c) for c in df.columns), number.cast("int").alias(name))
