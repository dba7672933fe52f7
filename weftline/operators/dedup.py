"""First occurrences and the rest."""
from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ordering import OrderBy, order_struct, repeat_rows, require_order, sort_columns
from weftline.operators.windows import HOT_ROWS, hot_keys, same_keys
from weftline.types import fresh_name, name_ref


class UniqueSplit(NamedTuple):
    unique: DataFrame
    duplicates: DataFrame


def unique_split(
    df: DataFrame, fields: Sequence[str] = (), order_by: OrderBy | str | None = None, hot_rows: int = HOT_ROWS
) -> UniqueSplit:
    """First row per key in `unique`, every other row in `duplicates`.

    No fields means all of them.  Nulls equal each other.  Ties of `order_by`
    are broken by the remaining columns, so equal ranks are equal rows.
    """
    return UniqueSplit(unique_rows(df, fields, order_by), duplicate_rows(df, fields, order_by, hot_rows))


def unique_rows(df: DataFrame, fields: Sequence[str] = (), order_by: OrderBy | str | None = None) -> DataFrame:
    """First row per key.

    Spark keeps only the first row per key of each task before the shuffle, so
    a hot key sends one row per task.
    """
    if not fields:
        return df.distinct()
    place = fresh_name("place", df.columns)
    return df.withColumn(place, _place(df, fields, order_by)).where(name_ref(place) == 1).drop(place)


def duplicate_rows(
    df: DataFrame, fields: Sequence[str] = (), order_by: OrderBy | str | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """All rows but the first per key.

    Keys with at most `hot_rows` rows are ranked in one shuffle.  The rows of a
    hotter key never meet: each is compared with the key's first row, which is
    broadcast, and only copies of that first row are counted.
    """
    columns = [name_ref(c) for c in df.columns]
    if not fields:
        return _spare_copies(df)
    place = fresh_name("place", df.columns)
    rank = _place(df, fields, order_by)

    def later(rows: DataFrame) -> DataFrame:
        return rows.withColumn(place, rank).where(name_ref(place) > 1).drop(place)

    hot = hot_keys(df, fields, hot_rows)
    if hot is None:
        return later(df)
    # Internal names from here on, so that none can meet a column of the caller's.
    names = {c: f"u{i}" for i, c in enumerate(df.columns)}
    spare = _hot_duplicates(
        df.select(*[name_ref(c).alias(n) for c, n in names.items()]), [names[f] for f in fields],
        [(names[n], "desc" if d else "asc") for n, d in require_order(order_by, "unique on some of the fields")], hot,
    )
    return spare.select(*[F.col(n).alias(c) for c, n in names.items()])


def _hot_duplicates(df: DataFrame, fields: Sequence[str], order_by: OrderBy, hot: DataFrame) -> DataFrame:
    columns = [name_ref(c) for c in df.columns]
    place = fresh_name("place", df.columns)
    rank = _place(df, fields, order_by)

    def later(rows: DataFrame) -> DataFrame:
        return rows.withColumn(place, rank).where(name_ref(place) > 1).drop(place)

    table = F.broadcast(hot.drop("rows"))
    cold = df.join(table, same_keys(fields), "left_anti")
    heavy = df.join(table, same_keys(fields), "left_semi")
    items = require_order(order_by, "unique on some of the fields")
    ranked = F.struct(order_struct(df, items).alias("o"), F.struct(*columns).alias("row"))
    first = fresh_name("first", df.columns)
    # One row per hot key, combined before the shuffle.  A row may be wide, so AQE decides by its size
    # whether to broadcast; if not, it splits the hot partitions of the join.
    heads = heavy.groupBy(*[name_ref(f).alias(f"hot{i}") for i, f in enumerate(fields)]).agg(
        F.min(ranked)["row"].alias(first)
    )
    paired = heavy.join(heads, same_keys(fields))
    is_head = F.struct(*columns).eqNullSafe(name_ref(first))
    others = paired.where(~is_head).select(*columns)
    return later(cold).unionByName(others).unionByName(_spare_copies(paired.where(is_head).select(*columns)))


def _place(df: DataFrame, fields: Sequence[str], order_by: OrderBy | str | None) -> Column:
    items = require_order(order_by, "unique on some of the fields")
    named = {n for n, _ in items}
    tied = items + [(c, False) for c in df.columns if c not in named and c not in fields]
    return F.row_number().over(Window.partitionBy(*[name_ref(f) for f in fields]).orderBy(*sort_columns(tied)))


def _spare_copies(df: DataFrame) -> DataFrame:
    """Of every n equal rows, n - 1."""
    copies = fresh_name("copies", df.columns)
    counted = df.groupBy(*[name_ref(c) for c in df.columns]).agg((F.count(F.lit(1)) - 1).alias(copies))
    return repeat_rows(counted, copies)
