"""Long to wide, wide to long, and transposing."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.aggregate import aggregate_column
from weftline.operators.ordering import OrderBy, require_order, sort_columns
from weftline.types import align, common_type, fields_of, fresh_name, name_ref, typed

CROSSTAB_FUNCS = ("sum", "mean", "min", "max", "first", "last", "count")


def _width_limit(df: DataFrame, most: int | None) -> int:
    return most if most is not None else int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))


def header_values(df: DataFrame, header: str, most_columns: int | None = None) -> list[str | None]:
    """Sorted distinct values that become columns; more than `most_columns` are an error (default: Spark's pivot limit)."""
    limit = _width_limit(df, most_columns)
    found = df.select(name_ref(header).cast("string")).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{header!r} has more than {limit} values: too wide for a table")
    return sorted((r[0] for r in found), key=lambda v: (v is not None, v))


def crosstab(
    df: DataFrame,
    group_by: Sequence[str],
    header: str,
    value: str,
    aggregation: str = "sum",
    values: Sequence[str | None] | None = None,
    order_by: OrderBy | None = None,
    most_columns: int | None = None,
) -> DataFrame:
    """Rows to columns: one column per header value, one row per key.

    Give `values` to fix the columns and save the job that finds them; with them
    there is no limit.  A null header is the column `null`, or `null_` and so on
    where that is a value as well.
    """
    missing = [what for what, given in (("group_by", group_by), ("header", header), ("value", value)) if not given]
    if missing:
        raise ValueError(f"crosstab got no {' and no '.join(missing)}")
    if aggregation not in CROSSTAB_FUNCS:
        raise ValueError(f"unknown aggregation {aggregation!r}")
    if values is None:
        values = header_values(df, header, most_columns)
    head, cell = fresh_name("header", df.columns), fresh_name("cell", df.columns)
    keys = [name_ref(k) for k in group_by]
    # `count` counts rows, so null values too.
    agg = F.count(F.lit(1)) if aggregation == "count" else aggregate_column(df, value, aggregation, order_by)
    for_null = "null"
    while for_null in values:
        for_null += "_"
    cells = df.groupBy(*keys, F.coalesce(name_ref(header).cast("string"), F.lit(for_null)).alias(head)).agg(agg.alias(cell))
    return cells.groupBy(*keys).pivot(head, [for_null if v is None else v for v in values]).agg(F.first(cell))


def unpivot(
    df: DataFrame,
    id_fields: Sequence[str],
    value_fields: Sequence[str],
    name_column: str = "name",
    value_column: str = "value",
) -> DataFrame:
    """Columns to rows; unknown names are ignored, nulls kept, mixed types become text."""
    types = fields_of(df)
    value_fields = [f for f in value_fields if f in types]
    if not value_fields:
        return df
    id_fields = [f for f in id_fields if f in types]
    shared = common_type([types[f] for f in value_fields])
    # A field may be both kept and unpivoted, so the kept ones get names of their own.
    kept = {f: fresh_name(f"kept_{i}", df.columns, [name_column, value_column]) for i, f in enumerate(id_fields)}
    wide = df.select(
        *[name_ref(f).alias(k) for f, k in kept.items()],
        *[typed(name_ref(f), types[f], shared).alias(f) for f in value_fields],
    )
    long = wide.unpivot(list(kept.values()), [name_ref(f) for f in value_fields], name_column or "name", value_column or "value")
    return long.withColumnsRenamed({k: f for f, k in kept.items()})


def transpose(
    df: DataFrame,
    header_column: str = "",
    include_names: bool = True,
    names_to: str = "column",
    order_by: OrderBy | None = None,
    most_columns: int | None = None,
) -> DataFrame:
    """Rows become columns and columns rows, for small (aggregated) tables.

    The result has one column per input row, named by `header_column` or
    `column_0`, `column_1`, ... in `order_by`.  More than `most_columns` rows are an
    error (default: Spark's pivot limit).
    """
    limit = _width_limit(df, most_columns)
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows: too wide to transpose")
    names_to = names_to or "column"
    head = fresh_name("head", df.columns)
    if header_column and header_column in df.columns:
        body = [c for c in df.columns if c != header_column]
        tagged = df.withColumn(head, name_ref(header_column).cast("string"))
        order = sort_columns(require_order(order_by, "transpose")) if order_by else [name_ref(head)]
        names = [r[0] for r in tagged.orderBy(*order).select(head).collect()]
        if len(set(names)) != len(names):
            raise ValueError(f"{header_column!r} holds a value twice: column names must be unique")
    else:
        body = df.columns
        position = F.row_number().over(Window.orderBy(*sort_columns(require_order(order_by, "transpose"))))
        tagged = df.withColumn(head, F.concat(F.lit("column_"), (position - 1).cast("string")))
        names = [f"column_{i}" for i in range(df.count())]
    name, value = fresh_name(names_to, [head]), fresh_name("value", [head, names_to])
    types = fields_of(df)
    shared = common_type([types[c] for c in body])
    long = unpivot(align(tagged, {c: shared for c in body}), [head], body, name, value)
    out = long.groupBy(name_ref(name)).pivot(head, names).agg(F.first(value))
    out = out.withColumnRenamed(name, names_to)
    return out if include_names else out.drop(names_to)
