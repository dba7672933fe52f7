"""User code on tables, batches and groups."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from weftline.types import fresh_name, name_ref

STATE_ROWS = 100_000
# Whole numbers and truth values stay exact beside nulls.
NULLABLE = {
    pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(), pa.bool_(): pd.BooleanDtype(),
}


def python_frames(fn: Callable[..., object], *inputs: DataFrame | None) -> tuple[DataFrame, ...]:
    """Call `fn` with the tables; it returns one DataFrame or several.

    A missing result (None) becomes an empty table without columns.
    """
    out = fn(*inputs)
    results = out if isinstance(out, (tuple, list)) else (out,)
    for r in results:
        if r is not None and not isinstance(r, DataFrame):
            raise ValueError(f"the code returned a {type(r).__name__} where a DataFrame belongs")
    known = [d for d in (*results, *inputs) if d is not None]
    if not known:
        raise ValueError("no table to work with")
    empty = known[0].sparkSession.createDataFrame([], StructType())
    return tuple(r if r is not None else empty for r in results)


def python_batches(df: DataFrame, fn: Callable, schema, arrow: bool = False) -> DataFrame:
    """Apply `fn` to each Arrow batch, as a pandas frame or (`arrow`) a RecordBatch."""

    def run(batches: Iterator):
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(run, schema) if arrow else df.mapInPandas(run, schema)


def python_groups(
    df: DataFrame, keys: Sequence[str], fn: Callable, schema, max_group_rows: int | None = None, many: bool = False
) -> DataFrame:
    """Apply `fn` to each whole group as one pandas frame, or (`many`) to frames of many whole groups.

    The code sees all rows of a group at once, so a group has to fit one worker.
    With `max_group_rows` a counting job first raises if a group is larger.  Use
    `python_aggregate` for groups of any size.  Rows with null keys are groups too.

    A call takes milliseconds whatever the size of its group.  With `many` there is one
    call per Arrow batch: the frame holds the groups that end in it, each whole and its
    rows together, and `fn` returns the rows of them all.  Integers and booleans then
    come in pandas' nullable types, since one group's nulls must not change another's values.
    """
    by = [name_ref(k) for k in keys]
    largest = max_group_rows is not None and df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if max_group_rows is not None and largest > max_group_rows:
        raise ValueError(f"a group has {largest} rows, more than {max_group_rows}: use python_aggregate")
    return _many_groups(df, by, fn, schema) if many else df.groupBy(*by).applyInPandas(fn, schema)


def _many_groups(df: DataFrame, by: list[Column], fn: Callable, schema) -> DataFrame:
    out = to_arrow_schema(schema if isinstance(schema, StructType) else StructType.fromDDL(schema))
    first = fresh_name("first", df.columns)

    def called(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        if rows.num_rows:
            yield pa.RecordBatch.from_pandas(fn(rows.to_pandas(types_mapper=NULLABLE.get)), out, preserve_index=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last group of a batch may go on in the next one.
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column(first).to_numpy(zero_copy_only=False))
            rows = batch.drop_columns([first])
            if len(starts):
                yield from called([*held, rows.slice(0, starts[-1])])
                held, rows = [], rows.slice(starts[-1])
            held.append(rows)
        if held:
            yield from called(held)

    # The window brings each group's rows together and marks its first one.
    window = Window.partitionBy(*by).orderBy(F.lit(0))
    return df.withColumn(first, F.row_number().over(window) == 1).mapInArrow(run, schema)


def python_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    merge: Callable[[pd.DataFrame], pd.DataFrame],
    finish: Callable[[pd.DataFrame], pd.DataFrame],
    partial_schema,
    schema,
    state_rows: int = STATE_ROWS,
) -> DataFrame:
    """Aggregate with user code, combining inside each task before the shuffle.

    `partial` turns a batch into partial rows, `merge` combines partial rows to
    one per key, `finish` turns merged rows into results; each gets rows of
    many keys at once.  A task sends at most one row per key and flush, so a hot
    key costs its final task one row per task instead of all its rows.
    """
    keys = list(keys)

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            if len(batch):
                held.append(partial(batch))
                size += len(held[-1])
            if size > state_rows:
                merged = merge(pd.concat(held, ignore_index=True))
                held, size = [merged], len(merged)
                if size > state_rows // 2:
                    yield merged
                    held, size = [], 0
        if held:
            yield merge(pd.concat(held, ignore_index=True))

    def conclude(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by key: only the last key of a batch may go on.
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            last = rows[keys].iloc[-1]
            open_key = (rows[keys].eq(last) | (rows[keys].isna() & last.isna())).all(axis=1)
            if not open_key.all():
                yield finish(merge(rows[~open_key]))
            held = merge(rows[open_key])
        if held is not None:
            yield finish(merge(held))

    by = [name_ref(k) for k in keys]
    partials = df.mapInPandas(combine, partial_schema)
    return partials.repartition(*by).sortWithinPartitions(*by).mapInPandas(conclude, schema)
