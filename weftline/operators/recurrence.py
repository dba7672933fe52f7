"""Formulas over rows that use the row's own previous result, as a parallel scan.

Each row is a step that turns the previous result into its own: y -> a * y + b
(affine), y -> max(y + a, b) or y -> min(y + a, b).  Steps of one kind compose into
one step of that kind.  So a partition key with many rows is cut into order ranges:
each range composes its steps, a small pass hands every range the result before it,
and the ranges then run side by side.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.ordering import OrderBy, require_order, sort_columns
from weftline.operators.windows import HOT_ROWS, hot_keys, split_hot_keys
from weftline.types import name_ref

Number = float | int | None
#: A step: (constant, a, b); a constant step forgets the previous result and gives b, which may be null.
Step = tuple[bool, Number, Number]


@dataclass(frozen=True)
class Kind:
    apply: Callable
    compose: Callable


KINDS = {
    "affine": Kind(lambda a, b, y: a * y + b, lambda a, b, c, d: (c * a, c * b + d)),
    "max_plus": Kind(lambda a, b, y: max(y + a, b), lambda a, b, c, d: (a + c, max(b + c, d))),
    "min_plus": Kind(lambda a, b, y: min(y + a, b), lambda a, b, c, d: (a + c, min(b + c, d))),
}


def _run(kind: Kind, step: Step, y: Number) -> Number:
    constant, a, b = step
    if constant:
        return b
    return None if y is None else kind.apply(a, b, y)


def _then(kind: Kind, first: Step, second: Step) -> Step:
    """The two steps as one."""
    if second[0]:
        return second
    if first[0]:
        return True, None, _run(kind, second, first[2])
    return False, *kind.compose(first[1], first[2], second[1], second[2])


def _steps(columns: list[list], kind: Kind, start: Number) -> Iterator[Step]:
    for a, b, reset in zip(*columns):
        if a is None or b is None:
            yield True, None, None
        elif reset:
            yield True, None, None if start is None else kind.apply(a, b, start)
        else:
            yield False, a, b


def recurrence(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: OrderBy,
    name: str,
    a: str,
    b: str,
    kind: str = "affine",
    start: Number = 0,
    reset: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the column `name`: each row's step applied to the result of the row before it.

    `a` and `b` are columns; the first row of a partition, and rows where the boolean
    column `reset` is true, apply theirs to `start`.  A null in `a` or `b` makes the result null, and null stays so
    until a reset.  Integers are computed as bigint, anything else as double.  Rows
    that are equal in `order_by` follow each other in the order of all columns.
    Null partition keys are one partition.  An empty table gives an empty result.

    In ranges of a hot key the result before a range comes from composed steps; of
    doubles it may differ in the last bits from adding up row by row.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    if name in df.columns:
        raise ValueError(f"column {name!r} exists already")
    items = require_order(order_by, "a recurrence")
    whole = all(isinstance(df.schema[c].dataType, T.IntegralType) for c in (a, b)) and isinstance(start, (int, type(None)))
    number = "bigint" if whole else "double"
    renamed = {c: f"u{i}" for i, c in enumerate(df.columns)}
    rows = df.select(
        *(name_ref(c).alias(n) for c, n in renamed.items()), name_ref(a).cast(number).alias("a"), name_ref(b).cast(number).alias("b"),
        (F.coalesce(name_ref(reset).cast("boolean"), F.lit(False)) if reset else F.lit(False)).alias("reset"))
    keys = [renamed[k] for k in partition_by]
    named = {n for n, _ in items}
    order = [(renamed[n], d) for n, d in items] + [(renamed[f.name], False) for f in df.schema.fields if f.name not in named and _sortable(f.dataType)]
    hot = hot_keys(rows, keys, hot_rows)
    begin = F.lit(start).cast(number)
    if hot is None:
        tagged, part = rows, None
        placed = rows.withColumn("order_range", F.lit(0)).withColumn("before", begin)
    else:
        tagged, part = split_hot_keys(rows, keys, order, hot_rows, hot)
        placed = _with_start(tagged.withColumnRenamed(part, "order_range"), keys, order, kind, start, number)
    key = F.struct(*keys, "order_range")
    sent = placed.select(*renamed.values(), key.alias("key"), "a", "b", "reset", "before")
    ready = _sorted(sent, keys, order)
    fields = [f"{n} {df.schema[c].dataType.simpleString()}" for c, n in renamed.items()]
    done = ready.mapInArrow(_results(KINDS[kind], start, len(renamed), number), ", ".join([*fields, f"result {number}"]))
    return done.select(*(F.col(n).alias(c) for c, n in renamed.items()), F.col("result").alias(name))


def _sortable(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType))


def _sorted(rows: DataFrame, keys: list[str], order) -> DataFrame:
    """One partition holds all rows of a key and order range, in order."""
    by = [*(F.col(k) for k in keys), F.col("key.order_range")]
    if not keys:
        by = [F.col("key.order_range")]
    return rows.repartition(*by).sortWithinPartitions(*by, *sort_columns(order))


def _with_start(tagged: DataFrame, keys: list[str], order, kind: str, start: Number, number: str) -> DataFrame:
    """Add `before`: the result that each order range starts from.

    One row per range and key is composed, the rows of a key (a few for every
    `hot_rows` rows) are chained in one task and joined back.
    """
    key = F.struct(*keys, "order_range")
    steps = _sorted(tagged.select(*[c for c in tagged.columns if c != "order_range"], key.alias("key")), keys, order)
    of = T.LongType() if number == "bigint" else T.DoubleType()
    shape = T.StructType([steps.schema["key"], T.StructField("constant", T.BooleanType()), T.StructField("a", of), T.StructField("b", of)])
    composed = steps.mapInArrow(_composed(KINDS[kind], start, number), shape)
    flat = composed.select("key.*", "constant", "a", "b")
    chained = flat.select(F.struct(*(keys or [F.lit(0).alias("all")])).alias("key"), "order_range", "constant", "a", "b")
    ordered = chained.repartition(F.col("key")).sortWithinPartitions("key", "order_range")
    after = T.StructType([chained.schema["key"], chained.schema["order_range"], T.StructField("before", of)])
    begins = ordered.mapInArrow(_chained(KINDS[kind], start, number), after)
    told = begins.select(*(F.col(f"key.{k}").alias(f"of_{k}") for k in keys), F.col("order_range").alias("of_range"), "before")
    same = F.col("order_range") == F.col("of_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return tagged.join(told, same).drop("of_range", *(f"of_{k}" for k in keys))


def _arrow(number: str) -> pa.DataType:
    return pa.int64() if number == "bigint" else pa.float64()


def _groups(batch: pa.RecordBatch) -> tuple[list, list[list]]:
    """Keys and the step columns of a batch."""
    return batch.column("key").to_pylist(), [batch.column(c).to_pylist() for c in ("a", "b", "reset")]


def _results(kind: Kind, start: Number, width: int, number: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, y, fresh = None, None, True
        for batch in batches:
            keys, columns = _groups(batch)
            befores = batch.column("before").to_pylist()
            out = []
            for here, before, step in zip(keys, befores, _steps(columns, kind, start)):
                if fresh or here != key:
                    key, y, fresh = here, before, False
                y = _run(kind, step, y)
                out.append(y)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(out, _arrow(number))], names=[*batch.schema.names[:width], "result"])

    return run


def _composed(kind: Kind, start: Number, number: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, whole, key_type = None, None, None

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([key], key_type), pa.array([whole[0]]), *(pa.array([v], _arrow(number)) for v in whole[1:])], names=["key", "constant", "a", "b"])

        for batch in batches:
            key_type = batch.schema.field("key").type
            keys, columns = _groups(batch)
            for here, step in zip(keys, _steps(columns, kind, start)):
                if whole is not None and here == key:
                    whole = _then(kind, whole, step)
                    continue
                if whole is not None:
                    yield row()
                key, whole = here, step
        if whole is not None:
            yield row()

    return run


def _chained(kind: Kind, start: Number, number: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, y, fresh = None, None, True
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if fresh or row["key"] != key:
                    key, y, fresh = row["key"], start, False
                out.append(y)
                y = _run(kind, (row["constant"], row["a"], row["b"]), y)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("order_range"), pa.array(out, _arrow(number))], names=["key", "order_range", "before"])

    return run
