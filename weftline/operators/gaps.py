"""Filling of time series: rows for the steps that are missing between two rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.ordering import CHUNK_OF_COPIES
from weftline.operators.windows import HOT_ROWS, Win, ordered_window
from weftline.types import name_ref

_MICROS = {"microsecond": 1, "millisecond": 10**3, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6, "week": 7 * 86400 * 10**6}
_EPOCH = "1970-01-01"


def _step(step: int | tuple[int, str], dtype: T.DataType) -> int:
    """Length of a step in the units of `_number`."""
    n, unit = (step, None) if isinstance(step, int) else step
    if n < 1:
        raise ValueError("a step goes forward")
    if isinstance(dtype, T.IntegralType):
        if unit is not None:
            raise ValueError("steps of a number have no unit")
        return n
    micros = n * _MICROS[unit]
    if isinstance(dtype, T.DateType):
        if micros % _MICROS["day"]:
            raise ValueError("steps of a date are whole days")
        return micros // _MICROS["day"]
    return micros


def _number(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.IntegralType):
        return col.cast("bigint")
    if isinstance(dtype, T.DateType):
        return F.unix_date(col).cast("bigint")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), col)
    raise TypeError(f"no time series over {dtype.simpleString()}")


def _moved(col: Column, by: Column, dtype: T.DataType) -> Column:
    """The time `by` units later."""
    if isinstance(dtype, T.IntegralType):
        return (col + by).cast(dtype)
    if isinstance(dtype, T.DateType):
        return F.date_add(col, by.cast("int"))
    return F.timestamp_add("MICROSECOND", by, col)


def ts_fill(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    step: int | tuple[int, str],
    carried: Sequence[str] = (),
    filled: str | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The rows, and one more for every step that is missing between a row and the next one of its keys.

    New rows stand at the row's time plus one step, two steps, ... as long as that is before
    the next row's time.  `step` is a number, or like (1, "hour") for dates and times (units
    up to the week).  Their other columns are null, but for the keys and the `carried`
    columns, which hold the last value known at that time (given rows keep theirs, and get
    it where they are null).  `filled` names a boolean column that is true for new rows.

    Rows without a time come out as they are.  Rows of equal time are ordered by all
    their columns.  Null keys are a series.  A gap is cut into chunks before it is unrolled, so a long one
    is made by many tasks; keys of more than `hot_rows` rows are cut into time ranges.
    """
    dtype = df.schema[time].dataType
    size = _step(step, dtype)
    if filled in df.columns:
        raise ValueError(f"column {filled!r} exists already")
    names = {c: f"u{i}" for i, c in enumerate(df.columns)}
    own = df.select(*(name_ref(c).alias(n) for c, n in names.items()))
    clock, by = names[time], [names[k] for k in keys]
    order = [clock, *(names[f.name] for f in df.schema.fields if f.name != time and not isinstance(f.dataType, (T.MapType, T.VariantType)))]
    told = own.where(F.col(clock).isNotNull()).withColumn("at", _number(F.col(clock), dtype))
    windows = {"following": Win("lead", "at")}
    for c in carried:
        # The latest of the values so far is the greatest of (time, rank in the order, value): ranks only matter between equal times.
        known = F.col(names[c]).isNotNull()
        told = told.withColumn(f"v_{names[c]}", F.when(known, F.struct("at", *(F.col(o) for o in order[1:]), F.col(names[c]).alias("value"))))
        windows[f"last_{names[c]}"] = Win("max", f"v_{names[c]}")
    series = ordered_window(told, by, order, windows, hot_rows)
    for c in carried:
        series = series.withColumn(names[c], F.coalesce(F.col(names[c]), F.col(f"last_{names[c]}")["value"]))

    missing = F.floor((F.col("following") - F.col("at") - 1) / F.lit(size)).cast("bigint")
    gaps = series.withColumn("missing", missing).where("missing > 0")
    chunk, length = F.col("chunk"), F.lit(CHUNK_OF_COPIES).cast("bigint")
    chunks = gaps.select(*by, clock, *(names[c] for c in carried if names[c] not in by), "missing",
                         F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("missing") - 1) / length))).alias("chunk"))
    spread = chunks.repartition(chunk, *by, F.col(clock))
    steps = F.sequence(chunk * length + 1, F.least((chunk + 1) * length, F.col("missing")))
    new = spread.select(*by, *(names[c] for c in carried if names[c] not in by), F.col(clock).alias("start"), F.explode(steps).alias("k"))
    kept = {*by, *(names[c] for c in carried)}
    made = new.select(*(
        _moved(F.col("start"), F.col("k") * size, dtype).alias(c) if c == clock
        else F.col(c) if c in kept else F.lit(None).cast(own.schema[c].dataType).alias(c) for c in names.values()))
    parts = [series.select(*names.values()), own.where(F.col(clock).isNull())]
    given = parts[0].unionByName(parts[1])
    if filled:
        given, made = given.withColumn("is_new", F.lit(False)), made.withColumn("is_new", F.lit(True))
    out = given.unionByName(made)
    return out.select(*(F.col(n).alias(c) for c, n in names.items()), *([F.col("is_new").alias(filled)] if filled else []))
