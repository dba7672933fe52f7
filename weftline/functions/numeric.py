"""Arithmetic and numeric functions.

Functions whose result type follows the input type ask Spark for it with
`typeof`-free casts only where the caller passes `like=`, since a Column has no
type of its own.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.base import as_col, operand


def add(a, b, text: bool = False) -> Column:
    """Sum; with `text` the two joined as text, null when either is."""
    return F.concat(operand(a).cast("string"), operand(b).cast("string")) if text else operand(a) + operand(b)


def subtract(a, b) -> Column:
    return operand(a) - operand(b)


def multiply(a, b) -> Column:
    return operand(a) * operand(b)


def divide(a, b) -> Column:
    """True division: x / 0 is +-infinity, 0 / 0 is NaN, null stays null."""
    top, bottom = operand(a).cast("double"), operand(b).cast("double")
    at_zero = (
        F.when((top == 0) | F.isnan(top), F.lit(float("nan")))
        .when(top > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    )
    return (
        F.when(top.isNull() | bottom.isNull(), F.lit(None).cast("double"))
        .when(bottom == 0, at_zero)
        .otherwise(F.try_divide(top, bottom))
    )


def mod(a, b) -> Column:
    """Remainder with the sign of the divisor; null for a zero divisor."""
    top, bottom = operand(a), operand(b)
    safe = F.nullif(bottom, F.lit(0))
    rest = top % safe
    return F.when((rest != 0) & ((rest < 0) != (safe < 0)), rest + safe).otherwise(rest)


def negate(a) -> Column:
    return -operand(a)


def abs_(x: Column | str) -> Column:
    return F.abs(as_col(x))


def round_(x: Column | str, decimals: int = 0, half_even: bool = False) -> Column:
    """Half away from zero; `half_even=True` for banker's rounding."""
    return F.bround(as_col(x), decimals) if half_even else F.round(as_col(x), decimals)


def floor(x: Column | str, like: T.DataType | str | None = None) -> Column:
    """Floor; bigint, null where it cannot hold the value.  `like` names the input type to cast back to."""
    return _whole(F.floor, as_col(x), like)


def ceil(x: Column | str, like: T.DataType | str | None = None) -> Column:
    """Ceiling, with the types of `floor`."""
    return _whole(F.ceil, as_col(x), like)


def _whole(step, x: Column, like: T.DataType | str | None) -> Column:
    wide = x.cast("double")
    if like in ("double", "float", T.DoubleType(), T.FloatType()):
        # NaN, infinities and numbers without a fractional part in this type are their own floor.
        return F.when(F.isnan(wide) | (F.abs(wide) >= float(2**53)), x).otherwise(step(x).cast(like))
    out = F.when(~(F.isnan(wide) | (F.abs(wide) > float(2**63))), step(x))
    return out if like is None else out.cast(like)


def pow_(a, b, like: T.DataType | str | None = None) -> Column:
    """Power as double.  A whole type in `like` multiplies exactly, null where the product overflows."""
    if like in ("bigint", "int", T.LongType(), T.IntegerType()):
        base, times = operand(a).cast("bigint"), operand(b).cast("int")
        # Beyond 1 a product leaves bigint before the 64th power; up to 1 only the exponent's parity matters.
        small = F.when(base.between(-1, 1), times % 2 + F.when(times >= 2, 2).otherwise(0)).otherwise(F.least(times, F.lit(64)))
        steps = F.sequence(F.lit(1), F.greatest(small, F.lit(1)))
        exact = F.aggregate(steps, F.lit(1).cast("bigint"), lambda acc, _: F.try_multiply(acc, base))
        exact = F.when(times == 0, F.lit(1).cast("bigint")).otherwise(exact)
        return F.when(times >= 0, exact).otherwise(F.pow(operand(a), operand(b)).try_cast("bigint")).try_cast(like)
    out = F.pow(operand(a), operand(b))
    return out if like is None else out.cast(like)


def sqrt(x: Column | str) -> Column:
    """NaN for negative numbers."""
    return F.sqrt(as_col(x))


def min_(*xs) -> Column:
    """Smallest across columns, skipping nulls."""
    cols = [operand(x) for x in xs]
    if not cols:
        raise TypeError("min_ needs at least one argument")
    return cols[0] if len(cols) == 1 else F.least(*cols)


def max_(*xs) -> Column:
    """Largest across columns, skipping nulls."""
    cols = [operand(x) for x in xs]
    if not cols:
        raise TypeError("max_ needs at least one argument")
    return cols[0] if len(cols) == 1 else F.greatest(*cols)
