"""Null tests and conversions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.base import as_col, operand
from weftline.types import as_double


def is_null(x: Column | str) -> Column:
    """NaN is a value, not a null."""
    return as_col(x).isNull()


def is_not_null(x: Column | str) -> Column:
    return as_col(x).isNotNull()


def coalesce(*xs, as_type: str | None = None) -> Column:
    """First non-null; give `as_type` when the arguments differ in type."""
    if not xs:
        raise TypeError("coalesce needs at least one argument")
    cols = [operand(x) for x in xs]
    return F.coalesce(*([c.cast(as_type) for c in cols] if as_type else cols))


def to_string(x: Column | str) -> Column:
    return as_col(x).cast("string")


def to_number(x: Column | str) -> Column:
    """Double, null where the text is no number."""
    return as_double(as_col(x))


def to_int(x: Column | str) -> Column:
    """Bigint, null where the text is no whole number; fractions are cut."""
    return as_col(x).try_cast("bigint")
