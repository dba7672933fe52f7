"""Argument handling shared by the function modules."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.types import name_ref


def as_col(value: Column | str) -> Column:
    """A Column as it is; a string names a column."""
    return name_ref(value) if isinstance(value, str) else value


def operand(value) -> Column:
    """A Column, a column name, or a plain number / boolean / None literal."""
    return value if isinstance(value, Column) else name_ref(value) if isinstance(value, str) else F.lit(value)


def as_text(value: Column | str) -> Column:
    return as_col(value).cast("string")
