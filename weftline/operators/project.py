"""Choosing, retyping, computing and filtering columns and rows."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.types import lenient_cast, name_ref


@dataclass(frozen=True)
class Field:
    """One output column of `select_fields`."""

    source: str
    rename: str = ""
    type: str = ""
    include: bool = True


class FilterSplit(NamedTuple):
    true: DataFrame
    false: DataFrame


def as_expression(value: Column | str) -> Column:
    """A Column, or Spark SQL expression text."""
    return F.expr(value) if isinstance(value, str) else value


def select_fields(df: DataFrame, fields: Sequence[Field | str]) -> DataFrame:
    """Keep the listed fields in list order, renamed and retyped; no field keeps all."""
    chosen = []
    for field in fields:
        item = Field(field) if isinstance(field, str) else field
        if not item.include or not item.source:
            continue
        col = name_ref(item.source)
        if item.type:
            col = lenient_cast(col, item.type)
        chosen.append(col.alias(item.rename or item.source))
    return df.select(*chosen) if chosen else df


def formula(df: DataFrame, formulas: Mapping[str, "Column | str | tuple[Column | str, str]"]) -> DataFrame:
    """Add or replace columns; every formula sees the input row, not its siblings.

    A value is a Column, Spark SQL text, or a pair with the wanted logical type.
    """
    out = {}
    for name, spec in formulas.items():
        value, logical = spec if isinstance(spec, tuple) else (spec, "")
        if not name or (isinstance(value, str) and not value.strip()):
            continue
        col = as_expression(value)
        out[name] = lenient_cast(col, logical) if logical else col
    return df.withColumns(out) if out else df


def filter_split(df: DataFrame, predicate: Column | str) -> FilterSplit:
    """Rows where the predicate holds, and rows where it does not.

    A row whose predicate is null is in neither.
    """
    if isinstance(predicate, str) and not predicate.strip():
        raise ValueError("no filter expression")
    test = as_expression(predicate)
    return FilterSplit(df.where(test), df.where(~test))
