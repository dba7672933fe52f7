"""Branches and comparisons."""
from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.base import operand
from weftline.types import as_double

_COMPARE = {
    "==": operator.eq, "=": operator.eq, "!=": operator.ne, "<>": operator.ne,
    "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge,
}


def compare(left, op: str, right, numeric: bool = False) -> Column:
    """Comparison that is null when a side is null.

    `numeric=True` reads both sides as numbers first, null where a text is none,
    instead of failing the job on the first such row.
    """
    a, b = operand(left), operand(right)
    if numeric:
        a, b = as_double(a), as_double(b)
    return _COMPARE[op](a, b)


def case_if(*branches: tuple[Column, object], otherwise=None) -> Column:
    """IF / ELSEIF / ELSE: a null condition moves on, no `otherwise` gives null."""
    if not branches:
        raise TypeError("case_if needs at least one (condition, result) pair")

    def value(v):
        return v if isinstance(v, Column) else F.lit(v)

    condition, result = branches[0]
    out = F.when(condition, value(result))
    for condition, result in branches[1:]:
        out = out.when(condition, value(result))
    return out.otherwise(value(otherwise))
