"""Scalar functions on Columns, with the null and type rules of the formula language.

Arguments are Columns, column names, or (where a constant is expected) plain
Python values.  Everything compiles to built-in Spark expressions.
"""
from weftline.functions.convert import (
    coalesce, is_not_null, is_null, to_int, to_number, to_string,
)
from weftline.functions.dates import day, month, now, today, year
from weftline.functions.logic import case_if, compare
from weftline.functions.numeric import (
    abs_, add, ceil, divide, floor, max_, min_, mod, multiply, negate, pow_, round_, sqrt, subtract,
)
from weftline.functions.text import (
    concat, contains, ends_with, length, lower, replace, starts_with, substring, trim, upper,
)

__all__ = [
    "abs_", "add", "case_if", "ceil", "coalesce", "compare", "concat", "contains", "day", "divide",
    "ends_with", "floor", "is_not_null", "is_null", "length", "lower", "max_", "min_", "mod",
    "month", "multiply", "negate", "now", "pow_", "replace", "round_", "sqrt", "starts_with",
    "substring", "subtract", "to_int", "to_number", "to_string", "today", "trim", "upper", "year",
]
