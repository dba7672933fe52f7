"""Date parts and the query's own clock."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.base import as_col


def now() -> Column:
    """Zone-free time of the query, the same on every row."""
    return F.current_timestamp().cast("timestamp_ntz")


def today() -> Column:
    return F.current_date()


def year(x: Column | str) -> Column:
    return F.year(as_col(x))


def month(x: Column | str) -> Column:
    return F.month(as_col(x))


def day(x: Column | str) -> Column:
    return F.dayofmonth(as_col(x))
