"""Unreadable cells: made null, their rows dropped, or an error; the rejected rows with reasons beside."""
from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftline.functions.text import trim
from weftline.sources.text_table import cell_as, check_names
from weftline.types import name_ref

POLICIES = ("null", "drop", "error")


class Checked(NamedTuple):
    """`good`: the typed rows; `rejected`: the text rows with an unreadable cell and `reasons`; `seen`: counts, filled by the job that writes `good`."""

    good: DataFrame
    rejected: DataFrame
    seen: Observation


def checked_text(df: DataFrame, types: Mapping[str, str], policy: str = "null") -> Checked:
    """The listed text columns read as logical types, and what could not be read.

    A cell is bad if it is not blank but has no value of its type; blank cells and nulls are
    null and never bad.

    null: `good` holds every row, bad cells are null.  drop: rows with a bad cell are not in `good`.
    error: the job that reads `good` fails at a row with a bad cell and names the cells.
    `rejected` is the same under each policy: those rows as they came, all columns, with
    `reasons`, an array<struct<column, type, value>> in the order of `types`.

    `seen.get` waits for the job over `good` and gives `rows`, `bad_rows` and `bad_cells`; they are
    counted in that job, before rows are dropped, without a pass of their own.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    if "reasons" in df.columns:
        raise ValueError("column 'reasons' exists already")
    kinds = {n: t or "string" for n, t in types.items()}
    check_names(list(kinds))
    # Row, values and reasons side by side, under internal names.
    read = df.select(F.struct(*[name_ref(c) for c in df.columns]).alias("row"), *[cell_as(name_ref(n), t).alias(f"v{i}") for i, (n, t) in enumerate(kinds.items())])
    reasons = []
    for i, (n, t) in enumerate(kinds.items()):
        cell = F.col("row").getField(n).cast("string")
        bad = F.col(f"v{i}").isNull() & (trim(cell) != "")
        reasons.append(F.when(bad, F.struct(F.lit(n).alias("column"), F.lit(t).alias("type"), cell.alias("value"))))
    read = read.withColumn("reasons", F.array_compact(F.array(*reasons)))
    is_bad = F.size("reasons") > 0
    rejected = read.where(is_bad).select("row.*", "reasons")
    seen = Observation()
    counts = [F.count("*").alias("rows"), F.count_if(is_bad).alias("bad_rows"), F.coalesce(F.sum(F.size("reasons")), F.lit(0)).alias("bad_cells")]
    good = read.observe(seen, *counts)
    if policy == "drop":
        good = good.where(~is_bad)
    elif policy == "error":
        told = F.array_join(F.transform("reasons", lambda r: F.format_string("%s is no %s: %s", r["column"], r["type"], r["value"])), "; ")
        good = good.where(F.when(is_bad, F.raise_error(told).cast("boolean")).otherwise(True))
    return Checked(good.select(*[F.col(f"v{i}").alias(n.strip()) for i, n in enumerate(kinds)]), rejected, seen)
