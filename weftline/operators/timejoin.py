"""Joins on order instead of equality: latest earlier row, and interval containment."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.blend import Pairs, key_pairs, reduce_by, renamed_side
from weftline.operators.windows import HOT_ROWS, hot_keys, split_hot_keys
from weftline.types import fields_of, not_null


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Pairs | str,
    left_time: str,
    right_time: str,
    how: str = "inner",
    strict: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time.

    `strict` asks for an earlier time; `how="left"` keeps rows without a match.
    Right rows of equal key and time count as one: the largest by all columns.

    Ordinary keys: both sides are ordered together, in one shuffle.  With a key of
    more than `hot_rows` rows only distinct (key, time) pairs are ordered, the hot
    key cut into time ranges; the full left rows then travel to an equality join,
    which AQE can split.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    pairs = key_pairs(on)
    l, lnames = renamed_side(left, "l")
    r, rnames = renamed_side(right, "r")
    keys = [f"k{i}" for i in range(len(pairs))]
    l_keys = [F.col(lnames[a]).alias(k) for (a, _), k in zip(pairs, keys)]
    r_keys = [F.col(rnames[b]).alias(k) for (_, b), k in zip(pairs, keys)]
    asking = l.select("*", *l_keys, F.col(lnames[left_time]).alias("t"))
    known = not_null(r.select(*r_keys, F.col(rnames[right_time]).alias("t"), F.struct("*").alias("row")), [*keys, "t"])

    hot = hot_keys(not_null(asking.select(*keys), keys).unionByName(known.select(*keys)), keys, hot_rows)
    if hot is None:
        found = _latest_in_one_pass(asking, known, keys, strict)
        matched = found if how == "left" else found.where("row IS NOT NULL")
        if how == "left":
            # Rows without key or time match nothing: keep them out of the ordering.
            empty = " OR ".join(f"{c} IS NULL" for c in [*keys, "t"])
            rest = asking.where(empty).withColumn("row", F.lit(None).cast(known.schema["row"].dataType))
            matched = matched.unionByName(rest)
    else:
        latest = _latest_by_ranges(asking, known, keys, strict, hot, hot_rows)
        same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"m{c}") for c in [*keys, "t"]])
        matched = asking.join(latest, same, how)
    right_keys = {b for _, b in pairs}
    out = [F.col(n).alias(c) for c, n in lnames.items()]
    out += [
        F.col("row")[n].alias(f"{c}_right" if c in lnames else c)
        for c, n in rnames.items() if c not in right_keys
    ]
    return matched.select(*out)


def _latest_in_one_pass(asking: DataFrame, known: DataFrame, keys: list[str], strict: bool) -> DataFrame:
    """Left rows with key and time, and the latest right row as `row`."""
    # A right row at the same time goes first when it may match, last when not.
    offers = known.withColumn("side", F.lit(2 if strict else 0))
    both = not_null(asking, [*keys, "t"]).withColumn("side", F.lit(1)).unionByName(offers, allowMissingColumns=True)
    upto = Window.partitionBy(*keys).orderBy("t", "side", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("row", F.last("row", ignorenulls=True).over(upto)).where("side = 1").drop("side")


def _latest_by_ranges(
    asking: DataFrame, known: DataFrame, keys: list[str], strict: bool, hot: DataFrame, hot_rows: int
) -> DataFrame:
    """The latest right row per distinct left key and time, as mk0, ..., mt, row."""
    asked = not_null(asking.select(*keys, "t"), [*keys, "t"]).distinct()
    offers = reduce_by(known, [*keys, "t"], F.max("row").alias("row"))
    marks = asked.select(*keys, "t", F.lit(1).alias("side"), F.lit(None).cast(fields_of(offers)["t"]).alias("rt"))
    marks = marks.unionByName(offers.select(*keys, "t", F.lit(2 if strict else 0).alias("side"), F.col("t").alias("rt")))
    marks, part = split_hot_keys(marks, keys, [("t", False)], hot_rows, hot)
    by = [*keys, part]
    # The latest right time of all earlier ranges opens each range.
    latest = marks.groupBy(*by).agg(F.max("rt").alias("rt"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    opening = latest.select(
        *by, F.lit(None).cast(fields_of(marks)["t"]).alias("t"), F.lit(-1).alias("side"), F.max("rt").over(before).alias("rt")
    )
    upto = Window.partitionBy(*by).orderBy(F.col("t").asc_nulls_first(), "side").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    matched = marks.unionByName(opening).withColumn("match", F.max("rt").over(upto)).where("side = 1 AND match IS NOT NULL")
    matched = matched.select(*[F.col(k).alias(f"m{k}") for k in keys], F.col("t").alias("mt"), "match")
    to_offer = reduce(lambda a, b: a & b, [F.col(f"m{k}") == F.col(k) for k in keys], F.col("match") == F.col("t"))
    return matched.join(offers, to_offer).select(*[f"m{k}" for k in keys], "mt", "row")


#: The widest bins of an interval join hold 2 ** LAST_LEVEL of the narrowest; four of them cover all bin numbers.
LAST_LEVEL = 62


def range_join(
    left: DataFrame,
    right: DataFrame,
    point: str,
    low: str,
    high: str,
    bin_width: float,
    closed: bool = False,
    on: Sequence["str | tuple[str, str]"] = (),
) -> DataFrame:
    """Left rows paired with the right intervals that hold their point.

    low <= point < high, or <= high when `closed`.  Points and intervals meet in
    bins, so this is an equality join, never all pairs.  Bins have `bin_width` or
    a power of two times it: an interval goes to the narrowest bins of which four at
    most cover it, whatever its length, and a point to one bin of every width
    in use (found in a pass over the intervals).  Choose the width near the usual
    interval length.  Rows with a null point, low or high join with nothing;
    infinite ends are allowed.
    """
    l, lnames = renamed_side(left, "l")
    r, rnames = renamed_side(right, "r")
    point_col, low_col, high_col = F.col(lnames[point]), F.col(rnames[low]), F.col(rnames[high])

    def bin_number(col: Column) -> Column:
        return F.floor(col / F.lit(bin_width))

    def shifted(col: Column, level: Column) -> Column:
        return F.call_function("shiftright", col, level)

    first, last = bin_number(low_col), bin_number(high_col)
    steps = F.try_subtract(last, first)
    level = F.when(steps.isNull(), F.lit(LAST_LEVEL)).when(steps < 2, F.lit(0)).otherwise(F.least(F.length(F.bin(steps - 1)), F.lit(LAST_LEVEL)))
    r = r.where(low_col <= high_col).withColumn("level", level.cast("int"))
    in_use = r.agg(F.collect_set("level").alias("levels"))
    r = r.withColumn("rbin", F.explode(F.sequence(shifted(first, F.col("level")), shifted(last, F.col("level")))))
    l = l.where(point_col.isNotNull()).crossJoin(F.broadcast(in_use)).withColumn("llevel", F.explode("levels")).drop("levels")
    l = l.withColumn("lbin", shifted(bin_number(point_col), F.col("llevel")))
    cond = (F.col("lbin") == F.col("rbin")) & (F.col("llevel") == F.col("level")) & (low_col <= point_col)
    cond = cond & ((point_col <= high_col) if closed else (point_col < high_col))
    if on:
        for a, b in key_pairs(on):
            cond = cond & (F.col(lnames[a]) == F.col(rnames[b]))
    out = [F.col(n).alias(c) for c, n in lnames.items()]
    out += [F.col(n).alias(f"{c}_right" if c in lnames else c) for c, n in rnames.items()]
    return l.join(r, cond, "inner").select(*out)

