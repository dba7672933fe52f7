"""Window functions that stay balanced when one partition key is hot."""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ordering import (
    OrderBy, OrderRanges, order_struct, require_order, sort_columns,
)
from weftline.types import fields_of, fresh_name, name_ref

# A partition key with more rows than this is split into order ranges.
HOT_ROWS = 5_000_000

RANKS = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile")
FRAMED = ("sum", "count", "min", "max")
VALUES = ("lag", "lead", "first", "last", "nth", "sum", "count", "min", "max")


@dataclass(frozen=True)
class Win:
    """One window column: a rank (`n` parts for ntile), or a function of `field`.

    sum, count, min and max run from the partition's first row to the current
    one, or over a moving `frame` of rows such as (-3, 0); first, last and nth
    (the `n`-th row) look at the whole partition; lag and lead step one row.
    """

    func: str
    field: str = ""
    n: int = 1
    frame: tuple[int, int] | None = None

    def __post_init__(self):
        if self.func not in RANKS + VALUES:
            raise ValueError(f"unknown window function {self.func!r}")
        if self.func in VALUES and not self.field:
            raise ValueError(f"{self.func} needs a field")
        if self.frame and (self.func not in FRAMED or self.frame[0] > self.frame[1]):
            raise ValueError(f"no frame {self.frame} for {self.func}")


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame | None:
    """The keys with more than `hot_rows` rows, with their count in `rows`; None if there are none.

    They are at most rows / hot_rows many, so they are safe to hold and to
    broadcast.  Key columns come back as `hot0`, `hot1`, ...  One job counts
    the keys; it reads the key columns only and combines before its shuffle.
    """
    named = [name_ref(k).alias(f"hot{i}") for i, k in enumerate(keys)]
    counts = df.groupBy(*named).agg(F.count(F.lit(1)).alias("rows"))
    hot = counts.where(F.col("rows") > hot_rows)
    found = hot.collect()
    return df.sparkSession.createDataFrame(found, hot.schema) if found else None


def same_keys(keys: Sequence[str]) -> Column:
    """Join condition between a table and its `hot_keys`."""
    tests = [name_ref(k).eqNullSafe(F.col(f"hot{i}")) for i, k in enumerate(keys)]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def split_hot_keys(
    df: DataFrame, keys: Sequence[str], items: list[tuple[str, bool]], hot_rows: int, hot: DataFrame
) -> tuple[DataFrame, str]:
    """Tag rows of the `hot_keys` with an order range, all other rows with 0."""
    total = hot.agg(F.sum("rows")).first()[0]
    table = F.broadcast(hot.drop("rows"))
    heavy = df.join(table, same_keys(keys), "left_semi") if keys else df
    ranges = OrderRanges.sampled(heavy, items, max(2, math.ceil(4 * total / hot_rows)), total)
    part = fresh_name("order_range", df.columns)
    if not keys:
        return df.withColumn(part, ranges.number(df)), part
    flagged = df.join(table.withColumn("is_hot", F.lit(True)), same_keys(keys), "left")
    tagged = flagged.withColumn(part, F.when(F.col("is_hot"), ranges.number(df)).otherwise(F.lit(0)))
    return tagged.drop("is_hot", *table.columns), part


def ordered_window(
    df: DataFrame,
    partition_by: Sequence[str],
    order_by: OrderBy,
    columns: Mapping[str, Win],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add window columns over `partition_by` in `order_by`.

    Ordinary keys use Spark's window operator as it is.  A hot key is cut into
    order ranges that separate tasks handle; what a range must know of the
    others (row counts, running totals, neighbouring values) comes from one
    small row per range.
    """
    items = require_order(order_by, "a window")
    hot = hot_keys(df, partition_by, hot_rows)
    if hot is None:
        return df.withColumns(_plain(partition_by, items, columns))
    # Internal names from here on, so that none can meet a column of the caller's.
    names = {c: f"u{i}" for i, c in enumerate(df.columns)}
    made = {c: f"w{i}" for i, c in enumerate(columns)}
    renamed = {made[c]: replace(w, field=names[w.field] if w.field else "") for c, w in columns.items()}
    done = _balanced(
        df.select(*[name_ref(c).alias(n) for c, n in names.items()]), [names[k] for k in partition_by],
        [(names[n], d) for n, d in items], renamed, hot_rows, hot,
    )
    return done.select(*[F.col(n).alias(c) for c, n in {**names, **made}.items()])


def _balanced(
    df: DataFrame, partition_by: Sequence[str], items: list[tuple[str, bool]], columns: Mapping[str, Win], hot_rows: int, hot: DataFrame
) -> DataFrame:
    """Window columns with the `hot` keys cut into order ranges."""
    tagged, part = split_hot_keys(df, partition_by, items, hot_rows, hot)
    own, done = list(df.columns), tagged
    framed = {n: w for n, w in columns.items() if w.frame}
    if framed:
        done = _framed(done, part, partition_by, items, framed)
        own += list(framed)
    rest = {n: w for n, w in columns.items() if not w.frame}
    if rest:
        done = _split(done, part, own, partition_by, items, rest)
    return done.select(*[name_ref(c) for c in [*df.columns, *columns]])


def _framed(tagged, part, partition_by, items, columns: Mapping[str, Win]) -> DataFrame:
    """Moving frames: each range also gets the few rows before and after it."""
    keys = [name_ref(k) for k in partition_by]
    order = sort_columns(items)
    back = sort_columns(items, reverse=True)
    before = max(0, *(-w.frame[0] for w in columns.values()))
    after = max(0, *(w.frame[1] for w in columns.values()))
    place, targets = fresh_name("place", tagged.columns), fresh_name("targets", tagged.columns)
    edge = fresh_name("edge", tagged.columns)
    in_range = Window.partitionBy(*keys, name_ref(part))
    in_key = Window.partitionBy(*keys).orderBy(name_ref(part), *order)
    rows = tagged.withColumn(edge, F.lit(False))
    parts = [rows]
    # The last rows of a range serve the ranges found among the rows that follow
    # them, and the first rows those found before; only such edge rows meet here.
    for size, near_end, reach in (
        (before, back, in_key.rowsBetween(1, max(1, before))),
        (after, order, in_key.rowsBetween(-max(1, after), -1)),
    ):
        if not size:
            continue
        edges = tagged.withColumn(place, F.row_number().over(in_range.orderBy(*near_end))).where(name_ref(place) <= size)
        serving = edges.withColumn(targets, F.array_remove(F.collect_set(name_ref(part)).over(reach), name_ref(part)))
        moved = serving.select(
            *[F.explode(name_ref(targets)).alias(c) if c == part else name_ref(c) for c in tagged.columns],
            F.lit(True).alias(edge),
        )
        parts.append(moved)
    window = in_range.orderBy(*order)
    out = {
        n: getattr(F, w.func)(name_ref(w.field)).over(window.rowsBetween(*w.frame)) for n, w in columns.items()
    }
    return reduce(DataFrame.unionByName, parts).withColumns(out).where(~name_ref(edge)).drop(edge)


def _plain(partition_by, items, columns: Mapping[str, Win]) -> dict[str, Column]:
    window = Window.partitionBy(*[name_ref(k) for k in partition_by]).orderBy(*sort_columns(items))
    running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = {}
    for name, win in columns.items():
        col = name_ref(win.field) if win.field else None
        match win.func:
            case "ntile":
                out[name] = F.ntile(win.n).over(window)
            case "row_number" | "rank" | "dense_rank" | "percent_rank" | "cume_dist":
                out[name] = getattr(F, win.func)().over(window)
            case "lag" | "lead":
                out[name] = getattr(F, win.func)(col).over(window)
            case "first" | "last":
                out[name] = getattr(F, win.func)(col).over(whole)
            case "nth":
                out[name] = F.nth_value(col, win.n).over(whole)
            case _:
                frame = window.rowsBetween(*win.frame) if win.frame else running
                out[name] = getattr(F, win.func)(col).over(frame)
    return out


def _split(tagged, part, own, partition_by, items, columns: Mapping[str, Win]) -> DataFrame:
    types = fields_of(tagged)
    fields = sorted({w.field for w in columns.values() if w.field})
    slot = {f: i for i, f in enumerate(fields)}
    funcs = {w.func for w in columns.values()}
    keys = [name_ref(k) for k in partition_by]
    rank = order_struct(tagged, items)

    # One row per key and range.
    facts = [F.count(F.lit(1)).alias("n")]
    if "dense_rank" in funcs:
        facts.append(F.count_distinct(rank).alias("steps"))
    for f, i in slot.items():
        used = {w.func for w in columns.values() if w.field == f}
        col = name_ref(f)
        if "sum" in used:
            facts.append(F.sum(col).alias(f"sum{i}"))
        if "count" in used:
            facts.append(F.count(col).alias(f"count{i}"))
        if "min" in used:
            facts.append(F.min(col).alias(f"min{i}"))
        if "max" in used:
            facts.append(F.max(col).alias(f"max{i}"))
        if used & {"first", "lead"}:
            facts.append(F.min(F.struct(rank.alias("o"), col.alias("v")))["v"].alias(f"first{i}"))
        if used & {"last", "lag"}:
            facts.append(F.max(F.struct(rank.alias("o"), col.alias("v")))["v"].alias(f"last{i}"))
    facts_of = tagged.groupBy(*keys, name_ref(part)).agg(*facts)

    # What came before (or follows) each range.
    over_ranges = Window.partitionBy(*keys).orderBy(name_ref(part))
    before = over_ranges.rowsBetween(Window.unboundedPreceding, -1)
    whole = over_ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = [
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"),
        F.sum("n").over(whole).alias("total"),
    ]
    if "dense_rank" in funcs:
        known.append(F.coalesce(F.sum("steps").over(before), F.lit(0)).alias("steps"))
    merge = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    for name in [c for c in facts_of.columns if c not in (*partition_by, part, "n", "steps")]:
        kind = name.rstrip("0123456789")
        if kind in merge:
            known.append(merge[kind](name).over(before).alias(name))
        elif kind == "first":
            known += [F.first(name).over(whole).alias(name), F.lead(name).over(over_ranges).alias(f"next_{name}")]
        else:
            known += [F.last(name).over(whole).alias(name), F.lag(name).over(over_ranges).alias(f"prev_{name}")]
    summary = facts_of.select(*keys, name_ref(part), *known)
    nths = sorted({(slot[w.field], w.field, w.n) for w in columns.values() if w.func == "nth"})
    for i, field, n in nths:
        summary = _with_nth(summary, tagged, part, partition_by, items, field, n, f"nth{i}_{n}")
    facts_known = [c for c in summary.columns if c not in (*partition_by, part)]
    carried = summary.select(*keys, name_ref(part), F.struct(*facts_known).alias("carry"))

    # Each range starts with its carry row, so data and carry need one shuffle.
    carry = fresh_name("carry", tagged.columns)
    carried = carried.withColumnRenamed("carry", carry)
    filler = [
        F.lit(None).cast(types[c]).alias(c) for c in own if c not in partition_by
    ]
    heads = carried.select(*keys, *filler, name_ref(part), name_ref(carry))
    rows = tagged.withColumn(carry, F.lit(None).cast(heads.schema[carry].dataType)).unionByName(heads)
    is_row = name_ref(carry).isNull()
    window = Window.partitionBy(*keys, name_ref(part)).orderBy(is_row.asc(), *sort_columns(items))
    running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = F.first(name_ref(carry)).over(running)
    with_carry = {fresh_name("got", rows.columns): got}
    got_name = next(iter(with_carry))
    c = name_ref(got_name)

    def number() -> Column:
        return F.row_number().over(window) - 1 + c["n"]

    rank_now = F.rank().over(window) - 1 + c["n"]
    peers = window.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    first_in = F.row_number().over(window) == 2
    out = {}
    for name, win in columns.items():
        i = slot.get(win.field)
        col = name_ref(win.field) if win.field else None
        match win.func:
            case "row_number":
                out[name] = number().cast("int")
            case "rank":
                out[name] = rank_now.cast("int")
            case "dense_rank":
                out[name] = (F.dense_rank().over(window) - 1 + c["steps"]).cast("int")
            case "percent_rank":
                out[name] = F.when(c["total"] == 1, F.lit(0.0)).otherwise((rank_now - 1) / F.nullif(c["total"] - 1, F.lit(0)))
            case "cume_dist":
                out[name] = (F.count(F.lit(1)).over(peers) - 1 + c["n"]) / c["total"]
            case "ntile":
                big, size = c["total"] % win.n, F.floor(c["total"] / win.n)
                edge = big * (size + 1)
                in_big = F.floor((number() - 1) / (size + 1)) + 1
                in_small = big + F.floor((number() - 1 - edge) / F.nullif(size, F.lit(0))) + 1
                out[name] = F.when(number() <= edge, in_big).otherwise(in_small).cast("int")
            case "lag":
                out[name] = F.when(first_in, c[f"prev_last{i}"]).otherwise(F.lag(col).over(window))
            case "lead":
                here = F.lead(F.struct(col.alias("v"))).over(window)
                out[name] = F.when(here.isNull(), c[f"next_first{i}"]).otherwise(here["v"])
            case "first" | "last":
                out[name] = c[f"{win.func}{i}"]
            case "nth":
                out[name] = c[f"nth{i}_{win.n}"]
            case "sum":
                out[name] = _plus(c[f"sum{i}"], F.sum(col).over(running))
            case "count":
                out[name] = F.count(col).over(running) + F.coalesce(c[f"count{i}"], F.lit(0))
            case "min":
                out[name] = F.least(F.min(col).over(running), c[f"min{i}"])
            case "max":
                out[name] = F.greatest(F.max(col).over(running), c[f"max{i}"])
    return rows.withColumns(with_carry).withColumns(out).where(is_row)


def _with_nth(summary, tagged, part, partition_by, items, field: str, n: int, name: str) -> DataFrame:
    """Add the value of each key's n-th row; at most n rows per key and range take part."""
    keys = [name_ref(k) for k in partition_by]
    rows = tagged.select(*keys, name_ref(part), *[name_ref(c).alias(f"o{i}") for i, (c, _) in enumerate(items)], name_ref(field).alias("v"))
    order = sort_columns([(f"o{i}", d) for i, (_, d) in enumerate(items)])
    in_range = Window.partitionBy(*keys, name_ref(part)).orderBy(*order)
    in_key = Window.partitionBy(*keys).orderBy(name_ref(part), *order)
    leading = rows.withColumn("place", F.row_number().over(in_range)).where(F.col("place") <= n)
    found = leading.withColumn("place", F.row_number().over(in_key)).where(F.col("place") == n)
    renamed = {k: f"nth_key{i}" for i, k in enumerate(partition_by)}
    found = found.select(*[name_ref(k).alias(r) for k, r in renamed.items()], F.col("v").alias(name))
    same = reduce(lambda a, b: a & b, [name_ref(k).eqNullSafe(F.col(r)) for k, r in renamed.items()], F.lit(True))
    return summary.join(found, same, "left").drop(*renamed.values())


def _plus(a: Column, b: Column) -> Column:
    """Sum of two nullable sums; null only when both are."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def qualify(df: DataFrame, condition: Column | str, **windows: Column) -> DataFrame:
    """Filter on window columns that are not kept: SQL's QUALIFY.

    A `row_number() <= k` condition also lets Spark drop rows before the shuffle.
    """
    test = F.expr(condition) if isinstance(condition, str) else condition
    return df.withColumns(windows).where(test).drop(*windows)
