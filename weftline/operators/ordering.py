"""Row order made explicit.

Spark tables have no row order, so operators that depend on one take `order_by`:
column names, or (name, "desc") pairs.  Nulls come first in both directions.

Ranks over a whole table never use an unpartitioned window.  `OrderedBuckets`
cuts the order into ranges of similar size from a bounded sample, counts each
range, and lets every range be ranked by its own task; a broadcast table of at
most `MAX_BUCKETS` offsets makes the ranks global.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.types import TEXT_TIMES, fields_of, fresh_name, name_ref

OrderBy = Sequence["str | tuple[str, str]"]

ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 32_768
SAMPLES_PER_BUCKET = 8
# So much of a text is sampled and sent as a cut, however long the texts are.
SAMPLED_WIDTH = 64
# Longer ones, with fewer ranges, for texts that share so much.
WIDER = (1024, 16384)
CHUNK_OF_COPIES = 65_536
SKETCH_GROUPS = 256


def order_items(order_by: OrderBy | str) -> list[tuple[str, bool]]:
    """(name, descending) pairs."""
    items = [order_by] if isinstance(order_by, str) else list(order_by)
    out = []
    for item in items:
        name, direction = (item, "asc") if isinstance(item, str) else item
        if direction not in ("asc", "desc", "ascending", "descending"):
            raise ValueError(f"unknown direction {direction!r}")
        out.append((name, direction.startswith("desc")))
    return out


def require_order(order_by: OrderBy | str | None, what: str) -> list[tuple[str, bool]]:
    if not order_by:
        raise ValueError(f"{what} depends on row order: give order_by")
    return order_items(order_by)


def sort_columns(items: list[tuple[str, bool]], reverse: bool = False) -> list[Column]:
    """Sort expressions, nulls first; `reverse` gives the exact opposite order."""
    if reverse:
        return [name_ref(n).asc_nulls_last() if d else name_ref(n).desc_nulls_last() for n, d in items]
    return [name_ref(n).desc_nulls_first() if d else name_ref(n).asc_nulls_first() for n, d in items]


def _ascending(col: Column, dtype: T.DataType, descending: bool) -> Column:
    """A value whose ascending order is the asked-for order; null stays null, so first."""
    if not descending:
        return col
    if isinstance(dtype, T.BooleanType):
        return ~col
    if isinstance(dtype, T.IntegralType):
        return F.bitwise_not(col)  # -x - 1, free of overflow
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        # NaN sorts as the largest number, so it leads a descending order.
        return F.when(col.isNotNull(), F.struct(~F.isnan(col), -col))
    if isinstance(dtype, T.DecimalType):
        return -col
    if isinstance(dtype, T.DayTimeIntervalType):
        return -col
    if isinstance(dtype, T.TimeType):
        return -F.time_diff(F.lit("MICROSECOND"), F.lit("00:00:00").cast("time"), col)
    if isinstance(dtype, T.DateType):
        return -F.unix_date(col)
    if isinstance(dtype, T.TimestampType):
        return -F.unix_micros(col)
    if isinstance(dtype, T.TimestampNTZType):
        return -F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col)
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        # Complement the bytes; the end mark sorts a prefix behind its extensions.
        flipped = F.translate(F.hex(col), "0123456789ABCDEF", "FEDCBA9876543210")
        return F.concat(flipped, F.lit("G"))
    raise TypeError(f"cannot sort {dtype.simpleString()} in descending order here")


def order_struct(df: DataFrame, items: list[tuple[str, bool]], width: int | None = None) -> Column:
    """One struct whose ascending order is the row order: usable in min, max and <=.

    With `width` only so much of each text counts.  Structs cut to one width do not
    follow the row order: beyond a text that is cut, the next key decides.
    """
    types = fields_of(df)

    def key(name: str) -> Column:
        cut = width and isinstance(types[name], (T.StringType, T.BinaryType))
        return F.substring(name_ref(name), 1, width) if cut else name_ref(name)

    return F.struct(*[_ascending(key(n), types[n], d).alias(f"k{i}") for i, (n, d) in enumerate(items)])


@dataclass(frozen=True)
class Bounds:
    """Sorted cut values, held as text so that every later pass sees the same ones."""

    text: str
    type: T.DataType
    count: int

    @staticmethod
    def collected(df: DataFrame) -> Bounds:
        """From a table of one row with one array column."""
        name = df.columns[0]
        row = df.select(F.to_json(name, TEXT_TIMES).alias("text"), F.size(name).alias("n")).first()
        return Bounds(row["text"] or "[]", df.schema[name].dataType, max(0, row["n"] or 0))

    def bucket_of(self, value: Column) -> Column:
        """How many of the bounds are at or below `value`; never null.

        The optimizer folds the bounds to one literal, which is shared by all
        rows, and the search is binary and stays inside the JVM.
        """
        bounds = F.from_json(F.lit(self.text), self.type, TEXT_TIMES)
        steps = [2**i for i in reversed(range(max(1, self.count.bit_length())))]
        return F.aggregate(
            F.array(*[F.lit(s) for s in steps]),
            F.lit(0),
            lambda low, step: F.when(F.get(bounds, low + step - 1) <= value, low + step).otherwise(low),
        )


def even_bounds(df: DataFrame, value: Column, n_buckets: int) -> Bounds:
    """Bounds of about equally full ranges of a numeric or time value.

    Quantile sketches are merged by `SKETCH_GROUPS` tasks, and one task takes
    quantiles of their few results, so no task merges a sketch per input task.
    The bounds only balance work: results do not depend on where the cuts fall.
    """
    # One array literal keeps the plan small.
    fractions = F.lit(np.arange(1, n_buckets) / n_buckets)
    shares = df.select(value.alias("v"), F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("share"))
    local = shares.groupBy("share").agg(F.percentile_approx("v", fractions, 2 * n_buckets).alias("q"))
    pooled = F.percentile_approx("v", fractions, 4 * n_buckets)
    return Bounds.collected(local.select(F.explode("q").alias("v")).agg(F.array_sort(F.array_distinct(pooled)).alias("bounds")))


def repeat_rows(df: DataFrame, times: str) -> DataFrame:
    """Each row `times` times (the column is dropped).

    Long runs are first cut into chunks that the shuffle spreads over tasks, so
    a row with billions of copies is not unrolled by one task.
    """
    keep = [c for c in df.columns if c != times]
    chunk, copy = fresh_name("chunk", df.columns), fresh_name("copy", df.columns)
    size = F.lit(CHUNK_OF_COPIES)
    last_chunk = F.floor((name_ref(times) - 1) / size)
    chunks = df.where(name_ref(times) > 0).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last_chunk)).alias(chunk))
    spread = chunks.repartition(name_ref(chunk), F.xxhash64(*[name_ref(c) for c in keep]))
    here = F.least(size.cast("bigint"), name_ref(times) - name_ref(chunk) * size)
    return spread.select(
        *[name_ref(c) for c in keep], F.explode(F.sequence(F.lit(1).cast("bigint"), here)).alias(copy)
    ).drop(copy)


@dataclass(frozen=True)
class OrderRanges:
    """Cuts of a row order into ranges."""

    items: list[tuple[str, bool]]
    bounds: Bounds
    width: int = SAMPLED_WIDTH

    @staticmethod
    def sampled(df: DataFrame, items: list[tuple[str, bool]], n_ranges: int, total: int, width: int = SAMPLED_WIDTH) -> OrderRanges:
        """Cuts from a sample of a few rows per range; `total` is the row count.

        The wider the sampled texts, the fewer the ranges.
        """
        n_ranges = min(n_ranges, MAX_BUCKETS * SAMPLED_WIDTH // width)
        fraction = min(1.0, n_ranges * SAMPLES_PER_BUCKET / max(1, total))
        keys = df.select(order_struct(df, items, width).alias("k")).sample(fraction, seed=17)
        ranked = keys.agg(F.sort_array(F.collect_list("k")).alias("ks"))
        picks = F.transform(
            F.sequence(F.lit(1), F.lit(n_ranges - 1)),
            lambda i: F.get(F.col("ks"), F.floor(i * F.size("ks") / n_ranges).cast("int")),
        )
        return OrderRanges(items, Bounds.collected(ranked.select(F.array_distinct(F.array_compact(picks)).alias("bounds"))), width)

    def number(self, df: DataFrame) -> Column:
        """The range number of each row; rows of equal order share a range.

        A bound has at most `width` of each text, so one more character of the row's
        text compares with it as the whole text does, and the numbers follow the row order.
        """
        return self.bounds.bucket_of(order_struct(df, self.items, self.width + 1))


class OrderedBuckets:
    """A table cut into ranges of its row order, with the row count of each range."""

    def __init__(self, df: DataFrame, order_by: OrderBy | str, rows_per_bucket: int = ROWS_PER_BUCKET):
        items = order_items(order_by)
        named = {n for n, _ in items}
        self.source = df
        # Remaining columns break ties, so equal positions mean equal rows.
        self.items = items + [(c, False) for c in df.columns if c not in named]
        self.bucket = fresh_name("bucket", df.columns)
        total = df.count()
        n_buckets = max(1, min(MAX_BUCKETS, math.ceil(total / rows_per_bucket)))
        self._build(items, n_buckets, total)
        self.collapse = False
        if n_buckets > 1 and self._oversized(rows_per_bucket):
            # Many rows share one order value: cut by the tie-breaking columns too,
            # and if copies of one row still fill a range, rank them as one row.
            if len(self.items) > len(items):
                self._build(self.items, n_buckets, total)
            for width in WIDER:
                # Texts that share a long beginning fall into one range until the cuts are longer.
                if not self._oversized(rows_per_bucket):
                    break
                if any(isinstance(f.dataType, (T.StringType, T.BinaryType)) for f in df.schema.fields):
                    self._build(self.items, n_buckets, total, width)
            self.collapse = self._oversized(rows_per_bucket)

    def _oversized(self, rows_per_bucket: int) -> bool:
        return max(self.counts) > 8 * max(rows_per_bucket, sum(self.counts) // len(self.counts))

    def _build(self, items: list[tuple[str, bool]], n_buckets: int, total: int, width: int = SAMPLED_WIDTH) -> None:
        df = self.source
        if n_buckets == 1:
            self.df = df.withColumn(self.bucket, F.lit(0))
            self.counts = [total]
            return
        ranges = OrderRanges.sampled(df, items, n_buckets, total, width)
        self.df = df.withColumn(self.bucket, ranges.number(df))
        found = {r[0]: r[1] for r in self.df.groupBy(self.bucket).count().collect()}
        self.counts = [found.get(b, 0) for b in range(ranges.bounds.count + 1)]

    @property
    def total(self) -> int:
        return sum(self.counts)

    def _spans(self, df: DataFrame, collapse: bool) -> DataFrame:
        """Rows with the first 0-based position `start` and the number of `copies`.

        Without `collapse` each row stands for itself.
        """
        bucket = name_ref(self.bucket)
        starts = list(accumulate(self.counts, initial=0))[:-1]
        in_bucket = Window.partitionBy(bucket).orderBy(*sort_columns(self.items))
        if collapse:
            df = df.groupBy(*[name_ref(c) for c in df.columns]).agg(F.count(F.lit(1)).alias(self.copies))
            upto = in_bucket.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            local = F.sum(self.copies).over(upto) - name_ref(self.copies)
        else:
            df = df.withColumn(self.copies, F.lit(1).cast("bigint"))
            local = F.row_number().over(in_bucket).cast("bigint") - 1
        ranked = df.withColumn(self.start, local)
        if len(starts) > 1:
            # At most MAX_BUCKETS rows, so small enough to broadcast at any scale.
            offsets = self.source.sparkSession.createDataFrame(
                list(enumerate(starts)), f"`{self.bucket}` int, `{self.offset}` bigint"
            )
            ranked = ranked.join(F.broadcast(offsets), self.bucket)
            ranked = ranked.withColumn(self.start, name_ref(self.start) + name_ref(self.offset)).drop(self.offset)
        return ranked.drop(self.bucket)

    @property
    def start(self) -> str:
        return fresh_name("start", self.source.columns)

    @property
    def copies(self) -> str:
        return fresh_name("copies", self.source.columns)

    @property
    def offset(self) -> str:
        return fresh_name("offset", self.source.columns)

    def every(self, step: int) -> DataFrame:
        """Rows at positions 0, step, 2 * step, ..."""
        columns = [name_ref(c) for c in self.source.columns]
        spans = self._spans(self.df, self.collapse)
        start, copies = name_ref(self.start), name_ref(self.copies)
        if not self.collapse:
            return spans.where(start % step == 0).select(*columns)

        def multiples_below(x: Column) -> Column:
            return F.floor((x + (step - 1)) / step)

        hits = multiples_below(start + copies) - multiples_below(start)
        return repeat_rows(spans.select(*columns, hits.alias(self.copies)), self.copies)

    def between(self, low: int, high: int) -> DataFrame:
        """Rows at positions low <= p < high.

        Whole ranges inside the interval pass without any shuffle; only the one
        or two ranges it cuts are ranked.
        """
        columns = [name_ref(c) for c in self.source.columns]
        starts = list(accumulate(self.counts, initial=0))
        bounds = [(b, starts[b], starts[b + 1]) for b in range(len(self.counts)) if self.counts[b]]
        inside = [b for b, s, e in bounds if low <= s and e <= high]
        cut = [b for b, s, e in bounds if b not in set(inside) and s < high and e > low]
        bucket = name_ref(self.bucket)
        parts = []
        if inside:
            parts.append(self.df.where(bucket.between(inside[0], inside[-1])).select(*columns))
        if cut:
            spans = self._spans(self.df.where(bucket.isin(cut)), self.collapse)
            first = F.greatest(name_ref(self.start), F.lit(low))
            last = F.least(name_ref(self.start) + name_ref(self.copies), F.lit(high))
            if self.collapse:
                parts.append(repeat_rows(spans.select(*columns, (last - first).alias(self.copies)), self.copies))
            else:
                parts.append(spans.where(last > first).select(*columns))
        if not parts:
            return self.source.limit(0)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def positions(self, name: str) -> DataFrame:
        """All rows with their 0-based position in the row order."""
        spans = self._spans(self.df, self.collapse)
        if not self.collapse:
            return spans.withColumnRenamed(self.start, name).drop(self.copies)
        # Copies of one row were ranked as one; their positions follow each other.
        keep = [name_ref(c) for c in self.source.columns]
        chunk, size = fresh_name("chunk", spans.columns), F.lit(CHUNK_OF_COPIES).cast("bigint")
        start, copies = name_ref(self.start), name_ref(self.copies)
        chunks = spans.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((copies - 1) / size))).alias(chunk))
        low = start + name_ref(chunk) * size
        spread = chunks.repartition(name_ref(chunk), start)
        return spread.select(*keep, F.explode(F.sequence(low, F.least(low + size, start + copies) - 1)).alias(name))
