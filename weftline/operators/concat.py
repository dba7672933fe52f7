"""Ordered concatenation of texts per group."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.ordering import SAMPLED_WIDTH, OrderBy, order_struct, require_order, sort_columns
from weftline.types import name_ref

#: Bytes of the longest text that a group may give; a cell holds 2 GB at most.
MOST_BYTES = 1 << 30
#: Rows of a group that one task sorts as a list; with larger groups the table is cut.
HOT_ROWS = 500_000


def concat_text(
    df: DataFrame,
    keys: Sequence[str],
    field: str,
    order_by: OrderBy,
    name: str = "",
    separator: str = ", ",
    most_bytes: int = MOST_BYTES,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Per group the values of `field` as one text, in `order_by` (nulls first), ties by the text itself.

    Null values are left out, empty texts are not; a group of nulls alone gives null.
    Without keys there is one row, also for an empty table.  Null is a key like any
    other.  The column is called `concat_{field}` unless `name` is given.

    One cell must hold a group's text, so groups are measured first, by one aggregate,
    and a text of more than `most_bytes` bytes is refused.  If a group has more than `hot_rows`
    rows, the table is cut into ranges of its key and order whose pieces are made by separate
    tasks and then joined.
    """
    items = require_order(order_by, "an ordered text")
    name = name or f"concat_{field}"
    if name in keys:
        raise ValueError(f"{name!r} is a key")
    # Internal names, so that none can meet a column of the caller's.
    own = [f"k{i}" for i in range(len(keys))]
    ordered = [(f"o{i}", d) for i, (_, d) in enumerate(items)]
    rows = df.select(
        *[name_ref(k).alias(n) for k, n in zip(keys, own)],
        *[name_ref(c).alias(n) for (c, _), (n, _) in zip(items, ordered)],
        name_ref(field).cast("string").alias("value"),
    )
    filled = rows.where("value is not null")
    gap = len(separator.encode())
    size = F.sum(F.octet_length("value").cast("bigint") + gap) - gap
    counted = filled.groupBy(*own).agg(F.count("*").alias("rows"), size.alias("bytes"))
    large, most, total = counted.agg(F.max("bytes"), F.max("rows"), F.sum("rows")).first()
    if large is not None and large > most_bytes:
        raise ValueError(f"a group's text would hold {large} bytes, more than {most_bytes}")
    ordered += [("value", False)]
    if (most or 0) <= hot_rows:
        # The last field of the order is the value.
        place = F.when(F.col("value").isNotNull(), order_struct(rows, ordered))
        out = rows.groupBy(*own).agg(_joined(place, f"k{len(items)}", separator).alias("text"))
    else:
        # The ranges follow the order inside a key, so pieces join by the number of their range.
        by_key = [F.xxhash64(*own)] if own else []
        cut = filled.repartitionByRange(max(2, math.ceil(4 * total / hot_rows)), *by_key, *_range_keys(filled, ordered))
        # A range is sorted as rows; the lists then only have to compare numbers that mostly rise.
        cut = cut.sortWithinPartitions(*sort_columns(ordered))
        placed = cut.select(*own, "value", F.spark_partition_id().alias("at"), F.monotonically_increasing_id().alias("place"))
        pieces = placed.groupBy(*own, "at").agg(_joined(F.struct("place", "value"), "value", separator).alias("piece"))
        # Groups of nulls alone stay by one row of theirs.
        empty = rows.where("value is null").select(*own, F.lit(-1).alias("at"), F.lit(None).cast("string").alias("piece")).distinct()
        pieces = pieces.unionByName(empty)
        # A null piece is no element of the list.
        piece = F.when(F.col("piece").isNotNull(), F.struct("at", "piece"))
        out = pieces.groupBy(*own).agg(_joined(piece, "piece", separator).alias("text"))
    return out.select(*[F.col(n).alias(k) for n, k in zip(own, keys)], F.col("text").alias(name))


def _joined(place: Column, field: str, separator: str) -> Column:
    """The texts of one group in the order of the structs that hold them; null if there are none."""
    listed = F.transform(F.sort_array(F.collect_list(place)), lambda x: x[field])
    return F.when(F.count(place) > 0, F.array_join(listed, separator))


def _range_keys(df: DataFrame, items: list[tuple[str, bool]]) -> list[Column]:
    """Sort keys that follow the row order but hold only the beginning of long texts.

    Behind a text that is cut the other keys are null, so rows that differ only there share a range.
    """
    whole, out = F.lit(True), []
    for name, descending in items:
        key = name_ref(name)
        if isinstance(df.schema[name].dataType, (T.StringType, T.BinaryType)):
            key = F.substring(key, 1, SAMPLED_WIDTH + 1)
        told = F.when(whole, key)
        out.append(told.desc_nulls_first() if descending else told.asc_nulls_first())
        if isinstance(df.schema[name].dataType, (T.StringType, T.BinaryType)):
            whole = whole & (F.coalesce(F.length(key), F.lit(0)) <= SAMPLED_WIDTH)
    return out
