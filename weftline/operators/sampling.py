"""Sorting, top rows, and row samples of exact size."""
from __future__ import annotations

import random
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ordering import (
    ROWS_PER_BUCKET, OrderBy, OrderedBuckets, order_items, repeat_rows, require_order, sort_columns,
)
from weftline.operators.windows import HOT_ROWS
from weftline.types import fresh_name, name_ref

# Up to here a result is a plain top-k, which one task merges; beyond it the
# rows are picked range by range and sorted without ever gathering them.
TOP_K_LIMIT = 1_000

HASH_DIGITS = 4  # 65,536 prefixes


def sort_rows(df: DataFrame, keys: OrderBy) -> DataFrame:
    """Sort by several keys, nulls first in both directions; no keys: unchanged.

    A hash of the row breaks ties, so that rows of one common key value are sorted
    by more than one task.
    """
    items = [(n, d) for n, d in order_items(keys) if n]
    if not items:
        return df
    hashed = [name_ref(f.name) for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    return df.orderBy(*sort_columns(items), F.xxhash64(*hashed))


def top_k(df: DataFrame, keys: OrderBy, n: int) -> DataFrame:
    """The first `n` rows of the sorted table."""
    return sample_first(df, n, keys)


def _tie_broken(df: DataFrame, items: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    named = {n for n, _ in items}
    return items + [(c, False) for c in df.columns if c not in named]


def sample_first(df: DataFrame, n: int, order_by: OrderBy, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    items = require_order(order_by, "first n")
    if n <= TOP_K_LIMIT:
        return df.orderBy(*sort_columns(_tie_broken(df, items))).limit(max(0, n))
    rows = OrderedBuckets(df, items_to_order(items), rows_per_bucket).between(0, n)
    return rows.orderBy(*sort_columns(_tie_broken(df, items)))


def sample_last(df: DataFrame, n: int, order_by: OrderBy, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    items = require_order(order_by, "last n")
    if n <= TOP_K_LIMIT:
        tied = _tie_broken(df, items)
        tail = df.orderBy(*sort_columns(tied, reverse=True)).limit(max(0, n))
        return tail.orderBy(*sort_columns(tied))
    rows = OrderedBuckets(df, items_to_order(items), rows_per_bucket)
    return rows.between(max(0, rows.total - n), rows.total).orderBy(*sort_columns(_tie_broken(df, items)))


def items_to_order(items: list[tuple[str, bool]]) -> list[tuple[str, str]]:
    return [(n, "desc" if d else "asc") for n, d in items]


def sample_every_n(df: DataFrame, n: int, order_by: OrderBy, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Every n-th row of the row order, starting with the first."""
    items = require_order(order_by, "every n-th")
    return OrderedBuckets(df, items_to_order(items), rows_per_bucket).every(max(1, int(n)))


def row_index(df: DataFrame, order_by: OrderBy, name: str = "row_index", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add the 0-based position in the row order."""
    items = require_order(order_by, "a row index")
    return OrderedBuckets(df, items_to_order(items), rows_per_bucket).positions(name)


def _hash_order(df: DataFrame, seed: int, keys: Sequence[str]) -> tuple[DataFrame, str]:
    seed = seed or random.SystemRandom().randrange(1, 2**31)
    digest = fresh_name("digest", df.columns)
    parts = [name_ref(k).cast("string") for k in keys or df.columns]
    return df.withColumn(digest, F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))), digest


def sample_random_n(
    df: DataFrame, n: int, seed: int = 0, keys: Sequence[str] = (), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Exactly min(n, rows) rows without replacement.

    Rows are taken in the order of a keyed digest, so a seed gives the same
    rows under any partitioning.  `keys` name a row's identity (default: all
    columns); seed 0 draws a new seed per call.
    """
    tagged, digest = _hash_order(df, seed, keys)
    columns = [name_ref(c) for c in df.columns]
    if n <= TOP_K_LIMIT:
        return tagged.orderBy(digest, *columns).limit(max(0, n)).select(*columns)
    return _smallest_digests(tagged, digest, df.columns, lambda total: n, hot_rows)


def sample_random_pct(
    df: DataFrame, pct: float, seed: int = 0, keys: Sequence[str] = (), hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Exactly floor(rows * pct / 100) rows, pct clamped to 0..100."""
    fraction = max(0.0, min(1.0, pct / 100.0))
    tagged, digest = _hash_order(df, seed, keys)
    return _smallest_digests(tagged, digest, df.columns, lambda total: int(total * fraction), hot_rows)


def _smallest_digests(tagged: DataFrame, digest: str, columns: list[str], size_of, hot_rows: int) -> DataFrame:
    """The rows with the smallest digests, their number given by `size_of(total)`.

    Digests are uniform, so counting their 65,536 prefixes tells which prefixes
    are taken whole: those rows pass without a shuffle.  Only the one prefix the
    limit cuts is ordered; when copies of a row made it large they are combined first.
    """
    out = [name_ref(c) for c in columns]
    prefix = F.conv(F.substring(name_ref(digest), 1, HASH_DIGITS), 16, 10).cast("int")
    # At most 65,536 rows.
    found = tagged.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts = dict(zip(found.p.tolist(), found.n.tolist()))
    total = sum(counts.values())
    size = min(total, max(0, size_of(total)))
    whole = [-1]
    taken = 0
    for p, upto in zip(sorted(counts), accumulate(counts[p] for p in sorted(counts))):
        if upto > size:
            break
        whole.append(p)
        taken = upto
    head = tagged.where(prefix <= whole[-1]).select(*out)
    rest = size - taken
    if not rest:
        return head
    cut = min(p for p in counts if p > whole[-1])
    rows = tagged.where(prefix == cut)
    if counts[cut] <= hot_rows:
        return head.unionByName(rows.orderBy(name_ref(digest), *out).limit(rest).select(*out))
    copies = fresh_name("copies", tagged.columns)
    ends = fresh_name("ends", tagged.columns)
    distinct = rows.groupBy(*[name_ref(c) for c in tagged.columns]).agg(
        F.count(F.lit(1)).alias(copies)
    )
    order = Window.orderBy(name_ref(digest), *out).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = distinct.withColumn(ends, F.sum(copies).over(order))
    used = F.least(name_ref(copies), F.lit(rest) - (name_ref(ends) - name_ref(copies)))
    return head.unionByName(repeat_rows(ranked.select(*out, used.alias(copies)), copies))
