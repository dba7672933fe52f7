"""Joins and unions."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.types import align, common_type, fields_of, fresh_name, name_ref, not_null, typed


class JoinSplit(NamedTuple):
    left_only: DataFrame
    join: DataFrame
    right_only: DataFrame


Pairs = Sequence["str | tuple[str, str]"]

SPREAD = 65_536


def key_pairs(on: Pairs | str) -> list[tuple[str, str]]:
    items = [on] if isinstance(on, str) else list(on)
    pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in items]
    pairs = [(l, r) for l, r in pairs if l and r]
    if not pairs:
        raise ValueError("a join needs at least one complete key pair")
    return pairs


def reduce_by(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """One row per key, for joining back to a larger table.

    Grouping also by a number derived from the keys changes no group, but leaves
    the result partitioned by more than the keys.  The join then shuffles this
    small side once more, and AQE, which only splits a hot partition when both
    join sides come straight from a shuffle, can split the large side.
    """
    spread = fresh_name("spread", df.columns)
    tagged = df.withColumn(spread, F.pmod(F.xxhash64(*[name_ref(k) for k in keys]), F.lit(SPREAD)))
    by = [name_ref(k) for k in keys] + [name_ref(spread)]
    out = tagged.groupBy(*by).agg(*aggs) if aggs else tagged.select(*by).distinct()
    return out.drop(spread)


def renamed_side(df: DataFrame, prefix: str) -> tuple[DataFrame, dict[str, str]]:
    """Columns renamed to unique internal names, and the map to them."""
    names = {c: f"{prefix}{i}" for i, c in enumerate(df.columns)}
    return df.select(*[name_ref(c).alias(n) for c, n in names.items()]), names


def _all_equal(left: list[str], right: list[str], null_safe: bool = False) -> Column:
    tests = [
        F.col(a).eqNullSafe(F.col(b)) if null_safe else F.col(a) == F.col(b)
        for a, b in zip(left, right)
    ]
    return reduce(lambda x, y: x & y, tests)


def inner_join(left: DataFrame, right: DataFrame, on: Pairs | str) -> DataFrame:
    """Left columns, then right columns without the right keys; clashes get `_right`, again until the name is free."""
    pairs = key_pairs(on)
    l, lnames = renamed_side(left, "l")
    r, rnames = renamed_side(right, "r")
    cond = _all_equal([lnames[a] for a, _ in pairs], [rnames[b] for _, b in pairs])
    right_keys = {b for _, b in pairs}
    out = [F.col(n).alias(c) for c, n in lnames.items()]
    kept = [c for c in rnames if c not in right_keys]
    taken = {*lnames, *(c for c in kept if c not in lnames)}
    for c in kept:
        name = c
        if c in lnames:
            while name in taken:
                name += "_right"
            taken.add(name)
        out.append(F.col(rnames[c]).alias(name))
    return l.join(r, cond, "inner").select(*out)


def unmatched(left: DataFrame, right: DataFrame, on: Pairs | str) -> DataFrame:
    """Left rows without a match.  A null key never matches, so such rows stay.

    Only the distinct right keys travel, combined before the shuffle, so a key
    repeated many times on the right costs one row.
    """
    pairs = key_pairs(on)
    l, lnames = renamed_side(left, "l")
    keys = right.select(*[name_ref(b).alias(f"r{i}") for i, (_, b) in enumerate(pairs)])
    keys = reduce_by(not_null(keys, keys.columns), keys.columns)
    cond = _all_equal([lnames[a] for a, _ in pairs], keys.columns)
    return l.join(keys, cond, "left_anti").select(*[F.col(n).alias(c) for c, n in lnames.items()])


def join_split(left: DataFrame, right: DataFrame, on: Pairs | str) -> JoinSplit:
    """Inner matches plus the rows of either side without a match."""
    pairs = key_pairs(on)
    return JoinSplit(
        left_only=unmatched(left, right, pairs),
        join=inner_join(left, right, pairs),
        right_only=unmatched(right, left, [(b, a) for a, b in pairs]),
    )


def union_by_name(*dfs: DataFrame) -> DataFrame:
    """Stack by column name; missing columns become null, types widen."""
    if not dfs:
        raise ValueError("union has no inputs")
    if len(dfs) == 1:
        return dfs[0]
    seen: dict[str, list] = {}
    for df in dfs:
        for name, dtype in fields_of(df).items():
            seen.setdefault(name, []).append(dtype)
    want = {name: common_type(types) for name, types in seen.items()}
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [align(df, want) for df in dfs]
    )


def union_by_position(*dfs: DataFrame) -> DataFrame:
    """Stack by position under the first input's names; widths must agree."""
    if not dfs:
        raise ValueError("union has no inputs")
    if len(dfs) == 1:
        return dfs[0]
    names = dfs[0].columns
    if any(len(df.columns) != len(names) for df in dfs):
        raise ValueError("union by position needs the same number of columns")
    want = [common_type(list(types)) for types in zip(*[fields_of(df).values() for df in dfs])]
    aligned = [
        df.select(*[
            typed(name_ref(c), f.dataType, t).alias(n)
            for c, f, t, n in zip(df.columns, df.schema.fields, want, names)
        ])
        for df in dfs
    ]
    return reduce(DataFrame.union, aligned)
