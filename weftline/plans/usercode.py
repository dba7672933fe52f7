"""User code: tables, batches, groups, and Arrow functions."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import operators as op
from weftline.plans.registry import Tables, query


@query("python_frames", """
SELECT n_name, count(*) AS customers, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def python_frames(t: Tables) -> DataFrame:
    def by_nation(customers: DataFrame, nations: DataFrame) -> DataFrame:
        # Totals first: the join then handles one row per nation.
        totals = customers.groupBy("c_nationkey").agg(
            F.count(F.lit(1)).alias("customers"), F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("cents")
        )
        return totals.join(nations, totals.c_nationkey == nations.n_nationkey).select("n_name", "customers", "cents")

    return op.python_frames(by_nation, t.customer, t.nation)[0]


@query("python_batches", "SELECT p_partkey, length(p_name) * p_size AS weight FROM part")
def python_batches(t: Tables) -> DataFrame:
    def weigh(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"p_partkey": batch.p_partkey, "weight": batch.p_name.str.len() * batch.p_size})

    return op.python_batches(t.part.select("p_partkey", "p_name", "p_size"), weigh, "p_partkey bigint, weight bigint")


@query("python_groups", """
SELECT nullif(o_custkey, 1) AS customer, max(streak) AS streak FROM (
  SELECT o_custkey, count(*) AS streak FROM (
    SELECT o_custkey, o_orderkey, sum(CASE WHEN o_totalprice > before THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run
    FROM (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders))
  GROUP BY o_custkey, run)
GROUP BY ALL""")
def python_groups(t: Tables) -> DataFrame:
    """Longest run of rising prices of each customer; customer 1 stands for a null key."""
    def longest(orders: pd.DataFrame) -> pd.DataFrame:
        rows = orders.sort_values(["customer", "o_orderkey"])
        # A customer's first row has no difference, so no run goes on from one to the next.
        runs = (~(rows.groupby("customer", dropna=False).o_totalprice.diff() > 0)).cumsum()
        streaks = rows.groupby(runs).agg(customer=("customer", "first"), streak=("o_totalprice", "size"))
        return streaks.groupby("customer", as_index=False, dropna=False).streak.max()

    orders = t.orders.select(F.nullif("o_custkey", F.lit(1)).alias("customer"), "o_orderkey", "o_totalprice")
    return op.python_groups(orders, ["customer"], longest, "customer bigint, streak bigint", many=True)


@query("python_aggregate", """
SELECT nullif(o_orderpriority, '2-HIGH') AS o_orderpriority, count(*) AS n,
  CAST(max(cents) - min(cents) AS BIGINT) AS spread
FROM (SELECT o_orderpriority, CASE WHEN o_orderkey % 10 > 0 AND o_orderpriority <> '5-LOW' THEN round(o_totalprice * 100) END AS cents FROM orders)
GROUP BY ALL""")
def python_aggregate(t: Tables) -> DataFrame:
    """Per-group user code for groups of any size: combined in the tasks first.  One key is null, one has no price."""
    def partial(batch: pd.DataFrame) -> pd.DataFrame:
        cents = (batch.price * 100).round().astype("Int64")
        groups = cents.groupby(batch.o_orderpriority, dropna=False)
        return pd.DataFrame({"n": groups.size(), "low": groups.min(), "high": groups.max()}).rename_axis("o_orderpriority").reset_index()

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.astype({"low": "Int64", "high": "Int64"})
        return parts.groupby("o_orderpriority", as_index=False, dropna=False).agg({"n": "sum", "low": "min", "high": "max"})

    def finish(merged: pd.DataFrame) -> pd.DataFrame:
        return merged.assign(spread=merged.high - merged.low)[["o_orderpriority", "n", "spread"]]

    return op.python_aggregate(
        t.orders.select(
            F.nullif("o_orderpriority", F.lit("2-HIGH")).alias("o_orderpriority"),
            F.when((F.col("o_orderkey") % 10 > 0) & (F.col("o_orderpriority") != "5-LOW"), F.col("o_totalprice")).alias("price"),
        ), ["o_orderpriority"], partial, merge, finish,
        "o_orderpriority string, n bigint, low bigint, high bigint", "o_orderpriority string, n bigint, spread bigint",
    )


@query("udf_scalar", "SELECT p_partkey, round(p_retailprice * 1.1 + p_size, 4) AS price FROM part")
def udf_scalar(t: Tables) -> DataFrame:
    @F.pandas_udf("double")
    def priced(retail: pd.Series, size: pd.Series) -> pd.Series:
        return retail * 1.1 + size

    return t.part.select("p_partkey", F.round(priced("p_retailprice", "p_size"), 4).alias("price"))


@query("udaf", """
SELECT nullif(l_suppkey, 1) AS l_suppkey, max(CASE WHEN r = 2 THEN cents END) AS second_price
FROM (SELECT l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
             dense_rank() OVER (PARTITION BY l_suppkey ORDER BY round(l_extendedprice * 100) DESC) AS r FROM lineitem)
GROUP BY ALL""")
def udaf(t: Tables) -> DataFrame:
    """Second-highest distinct price per supplier: at most two partial rows per key and task."""
    def top_two(frame: pd.DataFrame) -> pd.DataFrame:
        ranked = frame.drop_duplicates().sort_values("cents", ascending=False)
        return ranked.groupby("l_suppkey", sort=False, dropna=False).head(2)

    def partial(batch: pd.DataFrame) -> pd.DataFrame:
        cents = (batch.l_extendedprice * 100).round().astype("Int64")
        return top_two(pd.DataFrame({"l_suppkey": batch.l_suppkey, "cents": cents}))

    def finish(merged: pd.DataFrame) -> pd.DataFrame:
        groups = merged.groupby("l_suppkey", dropna=False).cents
        second = groups.min().astype("Int64").where(groups.size() > 1)
        return second.rename("second_price").reset_index()

    return op.python_aggregate(
        t.lineitem.select(F.nullif("l_suppkey", F.lit(1)).alias("l_suppkey"), "l_extendedprice"), ["l_suppkey"], partial, top_two, finish,
        "l_suppkey bigint, cents bigint", "l_suppkey bigint, second_price bigint",
    )


@query("udtf", """
SELECT p_partkey, CAST(unnest(generate_series(1, len(w))) AS INTEGER) AS place, unnest(w) AS word
FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part WHERE p_size <> 7)
UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_size = 7""")
def udtf(t: Tables) -> DataFrame:
    # Rows go to and fro in batches of pickles; with Arrow each row would make a table of its own.
    @F.udtf(returnType="place int, word string", useArrow=False)
    class Words:
        def eval(self, text: str):
            if text is None:
                yield None, None
                return
            yield from enumerate(text.split(" "), 1)

    named = t.part.select("p_partkey", F.when(F.col("p_size") != 7, F.col("p_name")).alias("p_name"))
    return named.lateralJoin(Words(F.col("p_name").outer())).select("p_partkey", "place", "word")
