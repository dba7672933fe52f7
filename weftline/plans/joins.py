"""Joins and unions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import operators as op
from weftline.plans.registry import Tables, query

_SIDES = """
WITH c AS (SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'),
     o AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F')
"""


def _split(t: Tables) -> op.JoinSplit:
    building = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", "c_nationkey")
    finished = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")
    return op.join_split(building, finished, [("c_custkey", "o_custkey")])


@query("join_inner", _SIDES + """
SELECT c_custkey, c_name, c_nationkey, o_orderkey, o_totalprice FROM c JOIN o ON c_custkey = o_custkey""")
def join_inner(t: Tables) -> DataFrame:
    return _split(t).join


@query("join_left_only", _SIDES + "SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o_custkey = c_custkey)")
def join_left_only(t: Tables) -> DataFrame:
    return _split(t).left_only


@query("join_right_only", _SIDES + "SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM c WHERE o_custkey = c_custkey)")
def join_right_only(t: Tables) -> DataFrame:
    return _split(t).right_only


@query("union_by_name", """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, NULL AS nation FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, s_nationkey FROM supplier""")
def union_by_name(t: Tables) -> DataFrame:
    return op.union_by_name(
        t.customer.selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment"),
        t.supplier.selectExpr("s_acctbal AS balance", "s_suppkey AS id", "s_name AS name", "s_nationkey AS nation"),
    )


@query("union_by_position", """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier
UNION ALL SELECT p_partkey, p_name, p_partkey FROM part""")
def union_by_position(t: Tables) -> DataFrame:
    return op.union_by_position(
        t.customer.select("c_custkey", "c_name", "c_nationkey"),
        t.supplier.select("s_suppkey", "s_name", "s_nationkey"),
        t.part.select("p_partkey", "p_name", F.col("p_partkey").alias("again")),
    )


@query("asof_join", """
SELECT p.user_id, p.event_id, p.ts, v.event_id AS event_id_right, v.ts AS ts_right
FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_join(t: Tables) -> DataFrame:
    """Each purchase with the user's latest view before it."""
    events = t.events.select("user_id", "event_id", "ts", "event_type")
    purchases = events.where("event_type = 'purchase'").drop("event_type")
    views = events.where("event_type = 'view'").drop("event_type")
    return op.asof_join(purchases, views, ["user_id"], "ts", "ts")


@query("sql_cross_theta", """
SELECT e.event_id, e.user_id, e.at, v.view_id, v.opened, v.closed
FROM (SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type <> 'view') e
JOIN (SELECT event_id AS view_id, user_id, epoch_us(ts) AS opened, epoch_us(ts) + 3600000000 AS closed
      FROM events WHERE event_type = 'view') v
ON e.user_id = v.user_id AND e.at >= v.opened AND e.at < v.closed""")
def range_join(t: Tables) -> DataFrame:
    """Events within the hour after a view by the same user: a join on a range."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    hour = 3_600_000_000
    acts = t.events.where("event_type <> 'view'").select("event_id", "user_id", at.alias("at"))
    views = t.events.where("event_type = 'view'").select(
        F.col("event_id").alias("view_id"), "user_id", at.alias("opened"), (at + hour).alias("closed")
    )
    return op.range_join(acts, views, "at", "opened", "closed", hour, on=["user_id"]).drop("user_id_right")
