"""Spark SQL over named inputs."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline import operators as op
from weftline.operators import Win
from weftline.plans.registry import Tables, query


def sql(name: str, tables: str, text: str, oracle: str | None = None) -> None:
    """A query given as SQL text over tables of the folder; the oracle is the same text unless given."""

    @query(name, oracle or text)
    def run(t: Tables) -> DataFrame:
        return op.sql_inputs(text, **{n: getattr(t, n) for n in tables.split()})


@query("sql_inputs", """
SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_acctbal > 0 GROUP BY n_name""")
def sql_inputs(t: Tables) -> DataFrame:
    return op.sql_inputs("""
        SELECT n_name, count(*) AS customers FROM input1 JOIN input2 ON c_nationkey = n_nationkey
        WHERE c_acctbal > 0 GROUP BY n_name;""", t.customer, t.nation)


@query("sql_schema_only", """
SELECT 'o_orderstatus' AS field, 'string' AS type UNION ALL SELECT 'n', 'int64' UNION ALL SELECT 'top', 'float64'""")
def sql_schema_only(t: Tables) -> DataFrame:
    """Result columns of a query over whole orders; nothing but the schema is asked for."""
    out = op.sql_inputs("SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM input1 GROUP BY ALL", t.orders)
    return t.spark.createDataFrame(op.preview(out).schema, "field string, type string")


sql("sql_filter_order", "orders", """
SELECT o_orderkey, o_totalprice, o_orderdate FROM orders
WHERE o_orderstatus = 'F' AND o_totalprice > 400000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 500""")

sql("sql_group", "lineitem", """
SELECT l_suppkey, l_returnflag, count(*) AS n, sum(l_quantity) AS quantity, max(l_shipdate) AS latest
FROM lineitem GROUP BY ALL HAVING count(*) > 5""")

sql("sql_join", "customer orders nation", """
SELECT n_name, count(*) AS orders, max(o_totalprice) AS top
FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00' GROUP BY n_name""", """
SELECT n_name, count(*) AS orders, max(o_totalprice) AS top
FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY n_name""")

_OUTER = """
SELECT 'rows' AS kind, o_orderkey, o_custkey, c_name, NULL AS n
FROM (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o
LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c ON c_custkey = o_custkey
UNION ALL
SELECT 'totals', c_custkey, o_custkey, c_name, n
FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c
FULL OUTER JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 450000 GROUP BY o_custkey) o
ON c_custkey = o_custkey"""

sql("sql_outer_join", "customer orders", _OUTER)

# The inner side of each test is reduced to distinct keys, so a key repeated
# many times costs one row.
_TESTS = """
SELECT 'semi' AS kind, c_custkey FROM customer {semi} JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 450000) o ON c_custkey = o_custkey
UNION ALL
SELECT 'anti' AS kind, c_custkey FROM customer {anti} JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000) o ON c_custkey = o_custkey
UNION ALL
SELECT 'exists', c_custkey FROM customer
WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') o WHERE o_custkey = c_custkey)
UNION ALL
SELECT 'not exists', c_custkey FROM customer
WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') o WHERE o_custkey = c_custkey)
UNION ALL
SELECT 'in', c_custkey FROM customer WHERE c_custkey IN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')"""

sql("sql_semi_anti", "customer orders", _TESTS.format(semi="LEFT SEMI", anti="LEFT ANTI"), _TESTS.format(semi="SEMI", anti="ANTI"))

sql("sql_grouping_sets", "lineitem", """
SELECT 'cube' AS kind, l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
UNION ALL
SELECT 'rollup', l_returnflag, l_linestatus, count(*), sum(l_quantity) FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
UNION ALL
SELECT 'sets', l_returnflag, l_linestatus, count(*), sum(l_quantity) FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""")

sql("sql_set_ops", "orders customer", """
(SELECT DISTINCT 'intersect' AS kind, o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT DISTINCT 'intersect', o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL
(SELECT 'except' AS kind, c_custkey FROM customer EXCEPT SELECT DISTINCT 'except', o_custkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL
(SELECT 'intersect all' AS kind, o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT ALL SELECT 'intersect all', o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL
(SELECT 'except all' AS kind, o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT 'except all', o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL
(SELECT 'union' AS kind, c_nationkey FROM customer UNION SELECT 'union', o_custkey FROM orders)""")

sql("sql_subquery", "orders lineitem", """
SELECT o_orderkey, o_custkey, o_totalprice, (SELECT max(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) AS largest_line
FROM orders o
WHERE o_totalprice = (SELECT max(o2.o_totalprice) FROM orders o2 WHERE o2.o_custkey = o.o_custkey)
  AND o_totalprice > (SELECT min(o_totalprice) FROM orders) + 1000""")

sql("sql_cte", "orders", """
WITH RECURSIVE span AS (SELECT min(year(o_orderdate)) AS low, max(year(o_orderdate)) AS high FROM orders),
years (y, high) AS (SELECT low, high FROM span UNION ALL SELECT y + 1, high FROM years WHERE y < high),
counts AS (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate))
SELECT CAST(years.y AS BIGINT) AS y, coalesce(n, 0) AS n FROM years LEFT JOIN counts ON years.y = counts.y""")

sql("sql_pivot", "orders", """
SELECT o_orderpriority, state, n
FROM (SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_custkey FROM orders)
      PIVOT (count(o_custkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p)))
UNPIVOT (n FOR state IN (f, o, p))""", """
SELECT o_orderpriority, lower(o_orderstatus) AS state, count(*) AS n FROM orders GROUP BY ALL""")

sql("sql_nested", "part", """
SELECT p_partkey, word, size(words) AS n, array_join(transform(words, w -> upper(w)), '+') AS shout,
       named_struct('brand', p_brand, 'size', p_size).brand AS brand, size(filter(words, w -> length(w) > 4)) AS long_words
FROM (SELECT *, split(p_name, ' ') AS words FROM part) LATERAL VIEW explode(words) x AS word""", """
SELECT p_partkey, word, CAST(len(words) AS INTEGER) AS n, array_to_string(list_transform(words, lambda w: upper(w)), '+') AS shout,
       {'brand': p_brand, 'size': p_size}.brand AS brand, CAST(len(list_filter(words, lambda w: length(w) > 4)) AS INTEGER) AS long_words
FROM (SELECT *, string_split(p_name, ' ') AS words FROM part), unnest(words) x(word)""")

sql("sql_string_date_math_json", "events", """
SELECT event_id, initcap(event_type) AS title, lpad(CAST(user_id AS STRING), 5, '0') AS code, reverse(event_type) AS backwards,
       CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS hour, datediff(DAY, DATE'2024-01-01', ts) AS days, dayofweek(ts) - 1 AS weekday,
       round(ln(value + 1), 6) AS log_value, CAST(sign(value - 10) AS INT) AS side, CAST(get_json_object(props, '$.k') AS BIGINT) AS k
FROM events""", """
SELECT event_id, upper(event_type[1]) || event_type[2:] AS title, lpad(CAST(user_id AS VARCHAR), 5, '0') AS code,
       reverse(event_type) AS backwards, date_trunc('hour', ts) AS hour, date_diff('day', DATE '2024-01-01', ts) AS days,
       CAST(dayofweek(ts) AS INTEGER) AS weekday, round(ln(value + 1), 6) AS log_value, CAST(sign(value - 10) AS INT) AS side,
       CAST(props ->> '$.k' AS BIGINT) AS k
FROM events""")

sql("sql_approx", "lineitem", """
SELECT s.l_returnflag, e.orders, e.middle, abs(s.about / e.orders - 1) < 0.2 AS distinct_close, abs(s.middle - e.middle) <= 1 AS median_close
FROM (SELECT l_returnflag, approx_count_distinct(l_orderkey) AS about, approx_percentile(l_quantity, 0.5) AS middle
      FROM lineitem GROUP BY l_returnflag) s
JOIN (SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, median(l_quantity) AS middle FROM lineitem GROUP BY l_returnflag) e
ON s.l_returnflag = e.l_returnflag""", """
SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, median(l_quantity) AS middle,
       abs(approx_count_distinct(l_orderkey) / count(DISTINCT l_orderkey) - 1) < 0.5 AS distinct_close,
       abs(quantile_disc(l_quantity, 0.5) - median(l_quantity)) <= 1 AS median_close
FROM lineitem GROUP BY l_returnflag""")

sql("sql_star_except", "orders", "SELECT * EXCEPT (o_orderpriority, o_orderdate) FROM orders",
    "SELECT * EXCLUDE (o_orderpriority, o_orderdate) FROM orders")

@query("sql_window_frame", """
SELECT event_id, user_id,
       round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS last_four,
       CAST(count(*) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS two_days,
       max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS next_two
FROM (SELECT *, date_diff('day', DATE '2024-01-01', ts) AS day FROM events)""")
def window_frame(t: Tables) -> DataFrame:
    """Moving row frames per event; the range frame runs over counts per user and day."""
    events = t.events.selectExpr("event_id", "user_id", "ts", "value", "datediff(DAY, DATE'2024-01-01', ts) AS day")
    framed = op.ordered_window(events, ["user_id"], ["ts", "event_id"], {
        "last_four": Win("sum", "value", frame=(-3, 0)), "next_two": Win("max", "value", frame=(1, 2)),
    })
    return op.sql_inputs("""
        WITH days AS (SELECT user_id, day, count(*) AS n FROM events GROUP BY user_id, day),
        pairs AS (SELECT user_id, day, sum(n) OVER (PARTITION BY user_id ORDER BY day
                         RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS two_days FROM days)
        SELECT event_id, framed.user_id, round(last_four, 4) AS last_four, two_days, next_two
        FROM framed JOIN pairs ON framed.user_id <=> pairs.user_id AND framed.day = pairs.day""", events=events, framed=framed)


@query("sql_window_rank", """
SELECT event_id, user_id, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER v AS INTEGER) AS rk,
       CAST(dense_rank() OVER v AS INTEGER) AS dr, CAST(ntile(4) OVER w AS INTEGER) AS quarter,
       round(percent_rank() OVER v, 9) AS pr, round(cume_dist() OVER v, 9) AS cd
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), v AS (PARTITION BY user_id ORDER BY event_type)""")
def window_rank(t: Tables) -> DataFrame:
    events = t.events.select("event_id", "user_id", "ts", "event_type")
    placed = op.ordered_window(events, ["user_id"], ["ts", "event_id"], {"rn": Win("row_number"), "quarter": Win("ntile", n=4)})
    ranked = op.ordered_window(placed, ["user_id"], ["event_type"], {
        "rk": Win("rank"), "dr": Win("dense_rank"), "pr": Win("percent_rank"), "cd": Win("cume_dist"),
    })
    return ranked.select("event_id", "user_id", "rn", "rk", "dr", "quarter", F.round("pr", 9).alias("pr"), F.round("cd", 9).alias("cd"))


@query("sql_window_analytic", """
SELECT event_id, user_id, lag(value) OVER w AS previous, lead(event_type) OVER w AS following,
       first_value(event_id) OVER w AS opening, last_value(event_id) OVER f AS closing, nth_value(event_id, 2) OVER f AS second
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
     f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def window_analytic(t: Tables) -> DataFrame:
    events = t.events.select("event_id", "user_id", "ts", "event_type", "value")
    out = op.ordered_window(events, ["user_id"], ["ts", "event_id"], {
        "previous": Win("lag", "value"), "following": Win("lead", "event_type"),
        "opening": Win("first", "event_id"), "closing": Win("last", "event_id"), "second": Win("nth", "event_id", 2),
    })
    return out.drop("ts", "event_type", "value")


@query("qualify", """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2""")
def qualify(t: Tables) -> DataFrame:
    by_price = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return op.qualify(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "place <= 2", place=F.row_number().over(by_price))
