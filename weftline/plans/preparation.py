"""Fuzzy matching, recurrences, replacing, tiles, gap filling, profiles, ordered texts, class sizes, bad cells, partitions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import operators as op
from weftline import sources as src
from weftline.plans.registry import Tables, query


@query("fuzzy_match", """
WITH a AS (SELECT DISTINCT nullif(p_name, 'red plate') AS t FROM part),
b AS (SELECT DISTINCT replace(nullif(p_name, 'old rod'), 'ing', 'in') AS t FROM part WHERE p_size > 5 UNION SELECT DISTINCT left(p_name, 3) FROM part)
SELECT a.t AS left_text, b.t AS right_text, levenshtein(a.t, b.t) AS distance FROM a, b WHERE levenshtein(a.t, b.t) <= 3""")
def fuzzy_match(t: Tables) -> DataFrame:
    """Names that are at most three edits apart."""
    names = t.part.select(F.nullif("p_name", F.lit("red plate")).alias("name"))
    others = t.part.where("p_size > 5").select(F.expr("replace(nullif(p_name, 'old rod'), 'ing', 'in')").alias("name"))
    others = others.unionByName(t.part.select(F.substring("p_name", 1, 3).alias("name")))
    return op.fuzzy_pairs(names, others, "name", "name", max_distance=3).withColumn("distance", F.col("distance").cast("bigint"))


_STEPS = """
WITH RECURSIVE e AS (
  SELECT event_id, user_id, event_type, nullif(CAST(round(value) AS BIGINT), 7) AS v, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
run AS (
  SELECT event_id, user_id, n, 0.5::DOUBLE * 100 + value AS balance, greatest(coalesce(v, 0) - 50, 0) AS excess, v AS level FROM e WHERE n = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.n, 0.5::DOUBLE * r.balance + e.value, greatest(r.excess + coalesce(e.v, 0) - 50, 0), CASE WHEN e.event_type = 'error' THEN e.v ELSE r.level + e.v END
  FROM run r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT event_id, user_id, balance, excess, level FROM run"""


@query("multi_row_formula", _STEPS)
def multi_row_formula(t: Tables) -> DataFrame:
    """Per user: half the balance before plus the value; what exceeds 50 a step, summed, never below 0; a sum that errors restart."""
    rounded = F.nullif(F.round("value").cast("bigint"), F.lit(7))
    rows = t.events.select(
        "event_id", "user_id", "ts", "value", F.lit(0.5).alias("half"), (F.coalesce(rounded, F.lit(0)) - 50).alias("over"), F.lit(0).cast("bigint").alias("zero"),
        F.lit(1).cast("bigint").alias("one"), rounded.alias("v"), (F.col("event_type") == "error").alias("failed"))
    order = ["ts", "event_id"]
    rows = op.recurrence(rows, ["user_id"], order, "balance", "half", "value", start=100.0)
    rows = op.recurrence(rows, ["user_id"], order, "excess", "over", "zero", kind="max_plus")
    rows = op.recurrence(rows, ["user_id"], order, "level", "one", "v", reset="failed")
    return rows.select("event_id", "user_id", "balance", "excess", "level")


_WORDS = "(SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)"


@query("find_replace", f"""
WITH f AS (SELECT DISTINCT unnest([w, left(w, 2), left(w, 3), right(w, 3), w || ' r']) AS find FROM {_WORDS}),
pattern AS (SELECT '(' || string_agg(find, '|' ORDER BY length(find) DESC, find) || ')' AS p FROM f)
SELECT p_partkey, p_brand, regexp_replace(nullif(p_name, 'red plate'), p, '[\\1]', 'g') AS p_name, CASE WHEN p_type IN (SELECT p_type FROM part WHERE p_size < 2) THEN 'found ' || p_type ELSE p_type END AS p_type
FROM part, pattern""")
def find_replace(t: Tables) -> DataFrame:
    """Parts of names by overlapping entries (the longest wins), and whole types."""
    word = t.part.select(F.explode(F.split("p_name", " ")).alias("w"))
    finds = F.array("w", F.left("w", F.lit(2)), F.left("w", F.lit(3)), F.right("w", F.lit(3)), F.concat("w", F.lit(" r")))
    entries = word.select(F.explode(finds).alias("find")).withColumn("put", F.concat(F.lit("["), "find", F.lit("]")))
    types = t.part.where("p_size < 2").select("p_type", F.concat(F.lit("found "), "p_type").alias("put"))
    rows = t.part.select("p_partkey", "p_brand", F.nullif("p_name", F.lit("red plate")).alias("p_name"), "p_type")
    rows = op.find_replace(rows, "p_name", entries, "find", "put")
    return op.find_replace(rows, "p_type", types, "p_type", "put", whole=True)


_PRICED = "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS price FROM orders"


@query("tile_bucket", f"""
WITH o AS ({_PRICED}),
w AS (SELECT *, CAST(coalesce(price, 0) AS DECIMAL(28, 6)) AS x FROM o),
s AS (SELECT *, sum(x) OVER (ORDER BY price NULLS FIRST, o_orderkey, o_orderstatus ROWS UNBOUNDED PRECEDING) - x AS upto, sum(x) OVER () AS total,
  sum(x) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - x AS upto_key, sum(x) OVER (PARTITION BY o_orderstatus) AS total_key, min(price) OVER () AS lo, max(price) OVER () AS hi FROM w)
SELECT o_orderkey, o_orderstatus, price, CAST(ntile(7) OVER (ORDER BY price NULLS FIRST, o_orderkey) AS INTEGER) AS by_count,
  CAST(least(10, 1 + CAST(upto * 1000000 AS HUGEINT) * 10 // CAST(total * 1000000 AS HUGEINT)) AS INTEGER) AS by_sum,
  CAST(least(4, 1 + CAST(upto_key * 1000000 AS HUGEINT) * 4 // CAST(total_key * 1000000 AS HUGEINT)) AS INTEGER) AS by_sum_of_status,
  CASE WHEN price IS NOT NULL THEN CAST(least(20, 1 + floor((price - lo) * 20 / (hi - lo))) AS INTEGER) END AS by_width
FROM s""")
def tile_bucket(t: Tables) -> DataFrame:
    price = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice"))
    rows = t.orders.select("o_orderkey", "o_orderstatus", price.alias("price"))
    order = ["price", "o_orderkey"]
    tiled = op.tile(rows, 7, "by_count", order_by=order)
    tiled = op.tile(tiled, 10, "by_sum", "sum", "price", [*order, "o_orderstatus"])
    tiled = op.tile(tiled, 4, "by_sum_of_status", "sum", "price", ["o_orderkey"], ["o_orderstatus"])
    return op.tile(tiled, 20, "by_width", "width", "price")


@query("ts_fill", """
WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day,
  nullif(o_orderpriority, '1-URGENT') AS priority, o_totalprice AS price FROM orders),
f AS (SELECT *, lead(day) OVER w AS following, last_value(priority IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS known FROM o WHERE day IS NOT NULL
  WINDOW w AS (PARTITION BY o_custkey ORDER BY day, o_orderkey)),
g AS (SELECT *, unnest(generate_series(1, (following - day - 1) // 30)) AS k FROM f)
SELECT o_orderkey, o_custkey, day, known AS priority, price, FALSE AS is_new FROM f
UNION ALL SELECT *, FALSE FROM o WHERE day IS NULL
UNION ALL SELECT NULL, o_custkey, day + CAST(30 * k AS INTEGER), known, NULL, TRUE FROM g""")
def ts_fill(t: Tables) -> DataFrame:
    """Every customer's orders, and a row for every thirty days without one, with the last known priority."""
    day = F.when(~((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")), F.col("o_orderdate").cast("date"))
    rows = t.orders.select("o_orderkey", "o_custkey", day.alias("day"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("priority"), F.col("o_totalprice").alias("price"))
    return op.ts_fill(rows, ["o_custkey"], "day", (30, "day"), carried=["priority"], filled="is_new")


def _profiled(name: str, kind: str, col: str) -> str:
    """One column's profile with exact sketches; doubles and counts are compared, errors only bounded."""
    real = kind in ("int64", "float64")
    mean = f"round(avg({col}), 4)" if real else "CAST(NULL AS DOUBLE)"
    return f"""
SELECT '{name}' AS name, '{kind}' AS type, count(*) AS rows, count(*) - count({col}) AS nulls, round(1 - count({col}) / count(*), 9) AS null_pct,
  CAST(min({col}) AS VARCHAR) AS min, CAST(max({col}) AS VARCHAR) AS max, {mean} AS mean, TRUE AS distinct_close,
  {'10' if real else '0'} AS bins, {f'count({col})' if real else '0'} AS in_bins, CASE WHEN count(DISTINCT {col}) <= 1000 THEN (SELECT max(n) FROM (SELECT count(*) AS n FROM p WHERE {col} IS NOT NULL GROUP BY {col})) END AS most
FROM p"""


_PROFILED = [("o_orderkey", "int64", "o_orderkey"), ("status", "string", "status"), ("price", "float64", "price"), ("day", "date", "day"), ("large", "bool", "large")]


@query("column_profile", """
WITH p AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, CASE WHEN o_orderpriority <> '5-LOW' THEN round(o_totalprice) + 0.5 END AS price,
  CAST(o_orderdate AS DATE) AS day, o_totalprice > 200000 AS large FROM orders)""" + " UNION ALL ".join(_profiled(*c) for c in _PROFILED))
def column_profile(t: Tables) -> DataFrame:
    """Exact figures of every column, and whether the sketches keep their bounds."""
    rows = t.orders.select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.when(F.col("o_orderpriority") != "5-LOW", F.round("o_totalprice") + 0.5).alias("price"),
        F.col("o_orderdate").cast("date").alias("day"), (F.col("o_totalprice") > 200000).alias("large"))
    exact = rows.agg(*(F.count_distinct(c).alias(c) for c in rows.columns))
    told = exact.unpivot([], rows.columns, "of", "exactly")
    found = op.column_profile(rows)
    joined = found.join(F.broadcast(told), F.col("name") == F.col("of"))
    close = F.abs(F.col("distinct") - F.col("exactly")) <= F.col("exactly") * 0.1
    return joined.select(
        "name", "type", "rows", "nulls", F.round("null_pct", 9).alias("null_pct"), "min", "max", F.round("mean", 4).alias("mean"), close.alias("distinct_close"),
        F.size("histogram").cast("int").alias("bins"), F.aggregate("histogram", F.lit(0).cast("bigint"), lambda acc, b: acc + b["count"]).alias("in_bins"),
        F.when(F.col("exactly") <= 1000, F.get("frequent", F.lit(0))["count"]).alias("most"))


@query("agg_concat", """
WITH o AS (SELECT *, CASE WHEN o_orderkey % 5 > 0 AND o_custkey % 7 > 0 THEN o_orderpriority END AS p, nullif(o_orderstatus, 'P') AS s FROM orders)
SELECT 'customer' AS of, CAST(o_custkey AS VARCHAR) AS "group", string_agg(p, '; ' ORDER BY o_orderdate DESC NULLS FIRST, p) AS texts FROM o GROUP BY o_custkey
UNION ALL
SELECT 'status', s, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY p NULLS FIRST, o_totalprice DESC NULLS FIRST, CAST(o_orderkey AS VARCHAR)) FROM o GROUP BY s""")
def agg_concat(t: Tables) -> DataFrame:
    """Priorities per customer, and all order keys per status, each as one text."""
    priority = F.when((F.col("o_orderkey") % 5 > 0) & (F.col("o_custkey") % 7 > 0), F.col("o_orderpriority"))
    rows = t.orders.withColumn("p", priority).withColumn("s", F.nullif("o_orderstatus", F.lit("P")))
    small = op.concat_text(rows, ["o_custkey"], "p", [("o_orderdate", "desc")], "texts", "; ")
    large = op.concat_text(rows, ["s"], "o_orderkey", ["p", ("o_totalprice", "desc")], "texts", ",")
    small = small.select(F.lit("customer").alias("of"), F.col("o_custkey").cast("string").alias("group"), "texts")
    return small.unionByName(large.select(F.lit("status").alias("of"), F.col("s").alias("group"), "texts"))


_SIZES = {"R": 100, "A": 4000, None: 2500}


@query("over_undersample", """
WITH l AS (SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS flag, l_linestatus AS mode FROM lineitem),
n AS (SELECT *, CAST(CASE flag WHEN 'R' THEN 100 WHEN 'A' THEN 4000 ELSE 2500 END AS BIGINT) AS size, count(*) OVER (PARTITION BY flag) AS total,
  row_number() OVER (PARTITION BY flag ORDER BY md5(concat_ws('|', '9', l_orderkey, l_linenumber))) AS place FROM l)
SELECT l_orderkey, l_linenumber, flag, mode FROM (SELECT *, unnest(range(size // total + CASE WHEN place <= size % total THEN 1 ELSE 0 END)) FROM n)""")
def over_undersample(t: Tables) -> DataFrame:
    """Return flags at sizes of their own: some classes shrink, others (on small tables) grow."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_returnflag", F.lit("N")).alias("flag"), F.col("l_linestatus").alias("mode"))
    return op.resample_classes(rows, "flag", _SIZES, seed=9, keys=["l_orderkey", "l_linenumber"])


@query("bad_data_policy", """
WITH c AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'n/a' WHEN o_orderpriority = '5-LOW' THEN '  ' ELSE 'fine' END AS price, o_totalprice,
  CASE WHEN o_orderstatus = 'P' THEN '?' WHEN o_orderstatus = 'F' THEN NULL ELSE 'yes' END AS open FROM orders),
r AS (SELECT *, CASE WHEN price = 'fine' THEN o_totalprice END AS value, concat_ws('; ', CASE WHEN price = 'n/a' THEN 'price float64 n/a' END, CASE WHEN open = '?' THEN 'open bool ?' END) AS reason FROM c)
SELECT 'null' AS policy, o_orderkey, value AS price, CASE WHEN open = 'yes' THEN TRUE END AS open, CAST(NULL AS VARCHAR) AS reason FROM r
UNION ALL SELECT 'drop', o_orderkey, value, CASE WHEN open = 'yes' THEN TRUE END, NULL FROM r WHERE reason = ''
UNION ALL SELECT 'rejected', o_orderkey, NULL, NULL, reason FROM r WHERE reason <> ''""")
def bad_data_policy(t: Tables) -> DataFrame:
    """Typed rows with bad cells null, typed rows without bad cells, and the rejected rows with their reasons."""
    cells = t.orders.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "n/a").when(F.col("o_orderpriority") == "5-LOW", "  ").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(F.col("o_orderstatus") == "P", "?").when(F.col("o_orderstatus") != "F", "yes").alias("open"))
    types = {"o_orderkey": "int64", "price": "float64", "open": "bool"}
    kept, dropped = (src.checked_text(cells, types, p) for p in ("null", "drop"))
    out = [c.good.select(F.lit(p).alias("policy"), "*", F.lit(None).cast("string").alias("reason")) for p, c in (("null", kept), ("drop", dropped))]
    told = F.array_join(F.transform("reasons", lambda r: F.concat_ws(" ", r["column"], r["type"], r["value"])), "; ")
    none = {c: F.lit(None).cast(k) for c, k in (("price", "double"), ("open", "boolean"))}
    rejected = dropped.rejected.select(F.lit("rejected").alias("policy"), F.col("o_orderkey").cast("bigint").alias("o_orderkey"), *[v.alias(c) for c, v in none.items()], told.alias("reason"))
    return out[0].unionByName(out[1]).unionByName(rejected)


@query("src_partitioned", """
WITH o AS (SELECT o_orderkey, o_totalprice, nullif(o_orderstatus, 'P') AS status, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders),
named AS (SELECT year FROM o GROUP BY year HAVING count(*) % 2 = 0 OR year = (SELECT min(year) FROM o))
SELECT o_orderkey, CASE WHEN status = 'F' AND year % 2 = 0 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice, status, year
FROM o WHERE year IN (SELECT year FROM named)""")
def src_partitioned(t: Tables) -> DataFrame:
    """Orders by status and year: some partitions replaced, then only the years that a joined table names are read."""
    rows = t.orders.select("o_orderkey", "o_totalprice", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.year("o_orderdate").alias("year"))
    path = t.scratch("src_partitioned")
    src.write_partitioned(rows, path, ["status", "year"])
    changed = rows.where("status = 'F' and year % 2 = 0").withColumn("o_totalprice", -F.col("o_totalprice"))
    src.write_partitioned(changed, path, ["status", "year"], mode="replace")
    named = rows.groupBy("year").agg(F.count("*").alias("n"))
    named = named.crossJoin(F.broadcast(rows.agg(F.min("year").alias("least")))).where("n % 2 = 0 or year = least").select("year")
    return src.read_partitioned(t.spark, path).join(named, "year", "left_semi").select("o_orderkey", "o_totalprice", "status", "year")
