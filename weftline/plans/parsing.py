"""Splitting, regular expressions, dates and JSON."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import operators as op
from weftline.plans.registry import Tables, query


@query("split_to_columns", r"""
SELECT page_id, split_part(url, '/', 1) AS part1, CASE WHEN n > 1 THEN split_part(url, '/', 2) END AS part2,
       CASE WHEN n > 2 THEN split_part(url, '/', 3) END AS part3,
       CASE WHEN n > 3 THEN array_to_string(string_split(url, '/')[4:], '/') END AS part4
FROM (SELECT *, len(string_split(url, '/')) AS n FROM pages)""")
def split_to_columns(t: Tables) -> DataFrame:
    return op.split_to_columns(t.pages.select("page_id", "url"), "url", "/", 4, "part")


@query("split_to_rows", "SELECT doc_id, unnest(string_split(text, '. ')) AS text FROM documents")
def split_to_rows(t: Tables) -> DataFrame:
    return op.split_to_rows(t.documents.select("doc_id", "text"), "text", ". ")


@query("regex_parse", r"""
SELECT page_id, url, CASE WHEN m THEN regexp_extract(url, p, 1) END AS scheme,
       CASE WHEN m THEN regexp_extract(url, p, 2) END AS host,
       nullif(CASE WHEN m THEN regexp_extract(url, p, 3) END, '') AS "3", CASE WHEN m THEN regexp_extract(url, p, 4) END AS "4"
FROM (SELECT *, regexp_matches(url, p) AS m
      FROM (SELECT page_id, url, '^(https?)://([^/]+\.com)(?:/([a-z]{2})/)?([0-3]*)' AS p FROM pages))""")
def regex_parse(t: Tables) -> DataFrame:
    return op.regex_parse(t.pages.select("page_id", "url"), "url", r"^(?<scheme>https?)://(?P<host>[^/]+\.com)(?:/([a-z]{2})/)?([0-3]*)")


@query("regex_match", r"SELECT doc_id, regexp_matches(text, '[0-9]{3,}') AS numbers FROM documents")
def regex_match(t: Tables) -> DataFrame:
    return op.regex_match(t.documents.select("doc_id", "text"), "text", "[0-9]{3,}", "numbers").drop("text")


@query("regex_replace", r"SELECT page_id, regexp_replace(url, '([a-z]+)://([^/]+)', '\2 (\1)', 'g') AS url FROM pages")
def regex_replace(t: Tables) -> DataFrame:
    return op.regex_replace(t.pages.select("page_id", "url"), "url", "([a-z]+)://([^/]+)", "$2 ($1)")


@query("regex_tokenize", r"""
SELECT doc_id, unnest(CASE WHEN len(found) = 0 THEN [NULL] ELSE found END) AS text
FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS found FROM documents)""")
def regex_tokenize(t: Tables) -> DataFrame:
    return op.regex_tokenize(t.documents.select("doc_id", "text"), "text", "[0-9]+")


@query("datetime_parse_date", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def datetime_parse_date(t: Tables) -> DataFrame:
    """Unpadded month/day/year text, with words among the dates."""
    written = t.orders.select("o_orderkey", F.when(
        F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "M/d/yyyy")).otherwise("pending").alias("day"))
    return op.datetime_parse(written, "day", "%m/%d/%Y")


@query("datetime_parse_ts", "SELECT event_id, date_trunc('second', ts) AS at FROM events")
def datetime_parse_ts(t: Tables) -> DataFrame:
    written = t.events.select("event_id", F.date_format("ts", "dd.MM.yyyy HH:mm:ss").alias("at"))
    return op.datetime_parse(written, "at", "%d.%m.%Y %H:%M:%S", "datetime")


@query("datetime_parse_infer", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def datetime_parse_infer(t: Tables) -> DataFrame:
    """Three spellings in one column."""
    written = t.orders.select("o_orderkey", F.when(
        F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy/MM/dd")
    ).when(
        F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "d-M-yyyy")
    ).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"))
    return op.datetime_parse(written, "day")


@query("datetime_format", """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS ts, strftime(ts, '%a %d %B %Y, %I:%M:%S %p (%j)') AS long FROM events""")
def datetime_format(t: Tables) -> DataFrame:
    events = t.events.select("event_id", "ts")
    long = op.datetime_format(events, "ts", "%a %d %B %Y, %I:%M:%S %p (%j)", "long")
    return op.datetime_format(long, "ts")


@query("json_parse", "SELECT event_id, event_type, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
def json_parse(t: Tables) -> DataFrame:
    return op.json_parse(t.events.select("event_id", "event_type", "props"), "props")


@query("json_parse_nonobject", """
SELECT event_id, CASE WHEN user_id IS NOT NULL THEN CAST(props ->> '$.k' AS BIGINT) END AS first, user_id AS second
FROM events""")
def json_parse_nonobject(t: Tables) -> DataFrame:
    """Array documents, parsed to a list column."""
    lists = t.events.select(
        "event_id", F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit(","), F.col("user_id").cast("string"), F.lit("]")).alias("pair")
    )
    parsed = op.json_parse(lists, "pair")
    return parsed.select("event_id", F.get("pair_parsed", F.lit(0)).alias("first"), F.get("pair_parsed", F.lit(1)).alias("second"))


@query("xml_parse", """
WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus <> 'P' AND o_orderkey % 17 <> 0 AS fine FROM orders)
SELECT o_orderkey, CASE WHEN fine THEN o_custkey END AS customer, CASE WHEN fine AND o_custkey % 3 <> 0 THEN o_totalprice END AS total,
  CASE WHEN fine THEN o_orderpriority END AS first_tag, CASE WHEN fine THEN 1 + o_custkey % 2 END AS tags,
  CASE WHEN fine AND o_custkey % 5 = 0 THEN 'a & b <' || o_orderkey || '>' END AS note, CASE WHEN fine AND o_custkey % 5 = 0 THEN o_orderkey % 10 END AS rank,
  CASE WHEN fine THEN o_custkey % 2 = 0 END AS open FROM o""")
def xml_parse(t: Tables) -> DataFrame:
    """Orders as XML texts with attributes, repeated elements and left-out ones, some null, some broken, to columns again."""
    key, customer = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = F.concat(
        F.lit('<order customer="'), customer, F.lit('">'),
        F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("<total>"), F.col("o_totalprice").cast("string"), F.lit("</total>"))).otherwise(""),
        F.lit("<tag>"), F.col("o_orderpriority"), F.lit("</tag>"), F.when(F.col("o_custkey") % 2 == 1, "<tag>again</tag>").otherwise(""),
        F.when(F.col("o_custkey") % 5 == 0, F.concat(F.lit('<note rank="'), (F.col("o_orderkey") % 10).cast("string"), F.lit('">a &amp; b &lt;'), key, F.lit("&gt;</note>"))).otherwise(""),
        F.lit("<open>"), (F.col("o_custkey") % 2 == 0).cast("string"), F.lit("</open>"), F.when(F.col("o_orderkey") % 17 == 0, "<order>").otherwise("</order>"))
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", text).alias("text"))
    out = op.xml_parse(rows, "text", on_error="null")
    tags = F.col("tag")
    return out.select(
        "o_orderkey", F.col("_customer").alias("customer"), "total", tags[0].alias("first_tag"), F.when(tags.isNotNull(), F.size(tags)).cast("bigint").alias("tags"),
        F.col("note._VALUE").alias("note"), F.col("note._rank").alias("rank"), "open")
