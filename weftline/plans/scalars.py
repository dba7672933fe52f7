"""One query per expression form and scalar function."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import functions as fx
from weftline.plans.registry import Tables, query

KEYS = {
    "orders": ["o_orderkey"], "part": ["p_partkey"], "customer": ["c_custkey"], "documents": ["doc_id"],
    "events": ["event_id"], "lineitem": ["l_orderkey", "l_linenumber"], "pages": ["page_id"],
}


def scalar(name: str, table: str, sql: dict[str, str], columns: Callable[[], dict[str, Column]], source: str = "") -> None:
    """A query that adds computed columns to a table's key."""
    keys = KEYS[table]
    computed = ", ".join(f"{expr} AS {alias}" for alias, expr in sql.items())

    @query(name, f"SELECT {', '.join(keys)}, {computed} FROM {source or table}")
    def run(t: Tables) -> DataFrame:
        return getattr(t, table).select(*keys, *[c.alias(n) for n, c in columns().items()])


def _null_if(column: str, value) -> Column:
    return F.nullif(F.col(column), F.lit(value))


scalar("expr_arith", "part", {
    "plus": "p_size + 10", "minus": "p_retailprice - p_size", "times": "p_size * 3", "unknown": "p_size + nullif(p_size, 7)",
    "joined": "p_name || '/' || p_brand", "text": "p_name || CAST(nullif(p_size, 7) AS VARCHAR)",
}, lambda: {
    "plus": fx.add("p_size", 10), "minus": fx.subtract("p_retailprice", "p_size"), "times": fx.multiply("p_size", 3),
    "unknown": fx.add("p_size", _null_if("p_size", 7)), "joined": fx.concat("p_name", F.lit("/"), "p_brand"),
    "text": fx.add("p_name", _null_if("p_size", 7), text=True),
})

scalar("expr_divide", "part", {
    "ratio": "round(p_retailprice / p_size, 6)",
    "over_zero": "CASE WHEN p_size % 5 = 0 THEN CASE WHEN p_size < 20 THEN '-inf' WHEN p_size > 20 THEN 'inf' ELSE 'nan' END ELSE 'number' END",
    "unknown": "CASE WHEN p_size = 7 THEN NULL ELSE p_size / 4 END",
}, lambda: {
    "ratio": F.round(fx.divide("p_retailprice", "p_size"), 6),
    "over_zero": _kind(fx.divide(F.col("p_size") - 20, F.col("p_size") % 5)),
    "unknown": fx.divide(_null_if("p_size", 7), 4),
})


def _kind(x: Column) -> Column:
    return (
        F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise("number")
    )


_MOD = "(({a} % nullif({b}, 0)) + nullif({b}, 0)) % nullif({b}, 0)"

scalar("expr_mod", "part", {
    "up": _MOD.format(a="(p_size - 25)", b="7"), "down": _MOD.format(a="(p_size - 25)", b="(-7)"),
    "by_zero": _MOD.format(a="p_partkey", b="(p_size % 3)"),
}, lambda: {
    "up": fx.mod(F.col("p_size") - 25, 7), "down": fx.mod(F.col("p_size") - 25, -7),
    "by_zero": fx.mod("p_partkey", F.col("p_size") % 3),
})

scalar("expr_negate", "part", {"negative": "-p_size", "unknown": "-nullif(p_retailprice, 900.0)"}, lambda: {
    "negative": fx.negate("p_size"), "unknown": fx.negate(_null_if("p_retailprice", 900.0)),
})

scalar("expr_compare", "part", {
    "eq": "p_size = 7", "ne": "p_size <> 7", "lt": "p_size < 7", "gt": "p_size > 7", "le": "p_size <= 7", "ge": "nullif(p_size, 7) >= 7",
    "text_number": "TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) > p_size", "no_number": "CAST(NULL AS BOOLEAN)",
}, lambda: {
    **{n: fx.compare("p_size", s, 7) for n, s in {"eq": "==", "ne": "<>", "lt": "<", "gt": ">", "le": "<="}.items()},
    "ge": fx.compare(_null_if("p_size", 7), ">=", 7),
    "text_number": fx.compare(fx.replace("p_brand", "Brand#", ""), ">", "p_size", numeric=True),
    "no_number": fx.compare("p_brand", ">", 3, numeric=True),
})

scalar("expr_logic", "part", {
    "both": "(nullif(p_size, 7) > 20) AND p_type = 'SMALL'", "either": "(nullif(p_size, 7) > 20) OR p_type = 'SMALL'",
    "inverse": "NOT (nullif(p_size, 7) > 20)",
}, lambda: {
    "both": (_null_if("p_size", 7) > 20) & (F.col("p_type") == "SMALL"),
    "either": (_null_if("p_size", 7) > 20) | (F.col("p_type") == "SMALL"),
    "inverse": ~(_null_if("p_size", 7) > 20),
})

scalar("expr_if", "part", {
    "size_class": "CASE WHEN nullif(p_size, 7) < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END",
    "no_else": "CASE WHEN p_size < 10 THEN 'small' END",
}, lambda: {
    "size_class": fx.case_if((_null_if("p_size", 7) < 10, "small"), (F.col("p_size") < 30, "medium"), otherwise="large"),
    "no_else": fx.case_if((F.col("p_size") < 10, "small")),
})

scalar("fn_trim", "part", {"trimmed": "p_name"}, lambda: {
    "trimmed": fx.trim(F.concat(F.lit(" \t "), "p_name", F.lit("\r\n "))),
})
scalar("fn_upper", "documents", {"loud": "upper(replace(text, 'ß', 'SS'))"}, lambda: {"loud": fx.upper("text")})
scalar("fn_lower", "documents", {"quiet": "lower(text)"}, lambda: {"quiet": fx.lower("text")})
scalar("fn_length", "documents", {
    "chars": "CAST(length(text) AS INTEGER)", "digits": "CAST(length(CAST(doc_id AS VARCHAR)) AS INTEGER)",
}, lambda: {
    "chars": fx.length("text"), "digits": fx.length("doc_id"),
})
scalar("fn_substring", "customer", {
    "rest": "substring(c_name, 10)", "two": "substring(c_name, 3, 2)", "tail": "right(c_name, 4)", "inner": "left(right(c_name, 4), 2)",
}, lambda: {
    "rest": fx.substring("c_name", 9), "two": fx.substring("c_name", 2, 2), "tail": fx.substring("c_name", -4),
    "inner": fx.substring("c_name", -4, 2),
})
scalar("fn_contains", "documents", {"found": "contains(text, 'th')", "literal": "contains(text, '.*')"}, lambda: {
    "found": fx.contains("text", "th"), "literal": fx.contains("text", ".*"),
})
scalar("fn_startswith", "pages", {"secure": "starts_with(url, 'https:')"}, lambda: {"secure": fx.starts_with("url", "https:")})
scalar("fn_endswith", "part", {"ring": "ends_with(p_name, 'ring')"}, lambda: {"ring": fx.ends_with("p_name", "ring")})
scalar("fn_replace", "pages", {"path": "replace(url, '/', ' / ')", "dots": "replace(url, '.', '')"}, lambda: {
    "path": fx.replace("url", "/", " / "), "dots": fx.replace("url", ".", ""),
})
scalar("fn_concat", "part", {
    "label": "p_brand || '-' || CAST(p_size AS VARCHAR)", "unknown": "p_name || nullif(p_type, 'SMALL')",
}, lambda: {
    "label": fx.concat("p_brand", F.lit("-"), "p_size"), "unknown": fx.concat("p_name", F.nullif("p_type", F.lit("SMALL"))),
})

scalar("fn_abs", "part", {"distance": "abs(p_size - 25)"}, lambda: {"distance": fx.abs_(F.col("p_size") - 25)})
scalar("fn_round", "orders", {
    "whole": "round(o_totalprice)", "tenth": "round(o_totalprice, 1)", "hundreds": "round(o_custkey, -2)",
    "half": "CAST(o_orderkey + 1 AS DOUBLE)",
}, lambda: {
    "whole": fx.round_("o_totalprice"), "tenth": fx.round_("o_totalprice", 1), "hundreds": fx.round_("o_custkey", -2),
    "half": fx.round_(F.col("o_orderkey") + F.lit(0.5)),
})
ODD_WHOLE = "CASE o_orderkey % 5 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE WHEN 3 THEN 1e30 END"


def _odd_number() -> Column:
    """NaN, both infinities, 1e30 and null in turn."""
    k = F.col("o_orderkey") % 5
    return F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).when(k == 3, 1e30)


scalar("fn_floor", "orders", {"low": "CAST(floor(o_totalprice) AS DOUBLE)", "below": "CAST(floor(-o_totalprice) AS DOUBLE)", "odd": ODD_WHOLE}, lambda: {
    "low": fx.floor("o_totalprice", like="double"), "below": fx.floor(-F.col("o_totalprice"), like="double"),
    "odd": fx.floor(_odd_number(), like="double"),
})
scalar("fn_ceil", "orders", {"high": "CAST(ceil(o_totalprice) AS DOUBLE)", "above": "CAST(ceil(-o_totalprice) AS DOUBLE)", "odd": ODD_WHOLE}, lambda: {
    "high": fx.ceil("o_totalprice", like="double"), "above": fx.ceil(-F.col("o_totalprice"), like="double"),
    "odd": fx.ceil(_odd_number(), like="double"),
})
scalar("fn_pow", "part", {"square": "CAST(pow(p_size, 2) AS BIGINT)", "large": "list_reduce(list_concat([1::BIGINT], list_transform(range(p_size % 40), lambda i: 3::BIGINT)), lambda a, b: a * b)", "half": "round(pow(p_retailprice, 0.5), 8)"}, lambda: {
    "square": fx.pow_("p_size", 2, like="bigint"), "large": fx.pow_(F.lit(3), F.col("p_size") % 40, like="bigint"), "half": F.round(fx.pow_("p_retailprice", 0.5), 8),
})
scalar("fn_sqrt", "part", {"root": "round(sqrt(p_retailprice), 8)", "none": "p_size < 25"}, lambda: {
    "root": F.round(fx.sqrt("p_retailprice"), 8), "none": F.isnan(fx.sqrt(F.col("p_size") - 25)),
})
scalar("fn_mod", "orders", {"rest": _MOD.format(a="(o_custkey - 500)", b="13")}, lambda: {"rest": fx.mod(F.col("o_custkey") - 500, 13)})
scalar("fn_min", "lineitem", {
    "least": "least(l_discount, l_tax, l_quantity)", "known": "least(nullif(l_discount, 0), nullif(l_tax, 0))", "one": "l_tax",
}, lambda: {
    "least": fx.min_("l_discount", "l_tax", "l_quantity"), "known": fx.min_(_null_if("l_discount", 0), _null_if("l_tax", 0)),
    "one": fx.min_("l_tax"),
})
scalar("fn_max", "lineitem", {
    "most": "greatest(l_discount, l_tax, l_quantity)", "known": "greatest(nullif(l_discount, 0), nullif(l_tax, 0))", "one": "l_tax",
}, lambda: {
    "most": fx.max_("l_discount", "l_tax", "l_quantity"), "known": fx.max_(_null_if("l_discount", 0), _null_if("l_tax", 0)),
    "one": fx.max_("l_tax"),
})

scalar("fn_isnull", "lineitem", {"missing": "nullif(l_discount, 0) IS NULL"}, lambda: {"missing": fx.is_null(_null_if("l_discount", 0))})
scalar("fn_isnotnull", "lineitem", {"present": "nullif(l_discount, 0) IS NOT NULL"}, lambda: {
    "present": fx.is_not_null(_null_if("l_discount", 0)),
})
scalar("fn_coalesce", "lineitem", {
    "rate": "coalesce(nullif(l_discount, 0), nullif(l_tax, 0), -1)", "label": "coalesce(nullif(l_returnflag, 'N'), CAST(l_linenumber AS VARCHAR))",
}, lambda: {
    "rate": fx.coalesce(_null_if("l_discount", 0), _null_if("l_tax", 0), -1),
    "label": fx.coalesce(_null_if("l_returnflag", "N"), "l_linenumber", as_type="string"),
})

scalar("fn_tostring", "orders", {
    "custkey": "CAST(o_custkey AS VARCHAR)", "price": "CAST(o_totalprice AS VARCHAR)", "day": "CAST(CAST(o_orderdate AS DATE) AS VARCHAR)",
}, lambda: {
    "custkey": fx.to_string("o_custkey"), "price": fx.to_string("o_totalprice"), "day": fx.to_string(F.to_date("o_orderdate")),
})
scalar("fn_tonumber", "part", {"brand": "TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE)", "none": "TRY_CAST(p_name AS DOUBLE)", "suffix": "CASE WHEN p_size = 7 THEN 7.0::DOUBLE END"}, lambda: {
    "suffix": fx.to_number(F.when(F.col("p_size") == 7, "7").when(F.col("p_size") % 2 == 0, F.concat("p_size", F.lit("d"))).otherwise("0x1p3")),
    "brand": fx.to_number(fx.replace("p_brand", "Brand#", "")), "none": fx.to_number("p_name"),
})
scalar("fn_toint", "part", {"cut": "CAST(trunc(p_retailprice) AS BIGINT)", "none": "TRY_CAST(p_name AS BIGINT)"}, lambda: {
    "cut": fx.to_int("p_retailprice"), "none": fx.to_int("p_name"),
})

scalar("fn_now", "orders", {"past": "o_orderdate < CAST(now() AS TIMESTAMP)"}, lambda: {"past": F.col("o_orderdate") < fx.now()})
scalar("fn_today", "orders", {"past": "CAST(o_orderdate AS DATE) < current_date"}, lambda: {"past": F.to_date("o_orderdate") < fx.today()})
scalar("fn_year", "orders", {"y": "CAST(year(o_orderdate) AS INTEGER)"}, lambda: {"y": fx.year("o_orderdate")})
scalar("fn_month", "orders", {"m": "CAST(month(o_orderdate) AS INTEGER)"}, lambda: {"m": fx.month("o_orderdate")})
scalar("fn_day", "events", {"d": "CAST(day(ts) AS INTEGER)"}, lambda: {"d": fx.day("ts")})
