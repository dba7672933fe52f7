"""Registered queries on skewed tables, with the hot-key limits lowered so that every split path runs.

A third of the orders belong to one customer, a third of the events to one user
(some to none), and half of the line items are copies of one row.
"""
import importlib
import inspect
import pkgutil

import duckdb
import pytest
from conftest import SF_DIR
from oracle import TABLES, compare, connect

import __spark_entry__ as entry
import weftline.operators as op

SKEWED = {
    "orders": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey, o_orderstatus,
                        o_totalprice, o_orderdate, o_orderpriority FROM s""",
    "events": """SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS user_id,
                        event_type, value, props FROM s""",
    "lineitem": "SELECT * FROM s UNION ALL (SELECT s.* FROM (SELECT * FROM s ORDER BY ALL LIMIT 1) s, range(4000))",
}

QUERIES = [
    "join_inner", "join_left_only", "join_right_only", "agg_count_distinct", "agg_median", "agg_first", "agg_last", "agg_global",
    "asof_join", "sql_cross_theta", "crosstab_first", "sample_first", "sample_last", "sample_every_n", "sample_random_n",
    "sample_random_pct", "unique_rows", "duplicate_rows", "sql_outer_join", "sql_semi_anti", "sql_set_ops", "sql_subquery",
    "sql_window_frame", "sql_window_rank", "sql_window_analytic", "qualify", "python_groups", "python_aggregate", "udaf",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE OR REPLACE VIEW s AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
        con.execute(f"COPY ({SKEWED.get(name, 'SELECT * FROM s')}) TO '{out}/{name}.parquet' (FORMAT parquet)")
    return str(out)


@pytest.fixture(scope="module")
def low_limits():
    """Every default of `hot_rows` and `rows_per_bucket` becomes 200 for these tests."""
    kept = []
    for info in pkgutil.iter_modules(op.__path__):
        module = importlib.import_module(f"weftline.operators.{info.name}")
        for member in vars(module).values():
            fn = member.__init__ if inspect.isclass(member) else member
            if inspect.isfunction(fn) and fn.__module__ == module.__name__ and fn.__defaults__:
                names = [p.name for p in inspect.signature(fn).parameters.values() if p.default is not inspect.Parameter.empty]
                kept.append((fn, fn.__defaults__))
                fn.__defaults__ = tuple(
                    200 if n in ("hot_rows", "rows_per_bucket") else d for n, d in zip(names, fn.__defaults__)
                )
    yield
    for fn, defaults in kept:
        fn.__defaults__ = defaults


@pytest.mark.parametrize("name", QUERIES)
def test_skewed(spark, folder, low_limits, name):
    con = connect(folder)
    assert compare(spark, con, folder, entry.queries()[name], entry.oracle_sql()[name]) == ""
