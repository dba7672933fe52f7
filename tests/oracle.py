"""Run registered queries and compare them with their SQL in DuckDB."""
from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, Decimal):
        return ("decimal", str(v))
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return repr(v)
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=lambda r: [(v is not None, str(v)) for v in r])


KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
}


def compare(spark, con, folder, run, sql) -> str:
    """Empty when equal, else what differs."""
    df = run(spark, folder)
    got = df.collect()
    if sql is None:
        return ""
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    types = {d[0]: str(d[1]) for d in res.description}
    want = res.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    odd = {c: (t, types[c]) for c, t in df.dtypes if KINDS.get(types[c]) not in (t, None)}
    note = f"types {odd}; " if odd else ""
    if len(got) != len(want):
        return f"{note}{len(got)} rows != {len(want)}"
    a, b = canonical(df.columns, got), canonical(names, want)
    for x, y in zip(a, b):
        if x != y:
            return f"{note}{x} != {y}"[:600]
    return note


def main(folder: str, *only: str) -> None:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from weftline import build_session

    spark = build_session("oracle", master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            diff = compare(spark, con, folder, run, oracles.get(name))
        except Exception as error:
            diff = f"ERROR {type(error).__name__}: {str(error)[:900]}"
        bad += bool(diff)
        print(f"{'ok ' if not diff else 'BAD'} {name:28} {time.time() - start:6.2f}s {diff}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main(*sys.argv[1:])
