import datetime as dt
import json
import os

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from weftline import sources as src
from weftline.operators import filter_split
from weftline.statements import bare_statement
from weftline.sources.database import WRITE_MODES, Connection, Slices, from_environment
from weftline.streaming import run_available


@pytest.fixture
def mixed(spark):
    rows = [
        (1, 'say "hi", you', 1.5, True, dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5, 678901)),
        (2, None, None, None, None, None),
        (3, "päö", -2.25, False, dt.date(1999, 12, 31), dt.datetime(1999, 12, 31)),
    ]
    return spark.createDataFrame(rows, "id bigint, t string, x double, b boolean, d date, ts timestamp_ntz")


def test_csv_round_trip(spark, mixed, tmp_path):
    path = str(tmp_path / "deep" / "csv")
    assert src.write_csv(mixed, path) is mixed
    src.write_csv(mixed, path)  # replaces
    assert rows_of(src.read_csv(spark, path, schema=mixed.schema)) == rows_of(mixed)
    guessed = src.read_csv(spark, path)
    assert dict(guessed.dtypes) == {"id": "bigint", "t": "string", "x": "double", "b": "boolean", "d": "string", "ts": "string"}


def test_csv_quotes_header_delimiter(spark, tmp_path):
    file = tmp_path / "events.csv"
    file.write_text('id;payload;zip\n1;"{""user"": ""ada; x"", ""score"": 3}";007\n2;;12\n')
    out = src.read_csv(spark, str(file), delimiter=";")
    assert [tuple(r) for r in out.collect()] == [(1, '{"user": "ada; x", "score": 3}', 7), (2, None, 12)]
    bare = tmp_path / "bare.csv"
    bare.write_text("1,a\n2,b\n")
    assert src.read_csv(spark, str(bare), has_header=False).columns == ["column_1", "column_2"]


def test_csv_value_that_does_not_fit_fails(spark, tmp_path):
    file = tmp_path / "late.csv"
    file.write_text("n\n" + "1\n" * 150 + "oops\n")
    assert dict(src.read_csv(spark, str(file)).dtypes) == {"n": "string"}
    with pytest.raises(Exception):
        src.read_csv(spark, str(file), schema="n bigint").collect()
    kept = src.read_csv(spark, str(file), schema="n bigint", mode="PERMISSIVE")
    assert kept.where("n is null").count() == 1 and kept.count() == 151


def test_json_document_and_lines(spark, mixed, tmp_path):
    doc = tmp_path / "doc.json"
    doc.write_text(json.dumps([{"a": 1, "b": {"c": "x"}}, {"a": 2}], indent=1))
    out = src.read_json(spark, str(doc))
    assert out.columns == ["a", "b"] and out.count() == 2
    path = str(tmp_path / "lines")
    src.write_ndjson(mixed, path)
    assert rows_of(src.read_json(spark, path, lines=True, schema=mixed.schema)) == rows_of(mixed)
    text = [json.loads(r[0]) for r in spark.read.text(path).collect()]
    assert all(set(r) == set(mixed.columns) for r in text)


def test_parquet_pushdown(spark, mixed, tmp_path):
    path = str(tmp_path / "pq")
    src.write_parquet(mixed, path)
    plan = src.read_parquet(spark, path).where("id > 1").select("x")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,1)" in plan and "ReadSchema: struct<id:bigint,x:double>" in plan


def test_arrow_round_trip(spark, mixed, tmp_path):
    path = str(tmp_path / "arrow")
    many = mixed.repartition(3)
    src.write_arrow(many, path)
    back = src.read_arrow(spark, path)
    assert back.dtypes == mixed.dtypes and rows_of(back) == rows_of(mixed)
    assert rows_of(src.read_arrow(spark, path, columns=["ts", "id"])) == rows_of(mixed.select("ts", "id"))
    src.write_arrow(mixed.where("id = 1"), path)
    assert src.read_arrow(spark, path).count() == 1
    assert not [f for f in os.listdir(path) if f.startswith("_staging")]


def test_arrow_large_file_is_shared_among_tasks(spark, tmp_path):
    path = str(tmp_path / "big")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        src.write_arrow(spark.range(0, 5000, 1, 1), path)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    size = max(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".arrow"))
    out = src.read_arrow(spark, path, split_bytes=size // 5 + 100)
    assert 5 <= out.rdd.getNumPartitions() <= 6
    assert src.read_arrow(spark, path).rdd.getNumPartitions() == 1
    assert out.agg(F.sum("id"), F.count("id")).first() == (12497500, 5000)


def test_connection_options(monkeypatch):
    monkeypatch.setenv("DB_PW", "p;w")
    c = Connection("postgresql", "h", 0, "sales", "me", "${DB_PW}${NOT_SET}")
    assert c.options() == {"url": "jdbc:postgresql://h:5432/sales", "user": "me", "password": "p;w"}
    assert "p;w" not in repr(c) and "DB_PW" not in repr(c)
    assert Connection("sqlserver", "h", 99, "d").options()["url"] == "jdbc:sqlserver://h:99;databaseName=d"
    assert Connection("custom", uri=" jdbc:x:${DB_PW} ").options() == {"url": "jdbc:x:p;w"}
    for bad in (Connection("custom"), Connection("dbase")):
        with pytest.raises(ValueError):
            bad.options()
    assert bare_statement(" select 1 ; ;\n;") == "select 1" and from_environment("") == ""
    assert Slices("id", "0", "9", 4).options() == {
        "partitionColumn": "id", "lowerBound": "0", "upperBound": "9", "numPartitions": "4",
    }
    assert WRITE_MODES["create"] == "errorifexists"


def test_database_arguments(spark, customers):
    with pytest.raises(ValueError):
        src.read_database(spark, Connection(uri="jdbc:none:x"), " ; ")
    with pytest.raises(ValueError):
        src.probe_schema(spark, Connection(uri="jdbc:none:x"), "select 1")
    with pytest.raises(ValueError):
        src.write_database(customers, Connection(uri="jdbc:none:x"), " ")
    with pytest.raises(ValueError):
        src.write_database(customers, Connection(uri="jdbc:none:x"), "t", "upsert")


def test_stateless_stream_equals_batch(spark, customers, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    customers.where("id <= 4").write.parquet(inbox)

    def active(df):
        return filter_split(df, "status = 'active'").true

    for _ in range(2):  # the second run finds nothing new
        run_available(spark.readStream.schema(customers.schema).parquet(inbox), active, out, state)
    customers.where("id > 4").write.mode("append").parquet(inbox)
    run_available(spark.readStream.schema(customers.schema).parquet(inbox), active, out, state)
    assert rows_of(spark.read.parquet(out)) == rows_of(active(customers))


def test_arrow_folders(spark, tmp_path):
    base = str(tmp_path / "deep")
    src.write_arrow(spark.createDataFrame([(1, "a")], "id int, name string").coalesce(1), f"{base}/x=1")
    src.write_arrow(spark.createDataFrame([(2**40, 1.5)], "id bigint, score double").coalesce(1), f"{base}/y/z")
    src.write_arrow(spark.range(3), f"{base}/_hidden")
    both = src.read_arrow(spark, base)
    assert dict(both.dtypes) == {"id": "bigint", "name": "string", "score": "double"}
    assert rows_of(both.select("id", "name", "score")) == [(1, "a", None), (2**40, None, 1.5)]
    assert rows_of(src.read_arrow(spark, f"{base}/*/*.arrow")) == [(1, "a")]
    assert src.read_arrow(spark, f"{base}/[xy]*").count() == 2
    empty = str(tmp_path / "empty")
    src.write_arrow(both.limit(0), empty)
    back = src.read_arrow(spark, empty)
    assert back.count() == 0 and back.dtypes == both.dtypes
    src.write_arrow(both, empty)
    src.write_arrow(both.limit(0), empty)
    assert src.read_arrow(spark, empty).count() == 0
