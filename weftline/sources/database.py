"""Databases through Spark's JDBC source.

Drivers are jars on Spark's class path (`spark.jars`).
"""
from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, DataFrameReader, SparkSession

from weftline.statements import bare_statement
from weftline.types import logical_name

# Default port per database.
PORTS = {"sqlserver": 1433, "redshift": 5439, "oracle": 1521, "postgresql": 5432, "mysql": 3306}


def jdbc_address(dialect: str, host: str, port: int, database: str) -> str:
    """The JDBC address of a database on a server, or of a database file."""
    if dialect == "sqlite":
        return f"jdbc:sqlite:{database}"
    if dialect not in PORTS:
        raise ValueError(f"unknown database {dialect!r}")
    server = f"{host}:{port or PORTS[dialect]}"
    if dialect == "sqlserver":
        return f"jdbc:sqlserver://{server};databaseName={database}"
    if dialect == "oracle":
        return f"jdbc:oracle:thin:@//{server}/{database}"
    return f"jdbc:{dialect}://{server}/{database}"


WRITE_MODES = {"append": "append", "overwrite": "overwrite", "create": "errorifexists"}


def from_environment(text: str) -> str:
    """The text with the value of each ${NAME} in its place; an unset variable leaves nothing, other braces stay."""
    first, *rest = text.split("${")
    for part in rest:
        name, brace, after = part.partition("}")
        known = brace and name.isascii() and name.isidentifier()
        first += os.environ.get(name, "") + after if known else "${" + part
    return first


@dataclass(frozen=True)
class Connection:
    """Where a database is.  `uri` is a JDBC address and overrides the other fields."""

    dialect: str = "sqlserver"
    host: str = ""
    port: int = 0
    database: str = ""
    user: str = ""
    password: str = field(default="", repr=False)
    uri: str = ""
    driver: str = ""

    def options(self) -> dict[str, str]:
        own = self.uri.strip()
        if not own and self.dialect == "custom":
            raise ValueError("the custom dialect needs a uri")
        host, database, user, password = map(from_environment, (self.host, self.database, self.user, self.password))
        url = from_environment(own) if own else jdbc_address(self.dialect, host, self.port, database)
        out = {"url": url, "user": user, "password": password, "driver": self.driver}
        return {k: v for k, v in out.items() if v}


@dataclass(frozen=True)
class Slices:
    """Read in parallel: ranges of a numeric, date or timestamp column.

    The bounds only place the cuts; rows outside them are read as well.
    """

    column: str
    lower: str
    upper: str
    count: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column, "lowerBound": str(self.lower),
            "upperBound": str(self.upper), "numPartitions": str(self.count),
        }


def _reader(spark: SparkSession, connection: Connection, query: str, slices: Slices | None, fetch_size: int) -> DataFrameReader:
    text = bare_statement(query)
    if not text:
        raise ValueError("no SQL query")
    reader = spark.read.format("jdbc").options(**connection.options()).option("fetchsize", fetch_size)
    reader = reader.option("preferTimestampNTZ", True)
    if slices is None:
        return reader.option("query", text)
    # Spark takes slices only with dbtable; a subquery is one.
    return reader.option("dbtable", f"({text}) sliced").options(**slices.options())


def read_database(spark: SparkSession, connection: Connection, query: str, slices: Slices | None = None, fetch_size: int = 10_000) -> DataFrame:
    """Result of a query.  Without `slices` one task reads it all: give them for large results."""
    return _reader(spark, connection, query, slices, fetch_size).load()


def probe_schema(spark: SparkSession, connection: Connection, query: str) -> list[tuple[str, str]]:
    """Column names and logical types; Spark asks the database for zero rows."""
    try:
        schema = read_database(spark, connection, query).schema
    except Exception as error:
        lines = str(error).strip().splitlines()
        raise ValueError(lines[0] if lines else type(error).__name__) from error
    return [(f.name, logical_name(f.dataType)) for f in schema.fields]


def write_database(df: DataFrame, connection: Connection, table: str, mode: str = "append", batch_size: int = 10_000) -> DataFrame:
    """Append to, replace (drop and create) or create a table; returns the input.

    Every task writes over its own connection.  A retried task can repeat rows
    it sent before, as with any JDBC append: write to a staging table and swap
    it in the database where that matters.
    """
    if not table.strip():
        raise ValueError("no target table")
    if mode not in WRITE_MODES:
        raise ValueError(f"unknown mode {mode!r}")
    writer = df.write.format("jdbc").options(**connection.options()).option("dbtable", table.strip())
    writer.option("batchsize", batch_size).mode(WRITE_MODES[mode]).save()
    return df
