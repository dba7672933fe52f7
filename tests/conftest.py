import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weftline import build_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session("weftline-tests", master="local[8]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def customers(spark):
    rows = [
        (1, "Acme", "active", "West", 1200.5),
        (2, "Birch", "inactive", "East", 300.0),
        (3, "Cedar", "active", "West", 5400.0),
        (4, "Dune", "active", "East", 9800.75),
        (5, "Elm", "inactive", "West", 50.0),
        (6, "Fern", "active", "East", 720.0),
        (7, "Gale", "inactive", "East", 15.25),
        (8, "Haven", "active", "West", 4200.0),
    ]
    return spark.createDataFrame(rows, "id bigint, name string, status string, region string, spend double")


@pytest.fixture
def regions(spark):
    rows = [("West", "Wendy", 10000), ("East", "Evan", 8000), ("North", "Nora", 5000)]
    return spark.createDataFrame(rows, "region string, manager string, quota bigint")


def rows_of(df):
    """Rows as a sorted list of tuples, nulls first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is not None, str(v)) for v in r])
