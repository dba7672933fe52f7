"""Every registered query against its reference SQL, on the smallest tables."""
import pytest
from conftest import SF_DIR
from oracle import compare, connect

import __spark_entry__ as entry
from weftline.plans import ORACLES, QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert compare(spark, con, SF_DIR, entry.queries()[name], entry.oracle_sql().get(name)) == ""


def test_every_query_has_reference_sql():
    assert set(ORACLES) == set(QUERIES) and set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["l_returnflag", "l_linestatus", "quantity", "lines"] and out.count() > 0
