import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from weftline import functions as fx


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(
        [(1200.5, " Acme ", "active", 7), (300.0, "Birch ", "inactive", -7), (None, None, None, None)],
        "spend double, name string, status string, n int",
    )


def values(df, col):
    return [r[0] for r in df.select(col).collect()]


@pytest.mark.parametrize("make, want", [
    (lambda: fx.trim("name"), ["Acme", "Birch", None]),
    (lambda: fx.upper(fx.trim("name")), ["ACME", "BIRCH", None]),
    (lambda: fx.lower("status"), ["active", "inactive", None]),
    (lambda: fx.length("name"), [6, 6, None]),
    (lambda: fx.substring("status", 0, 3), ["act", "ina", None]),
    (lambda: fx.substring("status", 2), ["tive", "active", None]),
    (lambda: fx.substring("status", -3, 2), ["iv", "iv", None]),
    (lambda: fx.substring("status", -7), ["active", "nactive", None]),
    (lambda: fx.contains("status", "act"), [True, True, None]),
    (lambda: fx.contains("status", ".*"), [False, False, None]),
    (lambda: fx.starts_with("status", "in"), [False, True, None]),
    (lambda: fx.ends_with("status", "ive"), [True, True, None]),
    (lambda: fx.replace("status", "act", "A$1"), ["A$1ive", "inA$1ive", None]),
    (lambda: fx.concat("status", F.lit("-"), "n"), ["active-7", "inactive--7", None]),
    (lambda: fx.abs_("n"), [7, 7, None]),
    (lambda: fx.round_("spend"), [1201.0, 300.0, None]),
    (lambda: fx.round_("spend", half_even=True), [1200.0, 300.0, None]),
    (lambda: fx.floor("spend", like="double"), [1200.0, 300.0, None]),
    (lambda: fx.ceil("spend"), [1201, 300, None]),
    (lambda: fx.pow_("n", 2, like="int"), [49, 49, None]),
    (lambda: fx.mod("n", 3), [1, 2, None]),
    (lambda: fx.mod("n", -3), [-2, -1, None]),
    (lambda: fx.mod("n", 0), [None, None, None]),
    (lambda: fx.min_("n", "spend"), [7.0, -7.0, None]),
    (lambda: fx.max_("n", 0), [7, 0, 0]),
    (lambda: fx.min_("n"), [7, -7, None]),
    (lambda: fx.is_null("n"), [False, False, True]),
    (lambda: fx.is_not_null("n"), [True, True, False]),
    (lambda: fx.coalesce("n", 5), [7, -7, 5]),
    (lambda: fx.coalesce("name", "n", F.lit("?"), as_type="string"), [" Acme ", "Birch ", "?"]),
    (lambda: fx.to_string("n"), ["7", "-7", None]),
    (lambda: fx.to_number("name"), [None, None, None]),
    (lambda: fx.to_int("spend"), [1200, 300, None]),
    (lambda: fx.to_int(F.lit("3.7")), [None] * 3),
    (lambda: fx.add("spend", 1), [1201.5, 301.0, None]),
    (lambda: fx.subtract("n", 1), [6, -8, None]),
    (lambda: fx.multiply("n", 2), [14, -14, None]),
    (lambda: fx.negate("n"), [-7, 7, None]),
    (lambda: fx.divide("n", 2), [3.5, -3.5, None]),
    (lambda: fx.divide("n", 0), [math.inf, -math.inf, None]),
    (lambda: fx.compare("spend", ">=", 300), [True, True, None]),
    (lambda: fx.compare("status", "=", F.lit("active")), [True, False, None]),
    (lambda: fx.compare("status", "<", 3, numeric=True), [None, None, None]),
    (lambda: fx.case_if((F.col("n") > 0, "up"), (F.col("n") < 0, "down"), otherwise="none"), ["up", "down", "none"]),
    (lambda: fx.case_if((F.col("n") > 0, "up")), ["up", None, None]),
])
def test_function(frame, make, want):
    assert values(frame, make()) == want


def test_not_a_number(frame):
    assert math.isnan(values(frame, fx.divide(F.lit(0), 0))[0])
    assert math.isnan(values(frame, fx.sqrt(F.lit(-1.0)))[0])


def test_dates(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 29),)], "d date")
    assert tuple(df.select(fx.year("d"), fx.month("d"), fx.day("d")).first()) == (2024, 2, 29)
    row = df.select(fx.now().alias("n"), fx.today().alias("t"))
    assert dict(row.dtypes) == {"n": "timestamp_ntz", "t": "date"}


def test_arity():
    for call in (fx.concat, fx.min_, fx.max_, fx.coalesce, fx.case_if):
        with pytest.raises(TypeError):
            call()
    with pytest.raises(TypeError):
        fx.trim()
