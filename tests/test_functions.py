import math
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlight.functions import (
    categorical_columns,
    exact_average,
    exact_sum,
    is_blank,
    numeric_columns,
    parse_double,
    parse_long,
    period_label,
    strip,
)
from ledgerlight.functions.columns import hash_bucket
from ledgerlight.functions.staging import stage, staged, staged_paths, staging_folder


def column(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


@pytest.mark.parametrize(
    "text, number",
    [("4.5", 4.5), ("+4", 4.0), (".5", 0.5), ("1e3", 1000.0), ("1d", None), ("1f", None), ("", None), ("1_000", None),
     ("0x10", None), ("x", None), ("5.", 5.0)],
)
def test_parse_double(spark, text, number):
    assert column(spark, [text], "string").select(parse_double("v")).first()[0] == number


def test_parse_double_special(spark):
    got = [r[0] for r in column(spark, ["nan", "inf", "-inf"], "string").select(parse_double("v")).collect()]
    assert math.isnan(got[0]) and got[1:] == [math.inf, -math.inf]


@pytest.mark.parametrize("text, number", [("4", 4), ("4.0", None), ("-7", -7), ("99999999999999999999", None), ("", None)])
def test_parse_long(spark, text, number):
    assert column(spark, [text], "string").select(parse_long("v")).first()[0] == number


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=" \t\n\xa0 　ab,é", max_size=8), min_size=40, max_size=60))
def test_strip_like_python(spark, texts):
    rows = column(spark, texts, "string").select("v", strip("v").alias("s"), is_blank("v").alias("b")).collect()
    assert [(r.s, r.b) for r in rows] == [(r.v.strip(), r.v.strip() == "") for r in rows]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(-(10**12), 10**12), min_size=1, max_size=50))
def test_exact_sum_is_the_decimal_sum(spark, cents):
    values = [c / 100 for c in cents]
    df = column(spark, values, "double")
    total = Decimal(sum(cents)) / 100
    for parts in (1, 3, 7):
        assert df.repartition(parts).agg(exact_sum("v", scale=2)).first()[0] == float(total)
    assert df.agg(exact_average("v", scale=2)).first()[0] == float(total) / len(cents)


def test_exact_sum_beyond_a_long(spark):
    df = spark.range(1_000_000).select(F.lit(9.0e12).alias("v"))
    assert df.agg(exact_sum("v")).first()[0] == 9.0e18


def test_exact_sum_keeps_six_decimals(spark):
    df = column(spark, [45.123456, 0.000001, -1.5], "double")
    assert df.agg(exact_sum("v")).first()[0] == 43.623457
    assert df.agg(exact_sum("v", scale=2)).first()[0] == pytest.approx(43.623457)
    assert df.agg(exact_sum("v", scale=None)).first()[0] == pytest.approx(43.623457)


def test_exact_sum_of_what_does_not_fit_its_scale(spark):
    assert str(column(spark, [1.0, float("nan")], "double").agg(exact_sum("v")).first()[0]) == "nan"
    assert column(spark, [1.0, float("inf")], "double").agg(exact_sum("v")).first()[0] == float("inf")
    assert column(spark, [4e-7] * 1000, "double").agg(exact_sum("v")).first()[0] == pytest.approx(4e-4)
    assert column(spark, [10**13, 1], "long").agg(exact_sum("v")).first()[0] == 10**13 + 1


def test_hash_bucket_tells_keys_apart(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a|b", "c"), ("a", "b|c"), ("", None)], "x string, y string")
    assert df.select(hash_bucket(["x", "y"], 1).alias("h")).distinct().count() == 5


def test_staged_copies_are_deleted(spark):
    before = len(staged_paths())
    with staged():
        stage(spark.range(3), "a")
        assert len(staged_paths()) == before + 1
    assert len(staged_paths()) == before


def test_exact_sum_of_nothing(spark):
    df = column(spark, [None], "double")
    assert df.agg(exact_sum("v"), exact_average("v")).first()[:] == (None, None)


def test_period_labels(spark):
    df = spark.sql("SELECT date '2022-05-09' AS d")
    labels = [period_label("d", p) for p in ("month", "year_quarter", "quarter")]
    assert df.select(*labels, period_label("d", "year_quarter", "")).first()[:] == ("2022-05", "2022 Q2", "Q2", "2022Q2")
    with pytest.raises(ValueError):
        period_label("d", "week")


def test_column_classes(spark):
    df = spark.sql("SELECT 1 AS a, 1.5D AS b, 'x' AS ProductName, 'y' AS c, date '2020-01-01' AS d")
    assert numeric_columns(df) == ["a", "b"]
    assert categorical_columns(df) == ["c"]


def test_stage_uses_the_shared_folder(spark):
    staged = stage(spark.range(5), "numbers")
    assert staged.count() == 5
    assert all(f.startswith("file://" + staging_folder(spark)) for f in staged.inputFiles())
