from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlight.functions.columns import hash_bucket
from ledgerlight.operators import sampling
from ledgerlight.operators import series as ts

DAY = date(2024, 1, 1)


def daily(spark, values, skip=()):
    rows = [("k", DAY + timedelta(i), float(v)) for i, v in enumerate(values) if i not in skip]
    return spark.createDataFrame(rows, "key string, date date, value double")


@settings(max_examples=8, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1, max_size=20))
def test_calendar_matches_pandas(spark, days):
    df = spark.createDataFrame([(DAY + timedelta(d), float(d + 1)) for d in days], "date date, value double")
    got = [(r.date, r.value) for r in ts.calendar_fill(df).orderBy("date").collect()]
    want = pd.Series({pd.Timestamp(DAY + timedelta(d)): float(d + 1) for d in days}).sort_index().asfreq("D").fillna(0)
    assert got == [(i.date(), v) for i, v in want.items()]


def test_calendar_per_key_and_nulls(spark):
    df = spark.createDataFrame([("a", DAY, 1.0), ("a", DAY + timedelta(2), None), ("b", DAY + timedelta(9), 4.0)], "k string, date date, value double")
    got = sorted(r[:] for r in ts.calendar_fill(df, keys=["k"]).collect())
    assert got == [("a", DAY, 1.0), ("a", DAY + timedelta(1), 0.0), ("a", DAY + timedelta(2), 0.0), ("b", DAY + timedelta(9), 4.0)]


def test_lags_by_row_and_by_day(spark):
    df = daily(spark, [5, 6, 7, 8], skip={2})
    by_row = ts.lag_features(df, ["key"], "date", "value").orderBy("date").collect()
    assert [r.lag_1 for r in by_row] == [0.0, 5.0, 6.0]
    by_day = ts.lag_features(df, ["key"], "date", "value", calendar=True).orderBy("date").collect()
    assert [(r.value, r.lag_1) for r in by_day] == [(5.0, 0.0), (6.0, 5.0), (0.0, 6.0), (8.0, 0.0)]


def test_chronological_split(spark):
    df = daily(spark, range(11))
    got = ts.chrono_split(df, ["key"]).orderBy("date").collect()
    assert [r.is_train for r in got] == [True] * 8 + [False] * 3


def test_lag_matrix(spark):
    got = ts.ar_lag_matrix(daily(spark, [i * i for i in range(8)]), keys=["key"]).orderBy("date").collect()
    assert [(r["diff"], r.lag_1, r.lag_5) for r in got] == [(11.0, 9.0, 1.0), (13.0, 11.0, 3.0)]


def by_hand(values, p, n_train):
    """The same forecast, one step at a time."""
    train = np.array(values[:n_train], dtype=float)
    d = np.diff(train)
    rows = [[d[t - i] for i in range(1, p + 1)] for t in range(p, len(d))]
    phi = np.linalg.lstsq(np.array(rows), d[p:], rcond=None)[0]
    history, level, out = list(d), train[-1], []
    for _ in range(len(values) - n_train):
        step = sum(phi[i] * history[-1 - i] for i in range(p))
        history.append(step)
        level += step
        out.append(level)
    return out


def test_forecast_matches_the_regression(spark):
    values = list(100 + np.cumsum(np.random.default_rng(0).normal(size=80)))
    got = ts.ar_forecast(daily(spark, values), ["key"]).orderBy("date").collect()
    assert len(got) == 16 and {r.status for r in got} == {"ok"}
    np.testing.assert_allclose([r.forecast for r in got], by_hand(values, 5, 64), rtol=1e-9)
    np.testing.assert_allclose([r.actual for r in got], values[64:], rtol=1e-12)


def test_forecast_recovers_an_ar_process(spark):
    d = [1.0, -0.5, 0.3, 0.8, -0.2]
    for _ in range(60):
        d.append(0.5 * d[-1] - 0.3 * d[-2] + 0.2 * d[-5])
    values = list(np.cumsum([50.0, *d]))
    for r in ts.ar_forecast(daily(spark, values), ["key"]).collect():
        assert r.forecast == pytest.approx(r.actual, abs=1e-6)


def test_forecast_of_second_differences_and_levels(spark):
    values = [float(i * i) + (i % 3) for i in range(60)]
    for d in (0, 2):
        assert {r.status for r in ts.ar_forecast(daily(spark, values), ["key"], p=2, d=d).collect()} == {"ok"}


@pytest.mark.parametrize("n", [1, 10, 13])
def test_short_series_get_a_status(spark, n):
    got = ts.ar_forecast(daily(spark, range(n)), ["key"]).collect()
    assert [(r.status, r.forecast) for r in got] == [("insufficient", None)]


def test_split_is_disjoint_complete_and_stable(spark):
    df = spark.range(2000)
    train, test = sampling.split(df, ["id"])
    assert train.intersect(test).count() == 0 and train.count() + test.count() == 2000
    assert 0.75 < train.count() / 2000 < 0.85
    again = sampling.split(df.repartition(5).orderBy(F.desc("id")), ["id"])[0]
    assert train.exceptAll(again).count() == 0 and again.count() == train.count()


@pytest.mark.parametrize("n", [0, 1, 100, 2000, 5000])
def test_sample_has_exactly_n_of_the_smallest_hashes(spark, n):
    df = spark.range(2000)
    got = [r.id for r in sampling.hash_sample(df, ["id"], n).collect()]
    want = [r.id for r in df.withColumn("h", hash_bucket(["id"], 42)).orderBy("h", "id").limit(n).collect()]
    assert sorted(got) == sorted(want) and len(got) == min(n, 2000)


def test_small_fractions_are_not_rounded(spark):
    df = spark.range(20_000)
    assert 60 < sampling.split(df, ["id"], 0.005)[0].count() < 140


def test_seed_changes_the_sample(spark):
    df = spark.range(500)
    a, b = (sampling.hash_fraction(df, ["id"], 0.3, seed).count() for seed in (1, 2))
    assert 100 < a < 200 and 100 < b < 200
    assert sampling.bernoulli_sample(df, 0.5).count() < 500
