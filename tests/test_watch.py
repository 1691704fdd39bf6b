"""Windows over a whole table, unusual days, input drift, exact likelihood, sketches and observed writes."""

import random

import numpy as np
import pandas as pd
import pytest
from helpers import plan
from pyspark.sql import functions as F

from ledgerlight.operators import anomalies, drift, profile, quantiles, running
from ledgerlight.operators import series as ts
from ledgerlight.sources import sinks

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("partitions", [1, 7, 60])
def test_windows_over_a_whole_table_match_pandas(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice([1, 1, 2, 3, None]), i % 40, rng.choice([None, 1, 2, 5, -4])) for i in range(90)] + [(2, 7, 3)] * 50
    df = spark.createDataFrame(rows, "k int, i int, v int").repartition(9)
    ordered = running.Ordered(df, ["k"], partitions)
    got = ordered.with_columns(
        place="place", running={"s": ("sum", "v"), "n": ("count", "v"), "lo": ("min", "v"), "hi": ("max", "v")},
        shifts={"one": ("i", 1), "nine": ("v", 9), "next": ("i", -1), "later": ("v", -9)},
    ).orderBy("place").collect()
    low = lambda x: (x is not None, x or 0)
    want = sorted(rows, key=lambda r: (low(r[0]), r[1], low(r[2])))
    assert [(r.k, r.i, r.v) for r in got] == want and [r.place for r in got] == list(range(1, 141))
    at = lambda j, c: want[j][c] if 0 <= j < len(want) else None
    for j, r in enumerate(got):
        seen = [x[2] for x in want[: j + 1] if x[2] is not None]
        assert (r.s, r.n, r.lo, r.hi) == (sum(seen) if seen else None, len(seen), min(seen, default=None), max(seen, default=None))
        assert (r.one, r.nine, r.next, r.later) == (at(j - 1, 1), at(j - 9, 2), at(j + 1, 1), at(j + 9, 2))
    assert sum(r.is_train for r in running.first_share(df, ["k"], 0.8, partitions=partitions).collect()) == 112


def test_windows_over_a_whole_table_use_no_single_partition(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_id", "value")
    ordered = running.Ordered(events, ["ts", "event_id"], 8)
    assert len(ordered.sizes) == 8 and max(ordered.sizes.values()) < ordered.total / 3
    found = ordered.with_columns(place="place", running={"s": ("sum", "value")}, shifts={"before": ("value", 1)})
    assert "SinglePartition" not in plan(found)
    assert "SinglePartition" not in plan(ts.difference(events, "ts", "value"))


def test_empty_tables_and_taken_names(spark):
    empty = spark.createDataFrame([], "a int, b int")
    assert running.Ordered(empty, ["a"]).with_columns(place="p", running={"s": ("sum", "b")}, shifts={"l": ("b", 1)}).collect() == []
    with pytest.raises(ValueError, match="taken"):
        running.Ordered(empty.withColumnRenamed("a", "_at"), ["b"])


def test_moments_of_parts_merge_to_those_of_the_whole(spark):
    rng = np.random.default_rng(1)
    data = pd.DataFrame(rng.normal(1e8, 1, (500, 4)), columns=list("abcd"))
    data["b"] += data["a"] * 3
    data.loc[::3, "c"], data.loc[10:, "d"] = None, None
    first, second = spark.createDataFrame(data[:170]).repartition(3), spark.createDataFrame(data[170:]).repartition(5)
    stored = profile.pair_moments(first, list("abcd")).unionByName(profile.pair_moments(second, list("abcd")))
    want = data.corr()
    for r in profile.corr_from_moments(stored, list("abcd")).collect():
        assert r.corr == pytest.approx(want.loc[r.x, r.y], rel=1e-6), (r.x, r.y)
    text = plan(profile.corr_matrix(spark.read.parquet(f"{SF}/lineitem.parquet"), ["l_quantity", "l_tax", "l_discount"]))
    assert text.count("FileScan") == 1
    assert profile.corr_matrix(first.limit(0), ["a", "b"]).collect() == []


def daily(spark, values, key="k"):
    days = pd.date_range("2024-01-01", periods=len(values)).date
    return spark.createDataFrame([(key, d, float(v)) for d, v in zip(days, values)], "key string, date date, value double")


def test_planted_days_are_found_and_weekends_are_not(spark):
    rng = np.random.default_rng(5)
    values = 100 + np.arange(200) * 0.1 + np.where(np.arange(200) % 7 >= 5, 40, 0) + rng.normal(0, 1, 200)
    values[[50, 120]] += (30, -30)
    flagged = anomalies.flag_anomalies(anomalies.decompose(daily(spark, values), ["key"]), ["key"])
    got = [r.date for r in flagged.where("is_anomaly").orderBy("date").collect()]
    days = pd.date_range("2024-01-01", periods=200).date
    assert {days[50], days[120]} <= set(got) and all(min(abs((d - days[k]).days) for k in (50, 120)) <= 3 for d in got)
    alert = anomalies.anomaly_alerts(flagged, ["key"], max_days=0).first()
    assert alert.alert and alert.days == 200 and alert.worst_day in (days[50], days[120])
    assert plan(flagged).count("Exchange hashpartitioning") == 1


def test_flat_and_short_series_have_no_unusual_days(spark):
    for values in ([5.0] * 60, [0.1, 0.2, 0.3] * 20, [1.0], [1.0, 9.0]):
        flagged = anomalies.flag_anomalies(anomalies.decompose(daily(spark, values), ["key"]), ["key"])
        assert flagged.count() == len(values)
        if len(set(values)) == 1:
            assert flagged.where("is_anomaly").count() == 0
    flat = [5.0] * 60
    flat[30] = 50.0
    assert anomalies.flag_anomalies(anomalies.decompose(daily(spark, flat), ["key"]), ["key"]).where("is_anomaly and value = 50").count() == 1
    with pytest.raises(ValueError, match="period"):
        anomalies.decompose(daily(spark, flat), ["key"], period=1)


def test_histograms_of_days_add_up_and_drift_is_measured(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"p": ["a"] * 4000 + ["b"] * 4000 + ["c"] * 4000, "x": np.r_[rng.normal(0, 1, 8000), rng.normal(1, 1, 4000)], "y": 1.0})
    frame.loc[8000:8999, "y"] = None
    df = spark.createDataFrame(frame).withColumn("y", F.nullif(F.nanvl("y", F.lit(-1.0)), F.lit(-1.0)))
    edges = drift.baseline_edges(df.where("p = 'a'"), ["x", "y"])
    assert len(edges["x"]) == 9 and edges["y"] == [1.0]
    whole = drift.period_histograms(df, F.col("p"), edges)
    parts = drift.period_histograms(df.where("x < 0"), F.col("p"), edges).unionByName(drift.period_histograms(df.where("x >= 0"), F.col("p"), edges))
    rate = lambda h: {(r.period, r.column): r for r in drift.distribution_drift(h, F.col("period") == "a", edges).collect()}
    got = rate(whole)
    assert got == rate(parts)
    assert got["a", "x"].psi == 0 and got["a", "x"].ks == 0 and got["b", "x"].psi < 0.02 and not got["b", "x"].alert
    assert got["c", "x"].alert and got["c", "x"].psi > 0.8
    x = np.sort(frame.x[:4000].to_numpy()), np.sort(frame.x[8000:].to_numpy())
    exact = max(abs((x[0] <= e).mean() - (x[1] <= e).mean()) for e in edges["x"])
    assert got["c", "x"].ks == pytest.approx(exact)
    assert got["c", "y"].missing == 1000 and got["c", "y"].alert and not got["b", "y"].alert


@pytest.mark.parametrize("p, phi", [(1, [0.7]), (2, [0.5, -0.6]), (5, [0.4, -0.2, 0.1, 0.1, -0.3])])
def test_exact_likelihood_recovers_coefficients(p, phi):
    rng = np.random.default_rng(p)
    x = np.zeros(6000)
    for t in range(p, 6000):
        x[t] = np.dot(phi, x[t - p : t][::-1]) + rng.normal()
    assert ts._likelihood(x[500:], p) == pytest.approx(phi, abs=0.05)
    assert ts._likelihood(x[500:], p) == pytest.approx(ts._least_squares(x[500:], p), abs=0.01)


@pytest.mark.parametrize("p", [1, 2, 3])
def test_deviance_is_that_of_the_joint_density(p):
    """Against the density of the whole vector with its Toeplitz covariance."""
    rng = np.random.default_rng(p)
    partial = rng.uniform(-0.9, 0.9, p)
    phi, x = ts._predictors(partial)[p], rng.normal(size=12)
    # autocovariances of the process with unit innovations, from its moving average form
    weights = np.zeros(4000)
    weights[0] = 1
    for t in range(1, 4000):
        weights[t] = sum(phi[j] * weights[t - 1 - j] for j in range(min(p, t)))
    gamma = np.array([weights[: 4000 - k] @ weights[k:] for k in range(12)])
    cov = gamma[np.abs(np.subtract.outer(range(12), range(12)))]
    want = 12 * np.log(x @ np.linalg.solve(cov, x)) + np.linalg.slogdet(cov)[1]
    assert ts._deviance(x, partial) == pytest.approx(want, rel=1e-8)


def test_two_coefficients_equal_a_grid_search(spark):
    rng = np.random.default_rng(9)
    x = np.zeros(80)
    for t in range(2, 80):
        x[t] = 0.5 * x[t - 1] - 0.3 * x[t - 2] + rng.normal()
    series = daily(spark, x)
    got = ts.ar_coefficients(series, ["key"], p=2, d=0).first()
    grid = [(ts._deviance(x, np.array([a, b])), a, b) for a in np.arange(-0.99, 1, 0.01) for b in np.arange(-0.99, 1, 0.01)]
    _, a, b = min(grid)
    assert got.phi == pytest.approx([a - a * b, b], abs=0.02) and got.n == 80
    assert ts.ar_coefficients(daily(spark, [1.0, 2.0]), ["key"], p=2).first().phi is None
    assert ts.ar_coefficients(daily(spark, [3.0] * 30), ["key"], p=2).first().phi == [0.0, 0.0]


def test_forecast_by_likelihood(spark):
    rng = np.random.default_rng(2)
    series = daily(spark, np.cumsum(rng.normal(size=120)))
    got = ts.ar_forecast(series, ["key"], p=2, method="likelihood").collect()
    assert len(got) == 24 and all(np.isfinite(r.forecast) for r in got)
    with pytest.raises(ValueError, match="method"):
        ts.ar_forecast(series, ["key"], method="guess")


def test_stored_sketches_merge_within_their_bound(spark):
    rng = np.random.default_rng(4)
    values = np.r_[rng.normal(size=60_000), rng.exponential(5, 60_000)]
    df = spark.createDataFrame(pd.DataFrame({"day": np.arange(120_000) % 30, "v": values}))
    df = df.unionByName(spark.createDataFrame([(0, None), (40, None)], "day long, v double"))
    sketches = quantiles.quantile_sketches(df, "v", ["day"])
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    rows = quantiles.sketch_quantiles(quantiles.merge_sketches(sketches.withColumn("all", F.lit(1)), ["all"]), ["all"], probs).collect()
    order = np.sort(values)
    for r in rows:
        assert r.n == 120_000
        assert np.searchsorted(order, r.value, "left") / 120_000 - quantiles.SKETCH_RANK_ERROR <= r.prob <= np.searchsorted(order, r.value, "right") / 120_000 + quantiles.SKETCH_RANK_ERROR
    assert {r.value for r in quantiles.sketch_quantiles(sketches.where("day = 40"), ["day"], probs).collect()} == {None}


def test_writes_are_counted_while_they_run(spark, tmp_path):
    df = spark.range(1000).withColumn("t", F.concat(F.lit("x "), "id"))
    path = f"file://{tmp_path}/observed"
    row = sinks.write_observed(df, path).first()
    assert row == sinks.verify_write(df, path).first() and row.matches and row.expected_rows == 1000
    lossy = sinks.write_observed(df, path, lambda table, to: sinks.write_parquet(table.where("id <> 5"), to)).first()
    assert not lossy.matches and (lossy.expected_rows, lossy.written_rows) == (1000, 999)
    empty = sinks.write_observed(df.limit(0), path).first()
    assert empty.matches and empty.written_rows == 0
