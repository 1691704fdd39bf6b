import numpy as np
import pandas as pd
import pytest
from helpers import plan
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlight.operators import profile, quantiles
from ledgerlight.sources.sales import table

finite = st.floats(allow_nan=False, allow_infinity=False)


def frame(spark, **cols):
    names = list(cols)
    rows = [tuple(None if v is None else float(v) for v in row) for row in zip(*cols.values())]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(finite, st.integers(-5, 5).map(float), st.none()), min_size=1, max_size=60))
def test_quantile_ranks_are_exact(spark, values):
    # Probabilities that fall on ranks, so that the answer is one of the values.
    present = sorted(v for v in values if v is not None)
    n = len(present)
    probs = [0.0, 1.0]
    got = quantiles.exact_quantiles(frame(spark, x=values), ["x"], probs)["x"]
    assert got == ([present[0], present[-1]] if n else [None, None])
    if n:
        middle = quantiles.exact_quantiles(frame(spark, x=values), ["x"], [0.5])["x"][0]
        low, high = present[(n - 1) // 2], present[n // 2]
        assert middle == (low if n % 2 else 0.5 * low + 0.5 * high)


@pytest.mark.parametrize("kind", ["normal", "cauchy", "ties", "cents", "tiny", "wide", "hot"])
def test_quantiles_match_numpy(spark, kind):
    rng = np.random.default_rng(7)
    data = {
        "normal": rng.normal(size=3000),
        "cauchy": rng.standard_cauchy(3000) * 1e50,
        "ties": rng.integers(0, 4, 3000).astype(float),
        "cents": rng.integers(1, 10**7, 3000) / 100,
        "tiny": 1 + rng.integers(0, 1000, 3000) * 2.0**-50,
        "wide": np.exp(rng.uniform(-600, 600, 3000)) * rng.choice([-1, 1], 3000),
        "hot": np.concatenate([np.full(1000, 42.0), rng.uniform(0, 100, 2000)]),
    }[kind]
    probs = [0.01, 0.25, 0.5, 0.75, 0.999]
    got = quantiles.exact_quantiles(frame(spark, x=data), ["x"], probs)["x"]
    np.testing.assert_allclose(got, np.quantile(data, probs), rtol=1e-12)


def test_quantiles_of_many_columns(spark):
    data = {f"c{i}": [i, i + 1, i + 5] for i in range(18)}
    got = quantiles.exact_quantiles(frame(spark, **data), list(data), [0.5])
    assert got == {f"c{i}": [i + 1.0] for i in range(18)}


def test_approximate_bounds_are_within_their_rank_error(spark):
    df = frame(spark, x=range(1001))
    found = quantiles.iqr_bounds(df, ["x"], rel_err=0.05)["x"]
    assert abs(found["q1"] - 250) <= 50 and abs(found["q3"] - 750) <= 50
    assert quantiles.iqr_bounds(frame(spark, x=[None]), ["x"], rel_err=0.05)["x"]["q1"] is None


def test_quantiles_skip_nan_and_read_one_column(spark, sf):
    df = frame(spark, x=[1, 2, float("nan"), 3], y=[1, 1, 1, 1])
    assert quantiles.exact_quantiles(df, ["x", "y"], [0.5]) == {"x": [2.0], "y": [1.0]}
    narrowed = quantiles.iqr_filter(table(spark, sf, "events"), "value").select("event_id")
    assert "PushedFilters: [IsNotNull(value), GreaterThanOrEqual(value" in plan(narrowed)
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan(narrowed)


def test_iqr_of_empty_and_constant(spark):
    empty = frame(spark, x=[None])
    assert quantiles.iqr_filter(empty, "x").count() == 1
    assert quantiles.outlier_stats(empty, ["x"]).first().outliers == 0
    same = frame(spark, x=[5, 5, 5])
    assert quantiles.iqr_filter(same, "x").count() == 3


def test_outliers_match_pandas(spark):
    pdf = pd.DataFrame({"a": [1, 2, 3, 4, 100, 5], "b": [1, -50, 2, 3, 2, 1]}, dtype=float)
    q1, q3 = pdf.quantile(0.25), pdf.quantile(0.75)
    outside = (pdf < q1 - 1.5 * (q3 - q1)) | (pdf > q3 + 1.5 * (q3 - q1))
    df = spark.createDataFrame(pdf)
    got = {r["column"]: r for r in quantiles.outlier_stats(df, ["a", "b"]).collect()}
    for c in pdf:
        assert got[c].q1 == q1[c] and got[c].q3 == q3[c] and got[c].outliers == outside[c].sum()
    assert quantiles.outlier_rows(df, ["a", "b"]).count() == outside.any(axis=1).sum()


def test_shape_matches_pandas(spark):
    pdf = pd.DataFrame({"a": np.random.default_rng(1).gamma(2, size=200), "b": 1.0})
    got = {r["column"]: r for r in profile.shape_stats(spark.createDataFrame(pdf), ["a", "b"]).collect()}
    assert got["a"].skewness == pytest.approx(pdf.a.skew(), rel=1e-10)
    assert got["a"].kurtosis == pytest.approx(pdf.a.kurtosis(), rel=1e-10)
    assert got["b"].skewness is None and got["b"].kurtosis is None
    few = profile.shape_stats(frame(spark, a=[1, 2]), ["a"]).first()
    assert few.skewness is None and few.kurtosis is None


def test_correlation_matches_pandas_with_missing_values(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(200, 3)), columns=list("abc"))
    pdf["b"] += pdf["a"]
    pdf.loc[::7, "a"], pdf.loc[::5, "b"] = None, None
    pdf["k"] = 1.0
    want = pdf.corr()
    nan_to_null = spark.createDataFrame(pdf).replace(float("nan"), None)
    for df in (spark.createDataFrame(pdf), nan_to_null):
        got = {(r.x, r.y): r.corr for r in profile.corr_matrix(df, list("abck")).collect()}
        for x in "abc":
            for y in "abc":
                assert got[x, y] == pytest.approx(want.loc[x, y], rel=1e-10)
            assert got[x, "k"] is None and got["k", x] is None
        assert got["k", "k"] is None


def test_correlation_constant_on_common_rows(spark):
    df = frame(spark, a=[1, 1, 2, 3], b=[1, 2, None, None])
    got = {(r.x, r.y): r.corr for r in profile.corr_matrix(df, ["a", "b"]).collect()}
    assert got["a", "b"] is None and got["a", "a"] == 1.0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=2, max_size=80), st.integers(1, 40))
def test_histogram_counts_add_up(spark, values, bins):
    got = profile.histogram(frame(spark, x=values), "x", bins).collect()
    assert len(got) == bins and sum(r["count"] for r in got) == len(values)


def test_histogram_matches_numpy(spark):
    data = np.random.default_rng(3).normal(size=2000)
    rows = sorted(profile.histogram(frame(spark, x=data, y=data * 2), ["x", "y"], 30).collect(), key=lambda r: (r["column"], r.bin))
    counts, edges = np.histogram(data, 30)
    assert [r["count"] for r in rows[:30]] == list(counts)
    np.testing.assert_allclose([r.low for r in rows[:30]], edges[:-1], rtol=1e-9, atol=1e-12)
    assert rows[29].high == data.max()


def test_histogram_of_constant_and_empty(spark):
    got = profile.histogram(frame(spark, x=[3, 3, 3], y=[None, None, None]), ["x", "y"], 4).collect()
    assert sorted((r["column"], r.bin, r["count"]) for r in got) == [("x", 0, 3), ("x", 1, 0), ("x", 2, 0), ("x", 3, 0)]


def test_density_close_to_exact_kernels(spark):
    data = np.random.default_rng(4).normal(size=3000)
    rows = sorted(profile.density(frame(spark, x=data), "x").collect(), key=lambda r: r.point)
    h = data.std(ddof=1) * len(data) ** -0.2
    x = np.linspace(data.min(), data.max(), 200)
    exact = np.exp(-0.5 * ((x[:, None] - data) / h) ** 2).sum(1) / (len(data) * h * np.sqrt(2 * np.pi))
    np.testing.assert_allclose([r.x for r in rows], x, rtol=1e-9, atol=1e-12)
    assert np.abs(np.array([r.density for r in rows]) - exact).max() < 0.002 * exact.max()
    assert rows[5].overlay == pytest.approx(rows[5].density * len(data) * (data.max() - data.min()) / 30)
    assert profile.density(frame(spark, x=[1, 1]), "x").count() == 0


def test_describe_matches_pandas(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, None, 4.0], "b": [5.0, 5.0, 5.0, 5.0]})
    want = pdf.describe()
    df = spark.createDataFrame(pdf)
    for r in profile.describe_typed(df, ["a", "b"], quartiles=True).collect():
        w = want[r["column"]]
        assert [r["count"], r["mean"], r["min"], r["q25"], r["q50"], r["q75"], r["max"]] == pytest.approx(
            [w[k] for k in ("count", "mean", "min", "25%", "50%", "75%", "max")]
        )
        assert r["stddev"] == pytest.approx(w["std"])


def test_profile_scans_only_its_columns(spark, sf):
    text = plan(profile.describe_typed(table(spark, sf, "lineitem"), ["l_tax"]))
    assert "ReadSchema: struct<l_tax:double>" in text and text.count("FileScan") == 1
    assert profile.non_null_counts(spark.range(3)).first()[:] == ("id", 3)
