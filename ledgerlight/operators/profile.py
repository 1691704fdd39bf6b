"""Column statistics: typed describe, shape, correlation, histograms and densities.

Each report is one wide aggregate over all its columns, turned into rows afterwards, so a table
is scanned once per report (twice where bounds are needed first), not once per column.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.columns import finite_or_null
from ledgerlight.operators.quantiles import QUARTILES, exact_quantiles


def _as_rows(stats: DataFrame, cols: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """Turn one wide row with columns ``<prefix>_<position>`` into one row per table column."""
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{prefix}_{i}").alias(n) for n, prefix in fields.items()])
        for i, c in enumerate(cols)
    ]
    return stats.select(F.inline(F.array(*rows)))


def non_null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, count) of non-null values."""
    cols = list(cols or df.columns)
    stats = df.agg(*[F.count(c).alias(f"n_{i}") for i, c in enumerate(cols)])
    return _as_rows(stats, cols, {"count": "n"})


def describe_typed(df: DataFrame, cols: Sequence[str], quartiles: bool = False) -> DataFrame:
    """Count, mean, sample standard deviation, minimum and maximum per column, as numbers.

    ``quartiles`` adds exact q25, q50 and q75.
    """
    aggs: list[Column] = []
    for i, c in enumerate(cols):
        v = finite_or_null(df, c).cast("double")
        for prefix, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp), ("lo", F.min), ("hi", F.max)):
            aggs.append(f(v).alias(f"{prefix}_{i}"))
    fields = {"count": "n", "mean": "mean", "stddev": "sd", "min": "lo", "max": "hi"}
    stats = df.agg(*aggs)
    if quartiles:
        found = exact_quantiles(df, cols)
        for i, c in enumerate(cols):
            for p, v in zip(QUARTILES, found[c]):
                stats = stats.withColumn(f"q{p * 100:.0f}_{i}", F.lit(v).cast("double"))
        fields |= {f"q{p * 100:.0f}": f"q{p * 100:.0f}" for p in QUARTILES}
    return _as_rows(stats, cols, fields)


def describe_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, smallest and largest value of columns that are not numbers, as text."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"n_{i}"), F.min(c).cast("string").alias(f"lo_{i}"), F.max(c).cast("string").alias(f"hi_{i}")]
    return _as_rows(df.agg(*aggs), cols, {"count": "n", "min": "lo", "max": "hi"})


def shape_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Bias-corrected sample skewness and excess kurtosis per column.

    Null below 3 (skewness) or 4 (kurtosis) values and for a constant column.
    """
    aggs, out = [], []
    for i, c in enumerate(cols):
        v = finite_or_null(df, c).cast("double")
        aggs += [F.count(v).alias(f"n_{i}"), F.skewness(v).alias(f"s_{i}"), F.kurtosis(v).alias(f"k_{i}")]
        n, s, k = F.col(f"n_{i}").cast("double"), F.col(f"s_{i}"), F.col(f"k_{i}")
        skew = F.when(n > 2, s * F.try_divide(F.sqrt(n * (n - 1)), n - 2))
        kurt = F.when(n > 3, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * k + 6))
        out.append(F.struct(F.lit(c).alias("column"), skew.alias("skewness"), kurt.alias("kurtosis")))
    return df.agg(*aggs).select(F.inline(F.array(*out)))


_MOMENTS = ("n", "mean_x", "mean_y", "xx", "yy", "xy", "low_x", "high_x", "low_y", "high_y")


def _gram(values: np.ndarray) -> dict[str, np.ndarray]:
    """Moments of every pair of columns over the rows where both are present (k x k each).

    ``xx[i, j]`` is the sum of squared deviations of column i, ``xy[i, j]`` that of the products."""
    there = ~np.isnan(values)
    mask, shift = there.astype(float), np.array([c[m].mean() if m.any() else 0.0 for c, m in zip(values.T, there.T)])
    x = np.where(there, values - shift, 0.0)
    n = mask.T @ mask
    some = np.maximum(n, 1)
    sums = x.T @ mask  # [i, j]: sum of column i where j is present too
    squares, products = (x * x).T @ mask, x.T @ x
    mean = sums / some
    low = np.stack([np.where(there & m[:, None], values, np.inf).min(axis=0, initial=np.inf) for m in there.T], axis=1)
    high = np.stack([np.where(there & m[:, None], values, -np.inf).max(axis=0, initial=-np.inf) for m in there.T], axis=1)
    return {
        "n": n, "mean_x": mean + shift[:, None], "mean_y": (mean + shift[:, None]).T, "xx": squares - some * mean * mean, "yy": (squares - some * mean * mean).T,
        "xy": products - some * mean * mean.T, "low_x": low, "high_x": high, "low_y": low.T, "high_y": high.T,
    }


def _merged(parts: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Moments of the union of disjoint sets of rows; the first axis runs over the sets."""
    n = parts["n"].sum(axis=0)
    some = np.maximum(n, 1)
    out = {"n": n} | {m: (parts["n"] * parts[m]).sum(axis=0) / some for m in ("mean_x", "mean_y")}
    dx, dy = parts["mean_x"] - out["mean_x"], parts["mean_y"] - out["mean_y"]
    for m, a, b in (("xx", dx, dx), ("yy", dy, dy), ("xy", dx, dy)):
        out[m] = parts[m].sum(axis=0) + (parts["n"] * a * b).sum(axis=0)
    return out | {f"low_{s}": parts[f"low_{s}"].min(axis=0) for s in "xy"} | {f"high_{s}": parts[f"high_{s}"].max(axis=0) for s in "xy"}


def pair_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, j, moments) per pair of columns and task, i <= j: partial results that add up.

    They can be stored per day and merged later by :func:`corr_from_moments`.
    """
    cols = list(cols)
    k = len(cols)
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] | None = None
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            own = _gram(np.where(np.isfinite(values), values, np.nan))
            seen = own if seen is None else _merged({m: np.stack([seen[m], own[m]]) for m in _MOMENTS})
        if seen is not None:
            at = tuple(np.array(upper).T)
            columns = [pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), *(pa.array(seen[m][at]) for m in _MOMENTS)]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", *_MOMENTS])

    numbers = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    return numbers.mapInArrow(run, "i int, j int, " + ", ".join(f"{m} double" for m in _MOMENTS))


def corr_from_moments(moments: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Correlations (x, y, corr) from the rows of :func:`pair_moments`, of any number of tasks and days."""
    cols = list(cols)

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        m = _merged({c: parts[c].to_numpy() for c in _MOMENTS})
        i, j = key
        varies = m["n"] > 0 and m["low_x"] < m["high_x"] and m["low_y"] < m["high_y"]
        spread = np.sqrt(m["xx"]) * np.sqrt(m["yy"]) if varies else 0.0
        r = 1.0 if varies and i == j else float(m["xy"] / spread) if spread > 0 else None
        ends = dict.fromkeys([(i, j), (j, i)])
        return pd.DataFrame({"x": [cols[a] for a, _ in ends], "y": [cols[b] for _, b in ends], "corr": pd.Series([r] * len(ends), dtype=object)})

    return moments.groupBy("i", "j").applyInPandas(merge, "x string, y string, corr double")


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns as rows (x, y, corr), both orders and x = y.

    A pair uses the rows where both values are present and finite. The correlation is null where
    one of the two is constant there. One scan for any number of columns: each task keeps the
    moments of all pairs around its own means, which are then merged pair by pair, so neither a
    large mean nor a missing value costs digits. Without rows there are no pairs.
    """
    return corr_from_moments(pair_moments(df, cols), cols)


def histogram(df: DataFrame, cols: str | Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width histogram of one or more columns: (column, bin, low, high, count).

    The last bin includes the maximum, empty bins are listed, and a constant column falls into
    its first bin. One scan finds the bounds, one counts; the shuffle carries at most
    ``bins * columns`` rows per partition.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    values = [finite_or_null(df, c).cast("double") for c in cols]
    bounds = df.agg(
        F.array(*[F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")) for v in values]).alias("bounds")
    )
    bound = F.get(bounds.scalar(), F.col("pos"))
    low, high = bound["lo"], bound["hi"]
    width = (high - low) / F.lit(bins)
    place = F.floor(F.try_divide(F.col("v") - low, width)).cast("int")
    counts = (
        df.select(F.posexplode(F.array(*values)).alias("pos", "v"))
        .filter(F.col("v").isNotNull())
        .select("pos", F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).alias("bin"))
        .groupBy("pos", "bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    # bins * columns rows: the full grid of bins, so that empty ones appear.
    names = F.array(*[F.lit(c) for c in cols])
    grid = (
        bounds.select(F.posexplode("bounds").alias("pos", "bound"))
        .filter(F.col("bound.lo").isNotNull())
        .select("pos", "bound.lo", "bound.hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    )
    step = (F.col("hi") - F.col("lo")) / F.lit(bins)
    return grid.join(counts, ["pos", "bin"], "left").select(
        F.get(names, F.col("pos")).alias("column"),
        "bin",
        (F.col("lo") + step * F.col("bin")).alias("low"),
        F.when(F.col("bin") == bins - 1, F.col("hi")).otherwise(F.col("lo") + step * (F.col("bin") + 1)).alias("high"),
        F.coalesce("count", F.lit(0).cast("bigint")).alias("count"),
    )


def density(df: DataFrame, col: str, grid: int = 200, bins: int = 512, hist_bins: int = 30) -> DataFrame:
    """Gaussian kernel density of a column on ``grid`` points from its minimum to its maximum.

    The bandwidth is ``stddev * n^(-1/5)``. Values are first counted in ``bins`` equal bins and a
    kernel stands at each bin's centre, so the work after the counting does not grow with the
    data. ``overlay`` is the density times ``n`` and the width of a histogram bin: the curve drawn
    over a histogram of counts with ``hist_bins`` bins. No rows for a constant or empty column.
    """
    v = finite_or_null(df, col).cast("double")
    stats = df.agg(
        F.struct(
            F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.stddev_samp(v).alias("sd")
        ).alias("s")
    )
    s = stats.scalar()
    place = F.floor(F.try_divide(v - s["lo"], (s["hi"] - s["lo"]) / F.lit(bins))).cast("int")
    counts = (
        df.filter(v.isNotNull())
        .groupBy(F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    # At most `bins` entries, whatever the size of the data.
    kernels = counts.agg(F.sort_array(F.collect_list(F.struct("bin", "count"))).alias("kernels")).scalar()
    points = (
        stats.filter("s.hi > s.lo")
        .select("s.*", kernels.alias("kernels"), F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
        .withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / F.lit(grid - 1))
        .withColumn("bandwidth", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
        .withColumn("step", (F.col("hi") - F.col("lo")) / F.lit(bins))
    )
    total = F.aggregate(
        "kernels",
        F.lit(0.0),
        lambda acc, k: acc
        + k["count"]
        * F.exp(
            F.lit(-0.5)
            * F.pow((F.col("x") - (F.col("lo") + F.col("step") * (k["bin"] + F.lit(0.5)))) / F.col("bandwidth"), F.lit(2))
        ),
    )
    value = total / (F.col("n") * F.col("bandwidth") * F.sqrt(F.lit(2) * F.pi()))
    return points.withColumn("density", value).select(
        "point",
        "x",
        "density",
        (F.col("density") * F.col("n") * (F.col("hi") - F.col("lo")) / F.lit(hist_bins)).alias("overlay"),
    )
