"""Daily series: calendar filling, lags, differences, chronological splits and AR forecasts.

Every function takes a series with one row per key and day, as ``daily_totals`` gives it. The
aggregation comes first and is combined before its shuffle, so a window partition or a group
holds at most one row per calendar day, also for a key that has a third of the raw rows. Lags,
differences and splits without keys run over ranges of the order (:mod:`running`), so they also
take tables of raw rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.operators import running


def _by_date(keys: Sequence[str], date: str) -> Window:
    return Window.partitionBy(*keys).orderBy(date)


def calendar_fill(
    df: DataFrame, date: str = "date", value: str = "value", keys: Sequence[str] = (), fill: float = 0
) -> DataFrame:
    """Add a row with ``fill`` for every missing day between the first and last day of each key.

    Each row produces the days up to the next one, so no calendar table and no join are needed.
    """
    last = F.date_sub(F.lead(date).over(_by_date(keys, date)), 1)
    days = F.explode(F.sequence(F.col(date), F.coalesce("_last", F.col(date))))
    kind = df.schema[value].dataType
    return (
        df.select(*keys, date, value, last.alias("_last"))
        .select(*keys, F.col(date).alias("_seen"), value, days.alias(date))
        .select(
            *keys,
            date,
            F.when(F.col(date) == F.col("_seen"), F.coalesce(F.col(value), F.lit(fill).cast(kind)))
            .otherwise(F.lit(fill).cast(kind))
            .alias(value),
        )
    )


def lag_features(
    df: DataFrame,
    keys: Sequence[str],
    date: str,
    col: str,
    lags: Sequence[int] = (1,),
    fill: float | None = 0,
    calendar: bool = False,
    name: str = "lag_{}",
) -> DataFrame:
    """Earlier values of ``col`` per key as new columns; the first rows get ``fill``.

    A lag counts observed rows. With ``calendar`` it counts days: the days between are added
    first, with 0, and only the key, date and ``col`` columns are kept.
    """
    if calendar:
        df = calendar_fill(df, date, col, keys)
    if not keys:
        found = running.shifted(df, [date], col, {name.format(n): n for n in lags})
        given = F.lit(fill).cast(df.schema[col].dataType)
        return found if fill is None else found.withColumns({name.format(n): F.coalesce(name.format(n), given) for n in lags})
    order = _by_date(keys, date)

    def lagged(n: int) -> Column:
        c = F.lag(col, n).over(order)
        return c if fill is None else F.coalesce(c, F.lit(fill).cast(df.schema[col].dataType))

    return df.withColumns({name.format(n): lagged(n) for n in lags})


def difference(df: DataFrame, date: str, col: str, keys: Sequence[str] = (), name: str = "diff") -> DataFrame:
    """Change of ``col`` against the previous row of the key, or of the table; null on the first."""
    if not keys:
        return running.changes(df, [date], col, name)
    return df.withColumn(name, F.col(col) - F.lag(col, 1).over(_by_date(keys, date)))


def ar_lag_matrix(
    df: DataFrame, date: str = "date", value: str = "value", keys: Sequence[str] = (), p: int = 5
) -> DataFrame:
    """The regression rows of an AR(p) model on first differences: ``diff`` and ``lag_1..lag_p``.

    Rows without all lags are left out.
    """
    lagged = lag_features(difference(df, date, value, keys), keys, date, "diff", range(1, p + 1), fill=None)
    # The last lag is present only where all others are.
    return lagged.filter(F.col(f"lag_{p}").isNotNull())


def chrono_split(
    df: DataFrame, keys: Sequence[str] = (), date: str = "date", frac: float = 0.8, name: str = "is_train"
) -> DataFrame:
    """Mark the first ``floor(n * frac)`` rows of each key, or of the table, in date order as training rows."""
    if not keys:
        return running.first_share(df, [date], frac, name)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    place = F.row_number().over(_by_date(keys, date))
    return df.withColumn(name, place <= F.floor(n * F.lit(frac)))


def _least_squares(diffs: np.ndarray, p: int) -> np.ndarray:
    """AR(p) coefficients, conditional on the first ``p`` values."""
    design = np.column_stack([diffs[p - i : len(diffs) - i] for i in range(1, p + 1)])
    return np.linalg.lstsq(design, diffs[p:], rcond=None)[0]


def _predictors(partial: np.ndarray) -> list[np.ndarray]:
    """The best linear predictors of order 0..p of a process with these partial autocorrelations."""
    rows = [np.zeros(0)]
    for r in partial:
        rows.append(np.r_[rows[-1] - r * rows[-1][::-1], r])
    return rows


def _deviance(x: np.ndarray, partial: np.ndarray) -> float:
    """Minus twice the exact Gaussian log-likelihood of AR(p), its variance maximised out, less a constant.

    The first ``p`` values are predicted from those before them, with the larger variance the process has
    there; that is what the Kalman filter of the state space form computes from its stationary start.
    """
    p, rows = len(partial), _predictors(partial)
    errors = np.convolve(x, np.r_[1.0, -rows[p]])[p : len(x)]
    tail = np.cumprod((1.0 / (1.0 - partial**2))[::-1])[::-1]  # variance before each value, relative to the last
    first = np.array([x[t] - rows[t] @ x[t - 1 :: -1][:t] if t else x[0] for t in range(min(p, len(x)))])
    total = float(errors @ errors + (first**2 / tail[: len(first)]).sum())
    return len(x) * np.log(max(total, 1e-300)) + float(np.log(tail[: len(first)]).sum())


def _burg(x: np.ndarray, p: int) -> np.ndarray:
    """Partial autocorrelations within (-1, 1) that fit both directions of the series: a start for the search."""
    forward, backward, found = x[1:], x[:-1], []
    for _ in range(p):
        power = float(forward @ forward + backward @ backward)
        r = 2 * float(forward @ backward) / power if power else 0.0
        found.append(r)
        forward, backward = (forward - r * backward)[1:], (backward - r * forward)[:-1]
    return np.clip(np.array(found), -0.99, 0.99)


def _minimum(f: Callable[[np.ndarray], float], start: np.ndarray, steps: int = 2_000, tolerance: float = 1e-11) -> np.ndarray:
    """Downhill simplex search from ``start``."""
    points = [start, *(start + 0.1 * np.eye(len(start))[i] for i in range(len(start)))]
    known = sorted(((f(p), i, p) for i, p in enumerate(points)), key=lambda k: k[:2])
    for count in range(len(points), len(points) + steps):
        best, worst = known[0], known[-1]
        if worst[0] - best[0] <= tolerance * (1 + abs(best[0])) and max(np.abs(k[2] - best[2]).max() for k in known) < 1e-7:
            break
        centre = np.mean([k[2] for k in known[:-1]], axis=0)
        tried = [(f(centre + a * (centre - worst[2])), count, centre + a * (centre - worst[2])) for a in (1.0,)]
        if tried[0][0] < best[0]:
            tried.append((f(centre + 2 * (centre - worst[2])), count, centre + 2 * (centre - worst[2])))
        elif tried[0][0] >= known[-2][0]:
            a = 0.5 if tried[0][0] < worst[0] else -0.5
            tried.append((f(centre + a * (centre - worst[2])), count, centre + a * (centre - worst[2])))
        new = min(tried, key=lambda k: k[0])
        if new[0] < worst[0]:
            known[-1] = new
        else:
            known = [best, *((f(m), i, m) for _, i, m in ((k[0], k[1], (k[2] + best[2]) / 2) for k in known[1:]))]
        known.sort(key=lambda k: k[:2])
    return known[0][2]


def _likelihood(diffs: np.ndarray, p: int) -> np.ndarray:
    """AR(p) coefficients of the largest exact Gaussian likelihood; always those of a stationary process."""
    found = _minimum(lambda u: _deviance(diffs, np.tanh(u)), np.arctanh(_burg(diffs, p)))
    return _predictors(np.tanh(found))[p]


_FITS = {"least_squares": _least_squares, "likelihood": _likelihood}


def _fit_and_forecast(values: np.ndarray, n_train: int, p: int, d: int, method: str = "least_squares") -> np.ndarray:
    """AR(p) without constant on ``d``-fold differences of the training part, forecast over the rest."""
    train = values[:n_train]
    diffs = np.diff(train, n=d)
    phi = _FITS[method](diffs, p)
    recent = list(diffs[-p:][::-1])
    steps = []
    for _ in range(len(values) - n_train):
        steps.append(float(np.dot(phi, recent)))
        recent = [steps[-1], *recent[: p - 1]]
    path = np.array(steps)
    for level in range(d - 1, -1, -1):
        path = np.diff(train, n=level)[-1] + np.cumsum(path)
    return path


def ar_coefficients(
    df: DataFrame, keys: Sequence[str] = (), date: str = "date", value: str = "value", p: int = 5, d: int = 1, centre: bool = False, method: str = "likelihood"
) -> DataFrame:
    """(keys, n, phi, sigma2): AR(p) of the ``d``-fold differences per key, by exact likelihood by default.

    The series is filled to whole days; ``n`` counts the differences, ``centre`` takes their mean out
    first. Coefficients and variance are null for a key with fewer than ``2 * p + 1`` of them.
    """
    if method not in _FITS:
        raise ValueError(f"unknown method {method!r}: use {', '.join(_FITS)}")
    filled = calendar_fill(df, date, value, keys)
    schema = filled.select(*keys).schema.add("n", "long").add("phi", T.ArrayType(T.DoubleType())).add("sigma2", "double")

    def fit(series: pd.DataFrame) -> pd.DataFrame:
        x = np.diff(series.sort_values(date)[value].to_numpy(dtype=float), n=d)
        x = x - x.mean() if centre and len(x) else x
        phi, sigma2 = None, None
        if len(x) > 2 * p:
            phi = _FITS[method](x, p)
            errors = np.convolve(x, np.r_[1.0, -phi])[p : len(x)]
            sigma2 = float(errors @ errors / len(errors))
        return pd.DataFrame({**{k: series[k].iloc[:1].to_list() for k in keys}, "n": [len(x)], "phi": [None if phi is None else phi.tolist()], "sigma2": [sigma2]})

    return filled.groupBy(*keys).applyInPandas(fit, schema)


def ar_forecast(
    df: DataFrame,
    keys: Sequence[str] = (),
    date: str = "date",
    value: str = "value",
    p: int = 5,
    d: int = 1,
    frac: float = 0.8,
    min_rows: int = 11,
    method: str = "least_squares",
) -> DataFrame:
    """Fit an AR(p) model on ``d``-fold differences per key and forecast its held-out days.

    The series of a key is filled to whole days and the first ``floor(n * frac)`` days are used
    to fit. One row per held-out day: keys, date, actual, forecast, status ``ok``. A key that has
    fewer than ``min_rows`` days, or too few to fit ``p`` coefficients, gives one row with status
    ``insufficient`` and no forecast.

    ``method`` is ``least_squares``, the estimate conditional on the first ``p`` differences, or
    ``likelihood``, the exact Gaussian likelihood of ARIMA(p, d, 0), which is always stationary.
    """
    if method not in _FITS:
        raise ValueError(f"unknown method {method!r}: use {', '.join(_FITS)}")
    filled = calendar_fill(df, date, value, keys)
    schema = filled.select(*keys, date).schema.add("actual", "double").add("forecast", "double")
    schema = schema.add("status", "string")
    columns = schema.names
    keys = list(keys)

    def forecast(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values(date)
        values = series[value].to_numpy(dtype=float)
        n_train = int(len(values) * frac)
        if len(values) < min_rows or n_train - d - p < p:
            return series.tail(1).assign(actual=None, forecast=None, status="insufficient")[columns]
        held_out = series.iloc[n_train:]
        path = _fit_and_forecast(values, n_train, p, d, method)
        return held_out.assign(actual=values[n_train:], forecast=path, status="ok")[columns]

    return filled.groupBy(*keys).applyInPandas(forecast, schema)
