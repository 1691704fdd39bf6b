"""Exact quantiles, IQR bounds and outlier reports for tables of any size.

Spark's ``percentile`` keeps every distinct value in one task's memory, and ``percentile_approx``
sends one sketch per input partition to a single reducer. Neither holds at 100 TB. The search
here narrows a bracket around each wanted rank with ordinary grouped counts:

1. Count values per logarithmic bucket (64 per factor of two). Every partition sends at most a
   few thousand partial rows.
2. Keep the bucket that holds the wanted rank, with its smallest and largest value.
3. Cut that bracket into equal bins, count again over the rows inside it (the bounds are pushed
   down to the scan), and repeat until the bracket is a single value.

Each pass reads only the wanted columns, the first one touches all rows, the second about one in
a hundred and the later ones next to none. Only the brackets (two per quantile) reach the driver.
Buckets are monotone in the value, so the result is exact for every distribution, including one
where a third of the rows share a value: equal values are added up before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.columns import finite_or_null

_PER_OCTAVE = 64
_MAX_BUCKET = 70_000  # 64 * 1075 octaves of a double, plus room for infinity
_BINS = 4_096
_COLUMNS = 16  # columns per search

QUARTILES = (0.25, 0.5, 0.75)


def _log_bucket(v: Column) -> Column:
    size = F.floor(F.log2(F.abs(v)) * _PER_OCTAVE)
    size = F.greatest(F.least(size, F.lit(_MAX_BUCKET)), F.lit(-_MAX_BUCKET)) + 2 * _MAX_BUCKET
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size)


def _long_form(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    values = [finite_or_null(df, c).cast("double") for c in cols]
    return df.select(F.posexplode(F.array(*values)).alias("pos", "v")).filter(F.col("v").isNotNull())


def _locate(buckets: DataFrame, group: Sequence[str], ranks: Column) -> DataFrame:
    """Buckets that hold one of ``ranks``; ``before`` counts the rows in smaller buckets."""
    # Window partitions hold one row per bucket, a number fixed by this module.
    upto = Window.partitionBy(*group).orderBy("bucket")
    return (
        buckets.withColumn("before", F.sum("n").over(upto) - F.col("n") + F.col("base"))
        .withColumn("rank", F.explode(ranks))
        .filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
    )


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float] = QUARTILES
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of numeric columns, ignoring nulls and NaN.

    Runs a few small jobs right away, like ``DataFrame.approxQuantile``, and returns
    ``len(cols) * len(probs)`` numbers. A column without values gives nulls.
    """
    cols = list(dict.fromkeys(cols))
    if len(cols) > _COLUMNS:  # keeps the generated expressions of a pass small
        rest = exact_quantiles(df, cols[_COLUMNS:], probs)
        return exact_quantiles(df, cols[:_COLUMNS], probs) | rest
    long = _long_form(df, cols)
    buckets = (
        long.groupBy("pos", _log_bucket(F.col("v")).alias("bucket"))
        .agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .withColumn("total", F.sum("n").over(Window.partitionBy("pos")))
        .withColumn("base", F.lit(0))
    )
    places = [F.lit(float(p)) * (F.col("total") - 1) for p in probs]
    ranks = F.array_distinct(F.array(*[f(p) for p in places for f in (F.floor, F.ceil)]))
    rows = _locate(buckets, ["pos"], ranks).select("pos", "rank", "total", "before", "lo", "hi").collect()

    totals = {r["pos"]: r["total"] for r in rows}
    brackets = {(r["pos"], r["rank"]): (r["lo"], r["hi"], r["before"]) for r in rows}
    while True:
        open_ranks: dict[tuple, list[int]] = {}
        for (pos, rank), (lo, hi, before) in brackets.items():
            if lo < hi:
                open_ranks.setdefault((pos, lo, hi, before), []).append(rank)
        if not open_ranks:
            break
        brackets.update(_narrow(df, cols, open_ranks))

    result: dict[str, list[float | None]] = {}
    for pos, name in enumerate(cols):
        if pos not in totals:
            result[name] = [None] * len(probs)
            continue
        values = []
        for p in probs:
            place = float(p) * (totals[pos] - 1)
            below, above = math.floor(place), math.ceil(place)
            low, high = brackets[pos, below][0], brackets[pos, above][0]
            values.append(low if below == above else (above - place) * low + (place - below) * high)
        result[name] = values
    return result


def _narrow(df: DataFrame, cols: Sequence[str], open_ranks: dict[tuple, list[int]]) -> dict:
    """One more pass: split every open bracket into bins and keep the bin of each rank."""
    keys = list(open_ranks)
    inside = [F.col(cols[pos]).between(lo, hi) for pos, lo, hi, _ in keys]
    rows = _long_form(df.filter(reduce(Column.__or__, inside)), _open_columns(cols, keys))
    position = {name: i for i, name in enumerate(_open_columns(cols, keys))}

    def pick(values: Sequence, kind: str) -> Column:
        chain = None
        for (pos, lo, hi, _), value in zip(keys, values):
            hit = (F.col("pos") == position[cols[pos]]) & F.col("v").between(lo, hi)
            chain = F.when(hit, F.lit(value)) if chain is None else chain.when(hit, F.lit(value))
        return chain.cast(kind)

    slot = pick(range(len(keys)), "int")
    low, width = pick([k[1] for k in keys], "double"), pick([k[2] - k[1] for k in keys], "double")
    bins = F.least(F.floor((F.col("v") - low) / width * _BINS), F.lit(_BINS - 1))
    counted = (
        rows.select("v", slot.alias("slot"), bins.alias("bucket"))
        .filter(F.col("slot").isNotNull())
        .groupBy("slot", "bucket")
        .agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    )
    slots = F.col("slot")
    base = F.array(*[F.lit(k[3]).cast("bigint") for k in keys])[slots]
    wanted = F.array(*[F.array(*[F.lit(r).cast("bigint") for r in open_ranks[k]]) for k in keys])[slots]
    found = _locate(counted.withColumn("base", base), ["slot"], wanted)
    return {
        (keys[r["slot"]][0], r["rank"]): (r["lo"], r["hi"], r["before"])
        for r in found.select("slot", "rank", "lo", "hi", "before").collect()
    }


def _open_columns(cols: Sequence[str], keys: Sequence[tuple]) -> list[str]:
    """Columns that still have an open bracket, so that the others are not read."""
    return [cols[pos] for pos in sorted({k[0] for k in keys})]


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = QUARTILES) -> DataFrame:
    """``exact_quantiles`` as rows (column, prob, value)."""
    found = exact_quantiles(df, cols, probs)
    rows = [(c, float(p), v) for c in found for p, v in zip(probs, found[c])]
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")


def iqr_bounds(
    df: DataFrame, cols: Sequence[str], k: float = 1.5, rel_err: float | None = None
) -> dict[str, dict[str, float | None]]:
    """Q1, Q3, IQR and the bounds ``Q1 - k*IQR`` and ``Q3 + k*IQR`` of each column.

    ``rel_err`` switches to Spark's ``approxQuantile`` with that rank error.
    """
    if rel_err is None:
        found = exact_quantiles(df, cols, (0.25, 0.75))
    else:
        answers = df.approxQuantile(list(cols), [0.25, 0.75], rel_err)
        found = {c: a or [None, None] for c, a in zip(cols, answers)}
    bounds = {}
    for name, (q1, q3) in found.items():
        if q1 is None:
            bounds[name] = dict.fromkeys(("q1", "q3", "iqr", "lower", "upper"))
            continue
        iqr = q3 - q1
        bounds[name] = {"q1": q1, "q3": q3, "iqr": iqr, "lower": q1 - k * iqr, "upper": q3 + k * iqr}
    return bounds


def iqr_filter(df: DataFrame, col: str, k: float = 1.5, rel_err: float | None = None) -> DataFrame:
    """Keep rows whose ``col`` lies within the IQR bounds.

    The bounds become literals, so the filter reaches a Parquet scan as a pushed predicate. A
    frame without any value is returned as it is.
    """
    found = iqr_bounds(df, [col], k, rel_err)[col]
    if found["lower"] is None:
        return df
    return df.filter(F.col(col).between(found["lower"], found["upper"]))


def _outside(name: str, bound: dict[str, float | None]) -> Column:
    if bound["lower"] is None:
        return F.lit(False)
    return F.coalesce(~F.col(name).between(bound["lower"], bound["upper"]), F.lit(False))


def outlier_stats(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """One row per column: quartiles, IQR, bounds and the number of values outside them."""
    bounds = iqr_bounds(df, cols, k)
    counts = df.agg(*[F.count_if(_outside(c, b)).alias(c) for c, b in bounds.items()])
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.lit(b[s]).cast("double").alias(s) for s in ("q1", "q3", "iqr", "lower", "upper")],
            F.col(c).alias("outliers"),
        )
        for c, b in bounds.items()
    ]
    return counts.select(F.inline(F.array(*rows)))


def outlier_rows(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Rows in which at least one of the columns lies outside its IQR bounds."""
    bounds = iqr_bounds(df, cols, k)
    return df.filter(reduce(Column.__or__, [_outside(c, b) for c, b in bounds.items()]))


#: Size of a stored sketch (a few kilobytes) and the error in rank that its quantiles stay below.
SKETCH_SIZE = 400
SKETCH_RANK_ERROR = 0.02


def quantile_sketches(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """(by, sketch): a KLL sketch of the finite values per group, for storing.

    Sketches of days or parts can be merged for any period without the rows. A group without values
    has an empty sketch.
    """
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(finite_or_null(df, col).cast("double"), SKETCH_SIZE).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """One sketch per group of stored ones; merging loses no accuracy against a sketch of all rows."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", SKETCH_SIZE).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(by, prob, n, value): the values at ``probs``, their rank within ``SKETCH_RANK_ERROR``; null without values."""
    cells = [F.struct(F.lit(float(p)).alias("prob"), F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))).alias("value")) for p in probs]
    return sketches.withColumn("n", F.kll_sketch_get_n_double("sketch")).select(*by, "n", F.inline(F.array(*cells)))
