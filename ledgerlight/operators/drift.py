"""Drift of input columns between periods, from histograms that add up.

The bins of a column are the quantiles of its baseline period. Counts per (period, column, bin)
are combined before the shuffle and are all that is kept: histograms of days can be stored and summed
to any period. Two histograms are compared by the population stability index and by the largest
distance of their distribution functions at the bin edges (two-sample Kolmogorov-Smirnov).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.operators.quantiles import quantile_table

DECILES = tuple(i / 10 for i in range(1, 10))
#: Bin of missing values.
MISSING = -1


def baseline_edges(baseline: DataFrame, cols: Sequence[str], probs: Sequence[float] = DECILES, digits: int = 6) -> dict[str, list[float]]:
    """Distinct rounded quantiles per column; a column without values has no edges, so one bin."""
    found: dict[str, set[float]] = {c: set() for c in cols}
    for r in quantile_table(baseline, cols, probs).select("column", F.round("value", digits).alias("value")).collect():
        if r.value is not None:
            found[r.column].add(r.value)
    return {c: sorted(v) for c, v in found.items()}


def period_histograms(df: DataFrame, period: Column, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """(period, column, bin, n): bin k holds values above k edges, -1 the missing ones. One scan."""

    def bin_of(c: str) -> Column:
        above = sum((F.when(F.col(c) > e, 1).otherwise(0) for e in edges[c]), F.lit(0))
        return F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), MISSING).otherwise(above)

    cells = F.inline(F.array(*(F.struct(F.lit(c).alias("column"), bin_of(c).alias("bin")) for c in edges)))
    return df.select(period.alias("period"), cells).groupBy("period", "column", "bin").agg(F.count(F.lit(1)).alias("n"))


def distribution_drift(histograms: DataFrame, baseline: Column, edges: Mapping[str, Sequence[float]], max_psi: float = 0.2) -> DataFrame:
    """(period, column, rows, missing, psi, ks, alert) against the summed histograms where ``baseline`` is true.

    Every bin counts half a row more in the index, so an empty one does not make it infinite. The
    distance leaves missing values out; it is null where a side has no values.
    """
    bins = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(b).alias("bin"), F.lit(len(e) + 2).alias("bins")) for c, e in edges.items() for b in range(MISSING, len(e) + 1))))
    summed = histograms.groupBy("period", "column", "bin").agg(F.sum("n").alias("n"))
    base = histograms.where(baseline).groupBy("column", "bin").agg(F.sum("n").alias("m"))
    grid = summed.select("period").distinct().select("period", bins.alias("b")).select("period", "b.*")
    cells = grid.join(summed, ["period", "column", "bin"], "left").join(base, ["column", "bin"], "left").fillna(0, ["n", "m"])
    whole = Window.partitionBy("period", "column")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    present = {s: F.when(F.col("bin") > MISSING, F.col(s)).otherwise(0) for s in "nm"}
    half = {s: (F.col(s) + 0.5) / (F.sum(s).over(whole) + F.col("bins") * 0.5) for s in "nm"}
    share = {s: F.try_divide(F.sum(present[s]).over(upto), F.sum(present[s]).over(whole)) for s in "nm"}
    rated = cells.select("period", "column", "bin", "n", half["n"].alias("p"), half["m"].alias("q"), F.abs(share["n"] - share["m"]).alias("gap"))
    index = F.sum((F.col("p") - F.col("q")) * F.log(F.col("p") / F.col("q")))
    return (
        rated.groupBy("period", "column")
        .agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("bin") == MISSING, F.col("n")).otherwise(0)).alias("missing"), index.alias("psi"), F.max("gap").alias("ks"))
        .withColumn("alert", F.col("psi") > max_psi)
    )
