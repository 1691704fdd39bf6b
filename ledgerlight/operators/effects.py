"""Linear regression with an effect per category position, exact in two passes over the rows.

Gradient steps over hashed categories read all rows once per step. Here the effects are eliminated
first: with the mean of its position taken off every value, the least squares problem has only the
other inputs left, and the effects follow from its solution and the means. The cross products of
those differences are what all rows have less what the positions' means have, so two aggregates
settle them, and no row is joined or shuffled while fitting.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.staging import stage


def _position(vector: str) -> Column:
    """Where a one-hot or hashed vector holds its value; -1 for one without a value."""
    return F.coalesce(F.get(F.unwrap_udt(vector)["indices"], F.lit(0)), F.lit(-1))


def cross_products(df: DataFrame, values: str, weight: str, center: np.ndarray) -> np.ndarray:
    """The weighted sums of products of all pairs of the array's entries, ``center`` taken off first.

    Each task keeps one matrix; Spark adds them up entry by entry.
    """
    k = len(center)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            off = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k) - center
            total += off.T @ (off * batch.column(1).to_numpy(zero_copy_only=False)[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["at", "part"])

    parts = df.select(values, F.col(weight).cast("double")).mapInArrow(run, "at long, part double")
    sums = {r["at"]: r["total"] for r in parts.groupBy("at").agg(F.sum("part").alias("total")).collect()}
    return np.array([sums.get(i, 0.0) for i in range(k * k)]).reshape(k, k)


@dataclass(frozen=True)
class EffectsModel:
    """A linear model of ``inputs`` plus an effect per position of the vector ``category``."""

    inputs: tuple[str, ...]
    category: str
    linear: LinearRegressionModel
    effects: DataFrame
    intercept: float

    def transform(self, df: DataFrame) -> DataFrame:
        """Rows with their ``prediction``; a position that was not fitted has no effect."""
        rows = self.linear.transform(_assembler(self.inputs, self.linear.getFeaturesCol()).transform(df))
        name = self.linear.getPredictionCol()
        rows = rows.withColumn("_position", _position(self.category)).join(F.broadcast(self.effects), "_position", "left")
        value = F.col(name) + F.coalesce("_effect", F.lit(0.0)) + F.lit(self.intercept)
        return rows.withColumn(name, value).drop("_position", "_effect", self.linear.getFeaturesCol())


def _assembler(inputs: Sequence[str], name: str) -> VectorAssembler:
    return VectorAssembler(inputCols=list(inputs), outputCol=name, handleInvalid="keep")


def fit_effects(df: DataFrame, inputs: Sequence[str], category: str, estimator: LinearRegression) -> EffectsModel:
    """Least squares on numbers and vectors (``inputs``) with a free effect per position of ``category``.

    ``category`` is a vector with at most one value, from one-hot or feature hashing; rows without
    a value share one effect. The estimator solves what is left without the effects. Where they are
    free to move against the intercept, their mean, weighted as gradient steps from zero leave it, is zero.
    The driver holds the cross products of the inputs; the effects stay a table, one row per position.
    """
    features, label = estimator.getFeaturesCol(), estimator.getLabelCol()
    rows = _assembler(inputs, features).transform(df).where(F.col(label).isNotNull())
    k = rows.schema[features].metadata["ml_attr"]["num_attrs"]
    values = F.array_append(vector_to_array(features), F.col(label).cast("double"))
    # Stored: two aggregates read it, and making vectors costs more than either.
    rows = stage(rows.select(_position(category).alias("_position"), values.alias("values")), "effect-rows").withColumn("weight", F.lit(1.0))
    names = [f"s{i}" for i in range(k + 1)]
    sums = rows.groupBy("_position").agg(F.sum("weight").alias("weight"), *[F.sum(F.get("values", F.lit(i))).alias(s) for i, s in enumerate(names)])
    sums = stage(sums, "effect-sums")
    n, *totals = sums.agg(F.sum("weight"), *[F.sum(s) for s in names]).first()
    if not n:
        raise ValueError("no rows to fit")
    center = np.array(totals) / n
    every = cross_products(rows, "values", "weight", center)
    means = sums.select(F.array(*[F.col(s) / F.col("weight") for s in names]).alias("values"), "weight")
    within = (every - cross_products(means, "values", "weight", center)) / n
    if not np.isfinite(within).all():
        raise ValueError("inputs and label must be finite")
    # What does not vary within any position is part of its effect; what is left there is rounding.
    fixed = np.diag(within) <= 1e-12 * np.diag(every) / n
    within[fixed] = within[:, fixed] = 0.0
    size, direction = np.linalg.eigh(within)
    # A table of k + 1 rows with the same cross products has the same least squares solution.
    factor = np.sqrt(np.where(size > 1e-14 * size[-1], size, 0.0))[:, None] * direction.T
    factor[:, fixed] = 0.0
    reduced = df.sparkSession.createDataFrame([(Vectors.dense(r[:-1]), float(r[-1])) for r in factor], [features, label])
    linear = estimator.copy({estimator.fitIntercept: False}).fit(reduced)
    explained = [F.col(s) * F.lit(float(b)) for s, b in zip(names, linear.coefficients) if b]
    effect = sum((-e for e in explained), F.col(names[-1])) / F.col("weight")
    effects = sums.select("_position", effect.alias("_effect"), "weight")
    free = F.col("weight") * (F.lit(n) - F.col("weight"))
    moved = F.coalesce(F.try_divide(F.sum(F.col("_effect") * free), F.sum(free)), F.avg("_effect"))
    intercept = effects.agg(moved).first()[0]
    effects = effects.select("_position", (F.col("_effect") - F.lit(intercept)).alias("_effect"))
    return EffectsModel(tuple(inputs), category, linear, effects, intercept)
