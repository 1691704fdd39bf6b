import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from __spark_entry__ import queries
from ledgerlight.operators import models, trees
from ledgerlight.operators.effects import fit_effects
from ledgerlight.operators.partitioning import partition_counts
from ledgerlight.operators.sampling import split
from ledgerlight.sources import readers, schemas, sinks
from ledgerlight.sources.sales import sales_view


@pytest.fixture(scope="module")
def data(spark):
    """Orders whose amount follows from the inputs, so that there is something to learn."""
    df = sales_view(spark, "/root/testdata/sf0.001", ["OrderID", *models.SCORING_COLUMNS])
    amount = 20 * F.col("Quantity") - 100 * F.col("Discount") + 30 * F.col("Tax") + 2 * F.col("ShippingCost") + 5
    return split(models.add_features(df.withColumn("TotalAmount", amount + F.month("OrderDate"))), ["OrderID"])


@pytest.fixture(scope="module")
def trained(data):
    small = dict(featuresCol="scaledFeatures", labelCol="TotalAmount")
    wanted = {
        "Linear_Regression": LinearRegression(**small),
        "Random_Forest": RandomForestRegressor(**small, numTrees=5, seed=42),
        "Gradient_Boosting": GBTRegressor(**small, maxIter=3, seed=42),
    }
    return models.train_all(*data, models=wanted)


def test_leaderboard(trained, data):
    fitted, board = trained
    rows = {r.model: r for r in board.collect()}
    assert list(rows)[0] == "Linear_Regression" and rows["Linear_Regression"].rmse < 1e-6
    assert set(rows) == set(fitted)
    for name in ("Random_Forest", "Gradient_Boosting"):
        predictions = fitted[name].transform(data[1])
        for metric in ("rmse", "mse", "mae", "r2"):
            value = RegressionEvaluator(labelCol="TotalAmount", metricName=metric).evaluate(predictions)
            assert rows[name][metric] == pytest.approx(value, rel=1e-9)


def test_fits_read_bounded_partitions(spark, monkeypatch):
    sizes = []

    class Counting(LinearRegression):
        def _fit(self, dataset):
            sizes.extend(r.rows for r in partition_counts(dataset).collect())
            return super()._fit(dataset)

    monkeypatch.setattr(models, "TASK_ROWS", 100, raising=False)
    cells = [(F.col("id") % (i + 2)).cast("double").alias(c) for i, c in enumerate(models.FEATURES)]
    train = spark.range(0, 5000, 1, 2).select(*cells, F.when(F.col("id") % 10 > 0, F.col("id") * 2.0).alias("TotalAmount"))
    wanted = {"Linear_Regression": Counting(featuresCol="scaledFeatures", labelCol="TotalAmount")}
    models.train_all(train, train, models=wanted)
    assert sum(sizes) == 4500 and max(sizes) <= 150


@pytest.fixture(scope="module")
def noisy(spark):
    """Vectors of unlike features (few values, many values, none that varies) and a label that follows from them."""
    rng = np.random.default_rng(3)
    n = 4000
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), rng.integers(0, 60, n), np.zeros(n), rng.exponential(size=n)])
    y = 3 * x[:, 0] + np.where(x[:, 1] > 2, 10, 0) * x[:, 4] + np.sin(x[:, 2]) + rng.normal(size=n)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, d double, e double, y double")
    return VectorAssembler(inputCols=list("abcde"), outputCol="f").transform(df).select("f", "y").repartition(20).cache()


def _predictions(model, df):
    return np.array([r.prediction for r in model.transform(df).select("prediction").collect()])


@pytest.mark.parametrize("local", [True, False])
def test_trees_are_sparks(spark, noisy, monkeypatch, local):
    """Without random draws the trees are those of Spark's growers, on the driver and in passes over stored cells."""
    if not local:
        monkeypatch.setattr(trees, "LOCAL_ROWS", 0)
        monkeypatch.setattr(trees, "LOCAL_GROUPS", 0)
    common = dict(featuresCol="f", labelCol="y", seed=7)
    data = trees.binned(noisy, vector_to_array("f"), "y", 4000, 20, 32, 7)
    assert isinstance(data.blocks, list) == local
    for estimator in (
        GBTRegressor(**common, maxIter=3, maxDepth=4, minInstancesPerNode=5, stepSize=0.3),
        RandomForestRegressor(**common, numTrees=2, bootstrap=False, featureSubsetStrategy="all", maxMemoryInMB=0 if local else 256),
    ):
        ours, theirs = trees.fit(spark, estimator, data), estimator.copy({estimator.maxMemoryInMB: 256}).fit(noisy)
        np.testing.assert_allclose(_predictions(ours, noisy), _predictions(theirs, noisy), rtol=1e-9)
        assert (ours.totalNumNodes, ours.uid, ours.getMaxDepth(), ours.treeWeights) == (theirs.totalNumNodes, estimator.uid, theirs.getMaxDepth(), theirs.treeWeights)
        np.testing.assert_allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=0.01)
    data.discard()


def test_training_takes_no_row_objects(spark, data, monkeypatch):
    """Spark's growers, which keep each row as an object, are not called; the forest is as good as theirs."""
    forest = RandomForestRegressor(featuresCol="scaledFeatures", labelCol="TotalAmount", seed=42)
    steps = models.Pipeline(stages=[VectorAssembler(inputCols=list(models.FEATURES), outputCol="features"), models.StandardScaler(inputCol="features", outputCol="scaledFeatures"), forest])
    reference = models.leaderboard({"f": steps.fit(data[0])}, data[1]).first()

    def refuse(self, dataset):
        raise AssertionError("rows become objects")

    for kind in (RandomForestRegressor, GBTRegressor):
        monkeypatch.setattr(kind, "_fit", refuse)
    got = models.train_all(*data, models={"f": forest, "g": GBTRegressor(featuresCol="scaledFeatures", labelCol="TotalAmount", maxIter=2, seed=42)})[1]
    rows = {r.model: r for r in got.collect()}
    assert rows["f"].rmse == pytest.approx(reference.rmse, rel=0.15) and rows["g"].rows == reference.rows


def test_cells_have_the_scalers_values(spark, data):
    """Predictions of a grown model meet its thresholds on the vectors that the scaler makes."""
    one = GBTRegressor(featuresCol="scaledFeatures", labelCol="TotalAmount", maxIter=2, seed=42)
    fitted = models.train_all(*data, models={"g": one})[0]["g"]
    vectors = models.PipelineModel(stages=fitted.stages[:-1]).transform(data[0])
    reference = one.fit(vectors)
    assert _predictions(reference, vectors) == pytest.approx(_predictions(fitted.stages[-1], vectors), rel=1e-9)


def test_equal_bins_become_one_group(spark, monkeypatch):
    monkeypatch.setattr(trees, "LOCAL_ROWS", 0)
    df = spark.range(0, 6000, 1, 6).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"), (F.col("id") + 0.5).alias("y"))
    data = trees.binned(df, F.array("a", "b"), "y", 6000, 6, 32, 1)
    groups = trees.grouped(data)
    n, mean, around = np.concatenate([c[2] for c in groups.blocks], axis=1)
    y = np.arange(6000) + 0.5
    assert len(n) == 21 and n.sum() == 6000
    assert (n * mean).sum() == pytest.approx(y.sum()) and (around + n * mean**2).sum() == pytest.approx((y**2).sum())
    data.discard()


def test_bootstrap_counts_follow_poisson():
    from math import exp, factorial

    cuts = trees._poisson_cuts(1.0)
    counts = np.concatenate([trees._draws(*cuts, 42, 3, block, 100_000) for block in range(10)])
    shares = np.bincount(counts, minlength=6) / len(counts)
    np.testing.assert_allclose(shares[:6], [exp(-1) / factorial(k) for k in range(6)], atol=2e-3)
    assert (trees._draws(*cuts, 42, 3, 0, 100_000) == counts[:100_000]).all()


def test_linear_model_solves_the_normal_equations(trained, data):
    train, test = data
    matrix = lambda df: np.array(df.select(*models.FEATURES, "TotalAmount").collect(), dtype=float)
    a, b = matrix(train), matrix(test)
    design = lambda m: np.column_stack([m[:, :-1], np.ones(len(m))])
    beta = np.linalg.lstsq(design(a), a[:, -1], rcond=None)[0]
    got = [r.prediction for r in trained[0]["Linear_Regression"].transform(test).select("prediction").collect()]
    np.testing.assert_allclose(got, design(b) @ beta, rtol=1e-6)


def test_saved_model_scores_alike(spark, trained, data, tmp_path):
    path = f"file:{tmp_path}/model"
    sinks.save_model(trained[0]["Gradient_Boosting"], path)
    raw = sales_view(spark, "/root/testdata/sf0.001", ["OrderID", *models.SCORING_COLUMNS])
    before = models.score(trained[0]["Gradient_Boosting"], raw)
    after = models.score(readers.load_model(path), raw)
    assert after.count() == raw.count()
    assert before.select("OrderID", "prediction").exceptAll(after.select("OrderID", "prediction")).count() == 0
    with pytest.raises(ValueError):
        sinks.save_model(trained[0]["Gradient_Boosting"], str(tmp_path))


def test_score_one_row_and_nulls(spark, trained):
    from datetime import date

    one = readers.frame_from_rows(spark, [(date(2024, 5, 1), 3.0, None, 0.0, 1.0)], schemas.SCORING)
    row = models.score(trained[0]["Linear_Regression"], one).first()
    assert row.prediction == pytest.approx(20 * 3 + 2 + 5 + 5, rel=1e-6) and row.Discount == 0.0


def test_scoring_names_missing_columns(spark, trained):
    with pytest.raises(ValueError, match="Quantity, Discount, Tax, ShippingCost"):
        models.score(trained[0]["Linear_Regression"], spark.sql("SELECT date '2024-01-01' AS OrderDate"))


def test_unseen_and_many_categories(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "c string, y double")
    for hashed in ((), ("c",)):
        stages = models.category_stages(["c"], hashed, buckets=16)
        frame = train
        for stage in stages:
            frame = (stage.fit(frame) if hasattr(stage, "fit") else stage).transform(frame)
        assert "c_vec" in frame.columns
    from pyspark.ml import Pipeline

    fitted = Pipeline(stages=models.category_stages(["c"])).fit(train)
    vectors = [fitted.transform(spark.createDataFrame([(c, 0.0)], "c string, y double")).first().c_vec for c in ("a", "b", "new")]
    assert [list(v.indices) for v in vectors] == [[0], [1], [2]]


def test_effects_are_least_squares(spark):
    """Against all indicator columns at once; states are collinear, a position is unseen, a year constant."""
    from pyspark.ml import Pipeline

    rng = np.random.default_rng(5)
    n = 600
    p, s, x, held = rng.integers(0, 40, n), rng.integers(0, 4, n), rng.normal(1995, 2, (n, 2)), rng.random(n) < 0.2
    y = 3 * x[:, 0] - x[:, 1] + p * 0.5 + s + rng.normal(0, 5, n)
    held |= p == 39
    rows = [(str(a), f"s{b}", float(c), float(d), 7.0, float(e), bool(h)) for a, b, (c, d), e, h in zip(p, s, x, y, held)]
    df = spark.createDataFrame(rows, "p string, s string, a double, b double, c double, y double, held boolean")
    stages = Pipeline(stages=models.category_stages(["p", "s"], ["p"], buckets=2**16)).fit(df.where("NOT held"))
    lr = LinearRegression(featuresCol="inputs", labelCol="y", solver="normal", tol=1e-12, maxIter=500)
    fitted = fit_effects(stages.transform(df.where("NOT held")), ["a", "b", "c", "s_vec"], "p_vec", lr)
    got = np.array([r.prediction for r in fitted.transform(stages.transform(df)).orderBy("a", "b").select("prediction").collect()])
    design = np.column_stack([x - 1995, np.eye(4)[s], np.eye(40)[p]])
    beta = np.linalg.lstsq(design[~held], y[~held], rcond=None)[0]
    order = np.lexsort((x[:, 1], x[:, 0]))
    known = (p != 39)[order]
    np.testing.assert_allclose(got[known], (design @ beta)[order][known], rtol=1e-7)
    # Gradient steps, run until nothing changes, also agree on the position that was never seen.
    steps = LinearRegression(featuresCol="features", labelCol="y", solver="l-bfgs", tol=1e-14, maxIter=2000)
    whole = Pipeline(stages=[*stages.stages, VectorAssembler(inputCols=["a", "b", "c", "s_vec", "p_vec"], outputCol="features"), steps])
    slow = [r.prediction for r in whole.fit(df.where("NOT held")).transform(df).orderBy("a", "b").select("prediction").collect()]
    np.testing.assert_allclose(got, slow, rtol=1e-4)


def test_demand_solver_iterates_on_few_rows(spark, sf, monkeypatch):
    """The solver gets cross products, a row per input, however many rows the table has."""
    sizes, fit = [], LinearRegression._fit

    def counting(self, dataset):
        sizes.append(dataset.count())
        return fit(self, dataset)

    monkeypatch.setattr(LinearRegression, "_fit", counting)
    (row,) = queries()["demand_model"](spark, sf).collect()
    assert row.converged and row.rows > 1000 and row.rmse == pytest.approx(14.8142, abs=1e-3)
    assert sizes and max(sizes) < 50


@pytest.mark.parametrize("name", ["score_batch", "trained_model_health", "demand_model", "model_leaderboard"])
def test_model_queries(spark, sf, name):
    rows = queries()[name](spark, sf).collect()
    assert rows
    if name == "model_leaderboard":
        assert {r.model for r in rows} == {"Linear_Regression", "Random_Forest", "Gradient_Boosting"}
