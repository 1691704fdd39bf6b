"""Training, comparison, scoring and health of demand models."""

from __future__ import annotations

import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from ledgerlight.functions.staging import stage, staging_folder
from ledgerlight.operators import encoding, models
from ledgerlight.operators.cleaning import clean_orders
from ledgerlight.operators.effects import fit_effects
from ledgerlight.operators.quality import model_health, regression_metrics
from ledgerlight.operators.sampling import hash_split, split
from ledgerlight.plans.sql import CLEAN, SALES, bucket
from ledgerlight.sources.readers import load_model
from ledgerlight.sources.sales import raw_orders, sales_view, table
from ledgerlight.sources.sinks import save_model


def _orders(spark, sf):
    return clean_orders(raw_orders(spark, sf))


def _split(spark, sf):
    return split(models.add_features(_orders(spark, sf)), ["OrderID"])


def _linear(train) -> PipelineModel:
    wanted = {"Linear_Regression": models.default_models()["Linear_Regression"]}
    return models.train_all(train, train, models=wanted)[0]["Linear_Regression"]


def _learning_rows(orders):
    """What training and rating read of the orders: inputs, label and the side of the split."""
    marked = hash_split(models.add_features(orders), ["OrderID"], name="_train")
    return marked.select(*models.FEATURES, "TotalAmount", "_train")


def _leaderboard(spark, sf):
    rows = clean_orders(raw_orders(spark, sf), shape=_learning_rows)
    return models.train_all(rows.filter("_train").drop("_train"), rows.filter("NOT _train").drop("_train"))[1]


def _leaderboard_rows(spark, sf):
    """How many held-out orders each model was rated on."""
    return _leaderboard(spark, sf).select("model", "rows")


def _score(spark, sf):
    train, test = _split(spark, sf)
    return models.score(_linear(train), test).select("OrderID", "TotalAmount", "prediction")


def _trained_health(spark, sf):
    train, test = _split(spark, sf)
    scored = models.score(_linear(train), test)
    return model_health(regression_metrics(scored, "TotalAmount", "prediction"))


def _demand(spark, sf):
    daily = models.demand_features(
        sales_view(spark, sf, ["OrderDate", "ProductID", "State", "Quantity", "TotalAmount"])
    ).withColumn("ProductID", F.col("ProductID").cast("string"))
    # Stored with its side of the split: indexing, the fit and the rating read it.
    daily = stage(hash_split(daily, ["order_date", "ProductID", "State"], name="_train"), "daily-demand")
    train, test = daily.filter("_train").drop("_train"), daily.filter("NOT _train").drop("_train")
    features = models.demand_pipeline().fit(train)
    # An effect per product position is eliminated exactly; the solver iterates on cross products, not on rows.
    model = LinearRegression(featuresCol="inputs", labelCol="daily_quantity", solver="normal", maxIter=500, tol=1e-12)
    fitted = fit_effects(features.transform(train), [*models.DEMAND_NUMBERS, "State_vec"], "ProductID_vec", model)
    converged = fitted.linear.summary.totalIterations < model.getMaxIter()
    scored = fitted.transform(features.transform(test))
    return regression_metrics(scored, "daily_quantity", "prediction").withColumns(
        {"model": F.lit("Linear_Regression"), "converged": F.lit(converged)}
    )


def _line(spark, sf):
    """A one-feature fit, saved, loaded and scored: what SQL can compute in closed form."""
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("Quantity"), F.col("l_extendedprice").alias("TotalAmount"))
    steps = [VectorAssembler(inputCols=["Quantity"], outputCol="features"), LinearRegression(featuresCol="features", labelCol="TotalAmount", solver="normal")]
    path = f"{staging_folder(spark)}/ledgerlight/line-{uuid.uuid4().hex}"
    path = path if ":" in path.split("/", 1)[0] else f"file:{path}"
    save_model(Pipeline(stages=steps).fit(rows), path)
    loaded = load_model(path)
    fit = loaded.stages[-1]
    metrics = regression_metrics(loaded.transform(rows), "TotalAmount", "prediction")
    return model_health(metrics, 1e9).select(
        F.lit(round(fit.coefficients[0], 4)).alias("slope"), F.lit(round(fit.intercept, 4)).alias("intercept"),
        F.round("rmse", 4).alias("rmse"), F.round("r2", 9).alias("r2"), "status",
    )


def _scaled(spark, sf):
    """Scaled features of every line: what the preparation stages hand to the models."""
    rows = sales_view(spark, sf, ["OrderID", "Quantity", "Tax"]).withColumn("Quantity", F.col("Quantity").cast("double"))
    steps = [VectorAssembler(inputCols=["Quantity", "Tax"], outputCol="features"), StandardScaler(inputCol="features", outputCol="scaled")]
    rows = stage(rows, "unscaled")
    cells = vector_to_array("scaled")
    return Pipeline(stages=steps).fit(rows).transform(rows).select("OrderID", F.round(cells[0], 9).alias("quantity"), F.round(cells[1], 9).alias("tax"))


def _one_split(spark, sf):
    """Trees of one split over a feature with few values, so that SQL can try every threshold."""
    rows = sales_view(spark, sf, ["Quantity", "TotalAmount"]).withColumn("Quantity", F.col("Quantity").cast("double"))
    common = {"featuresCol": "features", "labelCol": "TotalAmount", "maxDepth": 1, "maxBins": 64, "seed": 42}
    trees = {"Random_Forest": RandomForestRegressor(**common, numTrees=1, bootstrap=False, featureSubsetStrategy="all"), "Gradient_Boosting": GBTRegressor(**common, maxIter=1)}
    vectors = stage(rows, "one-feature")
    prepared = VectorAssembler(inputCols=["Quantity"], outputCol="features").transform(vectors)
    parts = [t.fit(prepared).transform(prepared).withColumn("model", F.lit(name)) for name, t in trees.items()]
    groups = parts[0].unionByName(parts[1]).groupBy("model", F.round("prediction", 4).alias("prediction"))
    return groups.agg(F.count(F.lit(1)).alias("rows"), F.min("Quantity").alias("low"), F.max("Quantity").alias("high"))


def _one_feature(spark, sf):
    """Training and held-out lines with one feature, and the fitted linear model."""
    view = stage(sales_view(spark, sf, ["OrderID", "OrderDate", "Quantity", "TotalAmount"]), "lines")
    train, test = split(view.withColumn("Quantity", F.col("Quantity").cast("double")), ["OrderID"])
    linear = LinearRegression(featuresCol="scaledFeatures", labelCol="TotalAmount", solver="normal")
    fitted, board = models.train_all(train, test, ["Quantity"], models={"Linear_Regression": linear})
    return fitted["Linear_Regression"], test, board


def _leaderboard_values(spark, sf):
    digits = {"rmse": 4, "mse": 0, "mae": 4, "r2": 9}
    return _one_feature(spark, sf)[2].withColumns({c: F.round(c, d) for c, d in digits.items()})


def _score_values(spark, sf):
    model, test, _ = _one_feature(spark, sf)
    return model.transform(test).select("OrderID", F.round("prediction", 4).alias("prediction"))


def _category_codes(spark, sf):
    """Every product name's number and rows, from a dictionary that is a table."""
    return encoding.category_dictionary(sales_view(spark, sf, ["ProductName"]), "ProductName")


def _encoded(spark, sf):
    """Lines with the numbers of a dictionary that knows only some cities; the others share the next number."""
    view = stage(sales_view(spark, sf, ["OrderID", "OrderDate", "City"]), "cities")
    known = encoding.category_dictionary(view.where("City < 'NATION_3'"), "City")
    return encoding.encode(view, known, "City").select("OrderID", "City_idx")


QUERIES = {
    "scaled_features": _scaled,
    "one_split_trees": _one_split,
    "leaderboard_values": _leaderboard_values,
    "score_values": _score_values,
    "category_codes": _category_codes,
    "encoded_cities": _encoded,
    "model_leaderboard": _leaderboard,
    "leaderboard_rows": _leaderboard_rows,
    "score_batch": _score,
    "trained_model_health": _trained_health,
    "demand_model": _demand,
    "line_fit_saved": _line,
}

_HELD_OUT = f"""WITH v AS (SELECT "OrderID", CAST("Quantity" AS DOUBLE) AS x, "TotalAmount" AS y, {bucket('"OrderID"')} < {int(0.8 * 2**32)} AS train FROM ({SALES})),
  fit AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM v WHERE train),
  t AS (SELECT "OrderID", a + b * x AS prediction, y, y - a - b * x AS e FROM v, fit WHERE NOT train)"""

ORACLES: dict[str, str] = {
    "scaled_features": f"""SELECT "OrderID", ROUND("Quantity" / stddev_samp("Quantity") OVER (), 9) AS quantity, ROUND("Tax" / stddev_samp("Tax") OVER (), 9) AS tax FROM ({SALES})""",
    # The threshold with the least squared error: the largest n * mean^2 summed over both sides.
    "one_split_trees": f"""WITH v AS (SELECT CAST("Quantity" AS DOUBLE) AS x, "TotalAmount" AS y FROM ({SALES})),
      g AS (SELECT x, count(*) AS n, sum(y) AS s FROM v GROUP BY x),
      c AS (SELECT x, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(n) OVER () AS m, sum(s) OVER () AS t FROM g WINDOW w AS (ORDER BY x)),
      best AS (SELECT x AS threshold FROM c WHERE n < m ORDER BY s * s / n + (t - s) * (t - s) / (m - n) DESC LIMIT 1)
      SELECT model, ROUND(AVG(y), 4) AS prediction, count(*) AS rows, min(x) AS low, max(x) AS high
      FROM v, best, (VALUES ('Random_Forest'), ('Gradient_Boosting')) k(model) GROUP BY model, x <= threshold""",
    "leaderboard_values": _HELD_OUT + """ SELECT 'Linear_Regression' AS model, COUNT(*) AS rows, ROUND(sqrt(AVG(e * e)), 4) AS rmse, ROUND(AVG(e * e), 0) AS mse,
        ROUND(AVG(abs(e)), 4) AS mae, ROUND(1 - SUM(e * e) / (VAR_POP(y) * COUNT(*)), 9) AS r2 FROM t""",
    "score_values": _HELD_OUT + """ SELECT "OrderID", ROUND(prediction, 4) AS prediction FROM t""",
    "category_codes": f"""SELECT "ProductName" AS value, dense_rank() OVER (ORDER BY "ProductName") - 1 AS index, COUNT(*) AS rows FROM ({SALES}) GROUP BY 1""",
    "encoded_cities": f"""WITH v AS (SELECT "OrderID", "City" FROM ({SALES})),
      k AS (SELECT "City", dense_rank() OVER (ORDER BY "City") - 1 AS i FROM (SELECT DISTINCT "City" FROM v WHERE "City" < 'NATION_3'))
      SELECT "OrderID", coalesce(i, (SELECT count(*) FROM k)) AS "City_idx" FROM v LEFT JOIN k USING ("City")""",
    "leaderboard_rows": f"""
        SELECT model, COUNT(*) AS rows FROM ({CLEAN}), (VALUES ('Linear_Regression'), ('Random_Forest'), ('Gradient_Boosting')) m(model)
        WHERE NOT {bucket('"OrderID"')} < {int(0.8 * 2**32)} GROUP BY 1""",
    "line_fit_saved": """
        WITH fit AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
        e AS (SELECT l_extendedprice AS y, l_extendedprice - a - b * l_quantity AS d FROM lineitem, fit)
        SELECT ROUND(any_value(b), 4) AS slope, ROUND(any_value(a), 4) AS intercept, ROUND(sqrt(AVG(d * d)), 4) AS rmse,
          ROUND(1 - SUM(d * d) / (VAR_POP(y) * COUNT(*)), 9) AS r2, 'HEALTHY' AS status FROM e, fit""",
}
