"""Feature building, regression training, a leaderboard and batch scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.columns import calendar_fields
from ledgerlight.operators import trees
from ledgerlight.operators.aggregates import daily_demand
from ledgerlight.operators.cleaning import fill_missing, parse_date, require_columns
from ledgerlight.operators.partitioning import hold, release, spread
from ledgerlight.operators.quality import regression_metrics
from ledgerlight.operators.series import lag_features

# Column names, feature lists and estimators that data files and records refer to.
FEATURES = ("Quantity", "Discount", "Tax", "ShippingCost", "Month", "DayOfWeek")
SCORING_COLUMNS = ("OrderDate", "Quantity", "Discount", "Tax", "ShippingCost")
DEMAND_NUMBERS = ("day_of_month", "day_of_week", "month", "year", "week_of_year", "lag_1_day_qty")

# Training rows per task, which each pass over a partition reads.
TASK_ROWS = 2**19


def add_features(df: DataFrame, date: str = "OrderDate", label: str | None = "TotalAmount") -> DataFrame:
    """Model inputs from order rows: doubles, month and day of week, null inputs as 0.

    Training and scoring both use this function, so the two cannot differ. The label is carried
    along if it is there; a missing one stays null. :func:`input_report` counts inputs that are
    text but no number.
    """
    df = parse_date(require_columns(df, SCORING_COLUMNS), date)
    numbers = [c for c in (*SCORING_COLUMNS[1:], label) if c in df.columns]
    df = df.withColumns({c: F.col(c).try_cast("double") for c in numbers})
    df = df.withColumns({"Month": F.month(date), "DayOfWeek": F.dayofweek(date)})
    return fill_missing(df, dict.fromkeys([*(c for c in numbers if c != label), "Month", "DayOfWeek"], 0))


def input_report(df: DataFrame, label: str = "TotalAmount") -> DataFrame:
    """One row: number of rows, and per input the values that are there but cannot be read."""
    cols = [c for c in (*SCORING_COLUMNS[1:], label) if c in df.columns]
    unread = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(f"unread_{c}") for c in cols]
    return df.agg(F.count(F.lit(1)).alias("rows"), *unread)


def demand_features(
    df: DataFrame, keys: Sequence[str] = ("ProductID", "State"), date: str = "OrderDate"
) -> DataFrame:
    """Daily demand per key with calendar fields and the quantity of the previous row."""
    daily = daily_demand(df, keys, date)
    daily = lag_features(daily, keys, "order_date", "daily_quantity", (1,), name="lag_{}_day_qty")
    return daily.withColumns(calendar_fields("order_date"))


def category_stages(cols: Sequence[str], hashed: Sequence[str] = (), buckets: int = 2**18) -> list:
    """Pipeline stages that turn category columns into vectors named ``<col>_vec``.

    A column gets an index and a one-hot vector; unseen values have a place of their own. Indexing
    keeps all values on the driver, so name columns whose values grow with the data in ``hashed``:
    they get one of ``buckets`` positions.
    """
    stages = []
    for c in cols:
        if c not in hashed:
            stages += [
                StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep", stringOrderType="alphabetAsc"),
                OneHotEncoder(inputCol=f"{c}_idx", outputCol=f"{c}_vec", handleInvalid="keep"),
            ]
        else:
            stages.append(
                FeatureHasher(inputCols=[c], outputCol=f"{c}_vec", numFeatures=buckets, categoricalCols=[c])
            )
    return stages


def demand_pipeline(keys: Sequence[str] = ("ProductID", "State"), hashed: Sequence[str] = ("ProductID",), **options) -> Pipeline:
    """Pipeline from :func:`demand_features` rows to a ``features`` vector; products are hashed."""
    assembler = VectorAssembler(
        inputCols=[*DEMAND_NUMBERS, *[f"{k}_vec" for k in keys]], outputCol="features", handleInvalid="keep"
    )
    return Pipeline(stages=[*category_stages(keys, hashed, **options), assembler])


def default_models(label: str = "TotalAmount", features: str = "scaledFeatures", seed: int = 42) -> dict[str, Estimator]:
    """The three regressors with their default parameters."""
    common = {"featuresCol": features, "labelCol": label}
    return {
        "Linear_Regression": LinearRegression(**common),
        "Random_Forest": RandomForestRegressor(**common, seed=seed),
        "Gradient_Boosting": GBTRegressor(**common, seed=seed),
    }


def train_all(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str] = FEATURES,
    label: str = "TotalAmount",
    models: Mapping[str, Estimator] | None = None,
) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Fit every model on ``train`` and rate it on ``test``: ``(models, leaderboard)``.

    The training rows are read once, kept while the models are fitted, and each model is
    returned as a full pipeline. They are spread evenly over partitions of at most ``TASK_ROWS`` rows,
    so a task of a fit reads no more where the table is larger. Forests and boosting read them once, to make
    the cells that :mod:`trees` grows them from. The leaderboard (model, rmse, mse,
    mae, r2) rates all models in one pass over the test rows.
    """
    models = dict(models or default_models(label))
    train = train.where(F.col(label).isNotNull()).select(*features, label)
    size = train.count()
    parts = max(-(-size // TASK_ROWS), train.sparkSession.sparkContext.defaultParallelism)
    # Held as plain columns: vectors take twice the space and are quickly made.
    rows = hold(spread(train, parts))
    steps = [
        VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error"),
        StandardScaler(inputCol="features", outputCol="scaledFeatures"),
    ]
    bins = {}
    try:
        try:
            prepare = Pipeline(stages=steps).fit(rows)
            vectors = prepare.transform(rows).select("scaledFeatures", label)
            grown = {name: (m.getMaxBins(), m.getOrDefault("seed")) for name, m in models.items() if trees.supported(m, vectors)}
            fitted = {name: model.fit(vectors) for name, model in models.items() if name not in grown}
            # The scaler's own products, without a vector per row.
            scale = [1 / s if s else 0.0 for s in prepare.stages[-1].std.toArray().tolist()]
            scaled = F.array(*[F.col(c).cast("double") * F.lit(s) for c, s in zip(features, scale)])
            for kind in set(grown.values()):
                bins[kind] = trees.binned(rows, scaled, label, size, parts, *kind)
        finally:
            release(rows)
        fitted |= {name: trees.fit(train.sparkSession, models[name], bins[kind]) for name, kind in grown.items()}
    finally:
        for cells in bins.values():
            cells.discard()
    pipelines = {name: PipelineModel(stages=[*prepare.stages, model]) for name, model in ((n, fitted[n]) for n in models)}
    return pipelines, leaderboard(pipelines, test, label)


def leaderboard(models: Mapping[str, PipelineModel], test: DataFrame, label: str = "TotalAmount") -> DataFrame:
    """Metrics of several models that share their preparation stages, best rmse first."""
    names = list(models)
    *prepare, _ = models[names[0]].stages
    rows = PipelineModel(stages=prepare).transform(test)
    for i, name in enumerate(names):
        last = models[name].stages[-1].copy()
        rows = last.setPredictionCol(f"p{i}").transform(rows)
    predictions = F.array(
        *[F.struct(F.lit(n).alias("model"), F.col(f"p{i}").alias("prediction")) for i, n in enumerate(names)]
    )
    long = rows.select(label, F.inline(predictions))
    return regression_metrics(long, label, "prediction", ["model"]).orderBy("rmse", "model")


def score(model: PipelineModel, df: DataFrame, date: str = "OrderDate") -> DataFrame:
    """Order rows with their features and a ``prediction`` column; the whole frame, no sample."""
    scored = model.transform(add_features(df, date))
    return scored.drop("features", "scaledFeatures")
