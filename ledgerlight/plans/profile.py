"""Column statistics of order lines and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.functions.staging import stage
from ledgerlight.operators import profile, quantiles
from ledgerlight.plans.sql import SALES
from ledgerlight.sources.sales import sales_view, table

MEASURES = ("TotalAmount", "Quantity", "Discount", "ShippingCost")
NUMBERS = ("Quantity", "UnitPrice", "Discount", "Tax", "ShippingCost", "TotalAmount")
QUARTILES = (0.25, 0.5, 0.75)
TEXTS = ("ProductName", "Category", "PaymentMethod", "State", "OrderDate")


def _round(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _staged(spark, sf, cols):
    """Joined once and written, because quantile searches and histograms read its columns several times."""
    return stage(sales_view(spark, sf, cols), "measures")


def _events(spark, sf):
    return table(spark, sf, "events")


QUERIES = {
    "describe_typed": lambda spark, sf: _round(
        profile.describe_typed(sales_view(spark, sf, MEASURES), MEASURES), 6, "mean", "stddev"
    ),
    "describe_text": lambda spark, sf: profile.describe_text(sales_view(spark, sf, TEXTS), TEXTS),
    "describe_quartiles": lambda spark, sf: _round(
        profile.describe_typed(_staged(spark, sf, MEASURES), MEASURES, quartiles=True),
        6, "mean", "stddev", "q25", "q50", "q75",
    ),
    "quantiles": lambda spark, sf: _round(
        quantiles.quantile_table(_staged(spark, sf, NUMBERS), NUMBERS), 6, "value"
    ),
    "outlier_stats": lambda spark, sf: _round(
        quantiles.outlier_stats(_events(spark, sf), ["value", "user_id"]), 6, "q1", "q3", "iqr", "lower", "upper"
    ),
    "outlier_rows": lambda spark, sf: quantiles.outlier_rows(_events(spark, sf), ["value", "user_id"]).select(
        "event_id", "user_id", "value"
    ),
    "skew_kurtosis": lambda spark, sf: _round(
        profile.shape_stats(_events(spark, sf), ["value", "user_id"]), 9, "skewness", "kurtosis"
    ),
    "correlation_matrix": lambda spark, sf: _round(
        profile.corr_matrix(sales_view(spark, sf, NUMBERS), NUMBERS), 9, "corr"
    ),
    "histogram": lambda spark, sf: _round(profile.histogram(_events(spark, sf), "value"), 6, "low", "high"),
    "histogram_all": lambda spark, sf: _round(
        profile.histogram(_staged(spark, sf, NUMBERS), NUMBERS), 6, "low", "high"
    ),
    "kde": lambda spark, sf: _round(_round(profile.density(_events(spark, sf), "value"), 9, "x", "density"), 4, "overlay"),
}

_SALES = f"({SALES})"


def _describe(column: str, more: str = "") -> str:
    v = f'CAST("{column}" AS DOUBLE)'
    return f"""SELECT '{column}' AS "column", COUNT({v}) AS count, ROUND(AVG({v}), 6) AS mean,
        ROUND(STDDEV_SAMP({v}), 6) AS stddev, MIN({v}) AS min, MAX({v}) AS max{more} FROM {_SALES}"""


def _quartiles(column: str) -> str:
    return "".join(
        f""", ROUND(quantile_cont(CAST("{column}" AS DOUBLE), {p}), 6) AS q{p * 100:.0f}""" for p in QUARTILES
    )


def _outliers(column: str) -> str:
    return f"""SELECT '{column}' AS "column", ROUND(q1, 6) AS q1, ROUND(q3, 6) AS q3, ROUND(q3 - q1, 6) AS iqr,
        ROUND(q1 - 1.5 * (q3 - q1), 6) AS lower, ROUND(q3 + 1.5 * (q3 - q1), 6) AS upper,
        (SELECT COUNT(*) FROM events WHERE {column} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
      FROM (SELECT quantile_cont(CAST({column} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({column} AS DOUBLE), 0.75) AS q3
            FROM events)"""


def _histogram(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", CAST(g.i AS INTEGER) AS bin, ROUND(lo + (hi - lo) / 30.0::DOUBLE * g.i, 6) AS low,
        ROUND(CASE WHEN g.i = 29 THEN hi ELSE lo + (hi - lo) / 30.0::DOUBLE * (g.i + 1) END, 6) AS high,
        COALESCE(c.n, 0) AS count
      FROM (SELECT MIN(CAST("{column}" AS DOUBLE)) AS lo, MAX(CAST("{column}" AS DOUBLE)) AS hi FROM {source}) b
      CROSS JOIN (SELECT unnest(range(30)) AS i) g
      LEFT JOIN (SELECT LEAST(FLOOR((CAST("{column}" AS DOUBLE) - lo) / ((hi - lo) / 30.0::DOUBLE)), 29) AS i, COUNT(*) AS n
                 FROM {source}, (SELECT MIN(CAST("{column}" AS DOUBLE)) AS lo, MAX(CAST("{column}" AS DOUBLE)) AS hi FROM {source})
                 GROUP BY 1) c ON c.i = g.i"""


ORACLES = {
    "describe_typed": " UNION ALL ".join(_describe(c) for c in MEASURES),
    "describe_text": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT("{c}") AS count, CAST(MIN("{c}") AS VARCHAR) AS min,
            CAST(MAX("{c}") AS VARCHAR) AS max FROM ({SALES})"""
        for c in TEXTS
    ),
    "describe_quartiles": " UNION ALL ".join(_describe(c, _quartiles(c)) for c in MEASURES),
    "quantiles": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({p} AS DOUBLE) AS prob, ROUND(quantile_cont(CAST("{c}" AS DOUBLE), {p}), 6) AS value FROM {_SALES}"""
        for c in NUMBERS
        for p in QUARTILES
    ),
    "outlier_stats": " UNION ALL ".join(_outliers(c) for c in ("value", "user_id")),
    "outlier_rows": """SELECT event_id, user_id, value FROM events,
        (SELECT quantile_cont(value, 0.25) AS a1, quantile_cont(value, 0.75) AS a3,
                quantile_cont(CAST(user_id AS DOUBLE), 0.25) AS b1, quantile_cont(CAST(user_id AS DOUBLE), 0.75) AS b3 FROM events)
        WHERE value NOT BETWEEN a1 - 1.5 * (a3 - a1) AND a3 + 1.5 * (a3 - a1)
           OR user_id NOT BETWEEN b1 - 1.5 * (b3 - b1) AND b3 + 1.5 * (b3 - b1)""",
    "skew_kurtosis": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", ROUND(skewness({c}), 9) AS skewness, ROUND(kurtosis({c}), 9) AS kurtosis FROM events"""
        for c in ("value", "user_id")
    ),
    "correlation_matrix": " UNION ALL ".join(
        f"""SELECT '{x}' AS x, '{y}' AS y, ROUND(corr("{x}", "{y}"), 9) AS corr FROM {_SALES}"""
        for x in NUMBERS
        for y in NUMBERS
    ),
    "histogram": _histogram("value", "events"),
    "histogram_all": " UNION ALL ".join(_histogram(c, _SALES) for c in NUMBERS),
    "kde": """WITH s AS (SELECT COUNT(value) AS n, MIN(value) AS lo, MAX(value) AS hi, STDDEV_SAMP(value) AS sd FROM events),
        b AS (SELECT LEAST(FLOOR((value - lo) / ((hi - lo) / 512.0::DOUBLE)), 511) AS bin, COUNT(*) AS c FROM events, s GROUP BY 1),
        g AS (SELECT unnest(range(200)) AS point)
        SELECT CAST(point AS INTEGER) AS point, ROUND(x, 9) AS x, ROUND(d, 9) AS density,
               ROUND(d * n * (hi - lo) / 30, 4) AS overlay
        FROM (SELECT point, ANY_VALUE(n) AS n, ANY_VALUE(lo) AS lo, ANY_VALUE(hi) AS hi, ANY_VALUE(lo + (hi - lo) * point / 199.0::DOUBLE) AS x,
                SUM(c * exp(-0.5 * pow((lo + (hi - lo) * point / 199.0::DOUBLE - (lo + (hi - lo) / 512.0::DOUBLE * (bin + 0.5)))
                    / (sd * pow(n, -0.2::DOUBLE)), 2))) / ANY_VALUE(n * sd * pow(n, -0.2::DOUBLE) * sqrt(2 * pi())) AS d
              FROM g, b, s GROUP BY point)""",
}
