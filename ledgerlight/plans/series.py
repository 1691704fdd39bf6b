"""Daily series, lag and calendar features, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.functions.columns import calendar_fields
from ledgerlight.operators import models, sampling
from ledgerlight.operators import series as ts
from ledgerlight.operators.aggregates import daily_totals
from ledgerlight.plans.sql import SALES, bucket, money
from ledgerlight.sources.sales import sales_view, table


def _daily(spark, sf):
    return daily_totals(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")


def _daily_by(spark, sf, *keys):
    return daily_totals(sales_view(spark, sf, [*keys, "OrderDate", "TotalAmount"]), keys=keys)


def _ar1(spark, sf):
    """One coefficient: what SQL can compute in closed form."""
    found = ts.ar_forecast(_daily_by(spark, sf, "State"), ["State"], p=1).where("status = 'ok'")
    return found.select("State", "date", "actual", F.round("forecast", 1).alias("forecast"))


def _bernoulli_share(spark, sf, fraction=0.05):
    """Is the sample's size within six standard deviations of its expectation?"""
    orders = table(spark, sf, "orders")
    sampled = sampling.bernoulli_sample(orders.select("o_orderkey"), fraction).agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = F.count(F.lit(1))
    off = F.abs(F.first(sampled) - rows * fraction)
    return orders.agg(rows.alias("rows"), (off <= 6 * F.sqrt(rows * fraction * (1 - fraction))).alias("as_expected"))


QUERIES = {
    "ar1_forecast_by_state": _ar1,
    "bernoulli_share": _bernoulli_share,
    "daily_calendar_series": lambda spark, sf: ts.calendar_fill(_daily(spark, sf)),
    "daily_calendar_by_city": lambda spark, sf: ts.calendar_fill(_daily_by(spark, sf, "City"), keys=["City"]),
    "lag_features": lambda spark, sf: models.demand_features(
        sales_view(spark, sf, ["OrderDate", "ProductID", "State", "Quantity", "TotalAmount"])
    ),
    "lag_calendar_days": lambda spark, sf: ts.lag_features(
        _daily_by(spark, sf, "City"), ["City"], "date", "value", (1, 7), calendar=True, name="lag_{}_day"
    ),
    "calendar_features": lambda spark, sf: sales_view(spark, sf, ["OrderID", "OrderDate"]).withColumns(
        calendar_fields("OrderDate")
    ),
    "scoring_features": lambda spark, sf: models.add_features(
        sales_view(spark, sf, ["OrderID", *models.SCORING_COLUMNS, "TotalAmount"])
    ),
    "chrono_split": lambda spark, sf: ts.chrono_split(ts.calendar_fill(_daily(spark, sf))),
    "first_difference": lambda spark, sf: ts.difference(ts.calendar_fill(_daily(spark, sf)), "date", "value").withColumn(
        "diff", F.round("diff", 2)
    ),
    "ar_lag_matrix": lambda spark, sf: ts.ar_lag_matrix(ts.calendar_fill(_daily(spark, sf))).select(
        "date", *[F.round(c, 2).alias(c) for c in ("diff", "lag_1", "lag_2", "lag_3", "lag_4", "lag_5")]
    ),
    "ar_forecast": lambda spark, sf: ts.ar_forecast(_daily(spark, sf)),
    "ar_forecast_by_state": lambda spark, sf: ts.ar_forecast(_daily_by(spark, sf, "State"), ["State"]),
    "hash_split": lambda spark, sf: sampling.hash_split(table(spark, sf, "orders"), ["o_orderkey"]).select(
        "o_orderkey", "is_train"
    ),
    "hash_sample_n": lambda spark, sf: sampling.hash_sample(
        table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 4500
    ),
    "hash_fraction": lambda spark, sf: sampling.hash_fraction(
        table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 0.05
    ),
    "bernoulli_sample": lambda spark, sf: sampling.bernoulli_sample(table(spark, sf, "orders"), 0.05).select(
        "o_orderkey", "o_totalprice"
    ),
}

_DAILY = f"""daily AS (SELECT CAST(o_orderdate AS DATE) AS date, {money('o_totalprice')} AS value FROM orders GROUP BY 1),
  filled AS (SELECT c.date, COALESCE(d.value, 0.0::DOUBLE) AS value
             FROM (SELECT CAST(unnest(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily) c
             LEFT JOIN daily d ON c.date = d.date)"""


def _filled(key: str) -> str:
    return f"""daily AS (SELECT "{key}", "OrderDate" AS date, {money('"TotalAmount"')} AS value FROM ({SALES}) GROUP BY 1, 2),
  filled AS (SELECT c."{key}", c.date, COALESCE(d.value, 0.0::DOUBLE) AS value
             FROM (SELECT "{key}", CAST(unnest(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS date
                   FROM daily GROUP BY "{key}") c
             LEFT JOIN daily d ON c.date = d.date AND c."{key}" = d."{key}")"""


def _calendar(date: str) -> str:
    return f"""CAST(day({date}) AS INTEGER) AS day_of_month, CAST(dayofweek({date}) + 1 AS INTEGER) AS day_of_week,
        CAST(month({date}) AS INTEGER) AS month, CAST(year({date}) AS INTEGER) AS year,
        CAST(weekofyear({date}) AS INTEGER) AS week_of_year"""


ORACLES = {
    "ar1_forecast_by_state": "WITH " + _filled("State") + """,
        placed AS (SELECT "State", date, value, row_number() OVER w AS i, value - lag(value) OVER w AS d,
                     COUNT(*) OVER (PARTITION BY "State") AS n, CAST(FLOOR(COUNT(*) OVER (PARTITION BY "State") * 0.8::DOUBLE) AS BIGINT) AS k
                   FROM filled WINDOW w AS (PARTITION BY "State" ORDER BY date)),
        lagged AS (SELECT "State", d, lag(d) OVER (PARTITION BY "State" ORDER BY i) AS before FROM placed WHERE i <= k AND n >= 11),
        fit AS (SELECT "State", SUM(d * before) / SUM(before * before) AS phi FROM lagged WHERE before IS NOT NULL GROUP BY 1),
        ends AS (SELECT "State", value AS last, d FROM placed WHERE i = k)
        SELECT "State", date, value AS actual, ROUND(last + ends.d * phi * (1 - phi ** (i - k)) / (1 - phi), 1) AS forecast
        FROM placed JOIN fit USING ("State") JOIN ends USING ("State") WHERE i > k""",
    "bernoulli_share": "SELECT COUNT(*) AS rows, TRUE AS as_expected FROM orders",
    "daily_calendar_series": f"WITH {_DAILY} SELECT date, value FROM filled",
    "daily_calendar_by_city": f"""WITH {_filled("City")} SELECT "City", date, value FROM filled""",
    "lag_features": f"""WITH d AS (SELECT "OrderDate" AS order_date, "ProductID", "State",
          CAST(SUM("Quantity") AS BIGINT) AS daily_quantity, {money('"TotalAmount"')} AS daily_total_sales
          FROM ({SALES}) GROUP BY 1, 2, 3)
        SELECT *, CAST(COALESCE(lag(daily_quantity) OVER (PARTITION BY "ProductID", "State" ORDER BY order_date), 0) AS BIGINT)
          AS lag_1_day_qty, {_calendar("order_date")} FROM d""",
    "lag_calendar_days": f"""WITH {_filled("City")} SELECT "City", date, value,
          COALESCE(lag(value, 1) OVER w, 0.0::DOUBLE) AS lag_1_day, COALESCE(lag(value, 7) OVER w, 0.0::DOUBLE) AS lag_7_day
        FROM filled WINDOW w AS (PARTITION BY "City" ORDER BY date)""",
    "calendar_features": f"""SELECT "OrderID", "OrderDate", {_calendar('"OrderDate"')} FROM ({SALES})""",
    "scoring_features": f"""SELECT "OrderID", "OrderDate", CAST("Quantity" AS DOUBLE) AS "Quantity", "Discount", "Tax",
        "ShippingCost", "TotalAmount", CAST(month("OrderDate") AS INTEGER) AS "Month",
        CAST(dayofweek("OrderDate") + 1 AS INTEGER) AS "DayOfWeek" FROM ({SALES})""",
    "chrono_split": f"""WITH {_DAILY} SELECT date, value,
        row_number() OVER (ORDER BY date) <= FLOOR(COUNT(*) OVER () * 0.8::DOUBLE) AS is_train FROM filled""",
    "first_difference": f"""WITH {_DAILY} SELECT date, value, ROUND(value - lag(value) OVER (ORDER BY date), 2) AS diff FROM filled""",
    "ar_lag_matrix": f"""WITH {_DAILY}, d AS (SELECT date, value - lag(value) OVER (ORDER BY date) AS diff FROM filled),
        l AS (SELECT date, diff, {", ".join(f"lag(diff, {i}) OVER (ORDER BY date) AS lag_{i}" for i in range(1, 6))} FROM d)
        SELECT date, ROUND(diff, 2) AS diff, {", ".join(f"ROUND(lag_{i}, 2) AS lag_{i}" for i in range(1, 6))}
        FROM l WHERE lag_5 IS NOT NULL""",
    "hash_split": f"SELECT o_orderkey, {bucket('o_orderkey')} < {int(0.8 * 2**32)} AS is_train FROM orders",
    "hash_sample_n": f"""SELECT o_orderkey, o_totalprice FROM orders
        ORDER BY {bucket('o_orderkey')}, o_orderkey LIMIT 4500""",
    "hash_fraction": f"""SELECT o_orderkey, o_totalprice FROM orders
        WHERE {bucket('o_orderkey')} < {int(0.05 * 2**32)}""",
}
