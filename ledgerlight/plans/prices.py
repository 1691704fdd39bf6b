"""Price series: range filter, masking and monthly roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.operators import aggregates as agg
from ledgerlight.operators import cleaning, profile
from ledgerlight.plans.sql import money
from ledgerlight.sources.sales import table


def _prices(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("timestamp"), F.col("l_extendedprice").alias("price")
    )


def _masked(spark, sf):
    return cleaning.mask(_prices(spark, sf), F.col("price").between(3000, 4000))


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean", "stddev")})


QUERIES = {
    "range_filter": lambda spark, sf: cleaning.range_filter(_prices(spark, sf), "price", 3000, 4000),
    "range_filter_count": lambda spark, sf: cleaning.range_filter(_prices(spark, sf), "price", 3000, 4000).agg(
        F.count(F.lit(1)).alias("count")
    ),
    "range_filter_describe": lambda spark, sf: _rounded(
        profile.describe_typed(cleaning.range_filter(_prices(spark, sf), "price", 3000, 4000), ["price"])
    ),
    "mask_out_of_range": lambda spark, sf: _masked(spark, sf),
    "mask_describe": lambda spark, sf: profile.non_null_counts(_masked(spark, sf)),
    "non_null_counts": lambda spark, sf: profile.non_null_counts(_prices(spark, sf)),
    "monthly_price_stats": lambda spark, sf: agg.period_stats(_prices(spark, sf), "timestamp", "price"),
    "price_calendar_parts": lambda spark, sf: _prices(spark, sf).select(
        "price", F.month("timestamp").alias("month"), F.year("timestamp").alias("year")
    ),
}

_PRICES = "(SELECT l_shipdate AS timestamp, l_extendedprice AS price FROM lineitem)"
_MASK = f"""(SELECT CASE WHEN price BETWEEN 3000 AND 4000 THEN timestamp END AS timestamp,
             CASE WHEN price BETWEEN 3000 AND 4000 THEN price END AS price FROM {_PRICES})"""

ORACLES = {
    "range_filter": f"SELECT * FROM {_PRICES} WHERE price BETWEEN 3000 AND 4000",
    "range_filter_count": f"SELECT COUNT(*) AS count FROM {_PRICES} WHERE price BETWEEN 3000 AND 4000",
    "range_filter_describe": f"""SELECT 'price' AS "column", COUNT(price) AS count, ROUND(AVG(price), 6) AS mean,
        ROUND(STDDEV_SAMP(price), 6) AS stddev, MIN(price) AS min, MAX(price) AS max
        FROM {_PRICES} WHERE price BETWEEN 3000 AND 4000""",
    "mask_out_of_range": f"SELECT * FROM {_MASK}",
    "mask_describe": f"""SELECT 'timestamp' AS "column", COUNT(timestamp) AS count FROM {_MASK}
        UNION ALL SELECT 'price', COUNT(price) FROM {_MASK}""",
    "non_null_counts": f"""SELECT 'timestamp' AS "column", COUNT(timestamp) AS count FROM {_PRICES}
        UNION ALL SELECT 'price', COUNT(price) FROM {_PRICES}""",
    "monthly_price_stats": f"""SELECT strftime(timestamp, '%Y-%m') AS month_year, COUNT(price) AS record_count,
        {money('price')} AS total_price, MIN(price) AS min_price, MAX(price) AS max_price,
        {money('price')} / COUNT(price) AS avg_price FROM {_PRICES} GROUP BY 1""",
    "price_calendar_parts": f"""SELECT price, CAST(month(timestamp) AS INTEGER) AS month,
        CAST(year(timestamp) AS INTEGER) AS year FROM {_PRICES}""",
}
