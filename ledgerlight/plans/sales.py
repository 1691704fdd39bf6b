"""Order cleaning and revenue reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.functions.columns import categorical_columns, numeric_columns
from ledgerlight.functions.staging import stage
from ledgerlight.operators import aggregates as agg
from ledgerlight.operators import cleaning, joins
from ledgerlight.operators.partitioning import skew_report
from ledgerlight.operators.profile import non_null_counts
from ledgerlight.operators.quantiles import iqr_bounds, iqr_filter
from ledgerlight.plans.sql import CLEAN, RAW, SALES, UNIQUE, money
from ledgerlight.sources.sales import raw_orders, sales_view, table


def _rows(spark, sf, *cols):
    return sales_view(spark, sf, cols)


def _joined(result):
    return result.groupBy("Region", "State").agg(
        F.count(F.lit(1)).alias("orders"), agg.exact_sum("TotalAmount").alias("revenue")
    )


def _column_kinds(spark, sf):
    """Numeric and text columns of the raw orders, and how many values each has."""
    raw = raw_orders(spark, sf)
    kinds = {c: "numeric" for c in numeric_columns(raw)} | {c: "text" for c in categorical_columns(raw)}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return non_null_counts(raw, list(kinds)).withColumn("kind", kind[F.col("column")])


def _fact(spark, sf):
    """The joined rows, stored once: the dimension is derived from them and joined to them."""
    return stage(_rows(spark, sf, "State", "TotalAmount"), "state-sales")


def _join_merge(spark, sf):
    fact = _fact(spark, sf)
    return _joined(joins.join_merge(fact, joins.derive_dimension(fact, "State", Region="Standard"), "State", salts=32))


def _join_broadcast(spark, sf):
    fact = _fact(spark, sf)
    dim = stage(joins.derive_dimension(fact, "State", Region="Standard"), "states")
    return _joined(joins.join_broadcast(fact, dim, "State"))


def _period(period, separator=" "):
    return lambda spark, sf: agg.revenue_by_period(
        _rows(spark, sf, "OrderDate", "TotalAmount"), period=period, separator=separator
    )


def _averages_from_partials(spark, sf):
    orders = table(spark, sf, "orders")
    parts = [
        agg.key_partials(orders.filter(F.col("o_orderstatus") == status), "o_orderpriority", "o_totalprice")
        for status in ("F", "O", "P")
    ]
    return agg.merge_partials(agg.bag_union(*parts), "o_orderpriority")


def _approximate_ranks(spark, sf, rel_err=0.05):
    """Are the ranks of the approximate quartiles within the stated error?"""
    events = table(spark, sf, "events")
    found = iqr_bounds(events, ["value"], rel_err=rel_err)["value"]
    n, v = F.count("value"), F.col("value")
    near = [
        (F.count_if(v < found[q]) <= n * (p + rel_err)) & (F.count_if(v <= found[q]) >= n * (p - rel_err))
        for q, p in (("q1", 0.25), ("q3", 0.75))
    ]
    return events.agg(n.alias("values"), near[0].alias("q1_near"), near[1].alias("q3_near"))


QUERIES = {
    "iqr_approx_ranks": _approximate_ranks,
    "first_rows": lambda spark, sf: agg.first_rows(
        table(spark, sf, "orders").select("o_orderdate", "o_orderkey", "o_totalprice"), 20, ["o_orderdate", "o_orderkey", "o_totalprice"]
    ),
    "column_kinds": _column_kinds,
    "category_performance": lambda spark, sf: agg.category_performance(
        _rows(spark, sf, "OrderID", "Category", "TotalAmount")
    ),
    "monthly_revenue": _period("month"),
    "year_quarter_revenue": _period("year_quarter"),
    "year_quarter_compact_revenue": _period("year_quarter", ""),
    "quarter_revenue": _period("quarter"),
    "daily_sales": lambda spark, sf: agg.daily_totals(_rows(spark, sf, "OrderDate", "TotalAmount")).orderBy("date"),
    "state_sales": lambda spark, sf: agg.revenue_by(_rows(spark, sf, "State", "TotalAmount"), "State"),
    "state_category_revenue": lambda spark, sf: agg.revenue_by(
        _rows(spark, sf, "State", "Category", "TotalAmount"), ["State", "Category"], order=None
    ),
    "daily_product_state": lambda spark, sf: agg.daily_demand(
        _rows(spark, sf, "OrderDate", "ProductID", "State", "Quantity", "TotalAmount")
    ),
    "top_products": lambda spark, sf: agg.revenue_by(
        _rows(spark, sf, "ProductName", "TotalAmount"), "ProductName", top=10
    ),
    "top_cities": lambda spark, sf: agg.revenue_by(_rows(spark, sf, "City", "TotalAmount"), "City", top=10),
    "dedup_orders": lambda spark, sf: cleaning.dedup(
        sales_view(spark, sf).withColumn("OrderDate", F.col("OrderDate").cast("date")), ["OrderID"]
    ),
    "unique_sales": lambda spark, sf: cleaning.unique_orders(raw_orders(spark, sf)),
    "clean_sales": lambda spark, sf: cleaning.clean_orders(raw_orders(spark, sf)),
    "cleaning_report": lambda spark, sf: cleaning.cleaning_report(raw_orders(spark, sf)),
    "null_counts": lambda spark, sf: cleaning.null_counts(
        raw_orders(spark, sf), ["OrderDate", "Quantity", "Discount", "TotalAmount"]
    ),
    "fill_defaults": lambda spark, sf: cleaning.clamp_min(
        cleaning.fill_missing(
            raw_orders(spark, sf).select("OrderID", "Quantity", "Discount", "TotalAmount"),
            {"Quantity": 0, "Discount": 0.0, "TotalAmount": 0.0},
        ),
        "Quantity",
        1,
    ).withColumn("total_sales", F.col("TotalAmount")),
    "iqr_filter": lambda spark, sf: iqr_filter(table(spark, sf, "events"), "value").select("event_id", "value"),
    "iqr_filter_approx": lambda spark, sf: iqr_filter(table(spark, sf, "events"), "value", rel_err=0.05).select(
        "event_id", "value"
    ),
    "join_merge": _join_merge,
    "join_broadcast": _join_broadcast,
    "skew_report": lambda spark, sf: skew_report(_rows(spark, sf, "Category"), "Category"),
    "share_by_value": lambda spark, sf: agg.value_shares(_rows(spark, sf, "PaymentMethod"), "PaymentMethod"),
    "category_counts": lambda spark, sf: agg.value_counts(
        _rows(spark, sf, "Category", "PaymentMethod", "City", "State"), ["Category", "PaymentMethod", "City", "State"]
    ),
    "status_share": lambda spark, sf: agg.share(table(spark, sf, "orders"), F.col("o_orderstatus") == "F"),
    "union_two_statuses": lambda spark, sf: agg.bag_union(
        cleaning.equals_filter(table(spark, sf, "orders"), "o_orderstatus", "F"),
        cleaning.equals_filter(table(spark, sf, "orders"), "o_orderstatus", "O"),
    ).select("o_orderkey", "o_orderstatus", "o_totalprice"),
    "distinct_pairs": lambda spark, sf: agg.distinct_rows(
        _rows(spark, sf, "State", "PaymentMethod"), ["State", "PaymentMethod"]
    ),
    "avg_from_partials": _averages_from_partials,
}


def _sum_by(columns: str, alias: str = "revenue") -> str:
    return f"""SELECT {columns}, {money('"TotalAmount"')} AS {alias} FROM ({SALES}) GROUP BY ALL"""


_PERIOD = "SELECT {label} AS period, " + money('"TotalAmount"') + f" AS revenue FROM ({SALES}) GROUP BY 1"
_YEAR_QUARTER = """CAST(year("OrderDate") AS VARCHAR) || '{}' || 'Q' || CAST(quarter("OrderDate") AS VARCHAR)"""
_JOIN = f"""SELECT 'Standard' AS "Region", "State", COUNT(*) AS orders, {money('"TotalAmount"')} AS revenue
            FROM ({SALES}) GROUP BY "State" """

_KINDS = {"numeric": ("CustomerID", "ProductID", "Quantity", "UnitPrice", "Discount", "Tax", "ShippingCost", "TotalAmount"),
          "text": ("OrderID", "OrderDate", "Category", "PaymentMethod", "City", "State")}

ORACLES = {
    "iqr_approx_ranks": "SELECT COUNT(value) AS values, TRUE AS q1_near, TRUE AS q3_near FROM events",
    "first_rows": "SELECT o_orderdate, o_orderkey, o_totalprice FROM orders ORDER BY 1, 2, 3 LIMIT 20",
    "column_kinds": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT("{c}") AS count, '{kind}' AS kind FROM ({SALES if c in ("CustomerID", "ProductID") else RAW})"""
        for kind, cols in _KINDS.items() for c in cols
    ),
    "category_performance": f"""SELECT "Category", {money('"TotalAmount"')} AS total_revenue, COUNT("OrderID") AS order_count,
        {money('"TotalAmount"')} / COUNT("TotalAmount") AS avg_order_value FROM ({SALES}) GROUP BY 1""",
    "monthly_revenue": _PERIOD.format(label="""strftime("OrderDate", '%Y-%m')"""),
    "year_quarter_revenue": _PERIOD.format(label=_YEAR_QUARTER.format(" ")),
    "year_quarter_compact_revenue": _PERIOD.format(label=_YEAR_QUARTER.format("")),
    "quarter_revenue": _PERIOD.format(label="""'Q' || CAST(quarter("OrderDate") AS VARCHAR)"""),
    "daily_sales": _sum_by('"OrderDate" AS date', "value"),
    "state_sales": _sum_by('"State"'),
    "state_category_revenue": _sum_by('"State", "Category"'),
    "daily_product_state": f"""SELECT "OrderDate" AS order_date, "ProductID", "State",
        CAST(SUM("Quantity") AS BIGINT) AS daily_quantity, {money('"TotalAmount"')} AS daily_total_sales
        FROM ({SALES}) GROUP BY 1, 2, 3""",
    "top_products": _sum_by('"ProductName"') + ' ORDER BY revenue DESC, "ProductName" LIMIT 10',
    "top_cities": _sum_by('"City"') + ' ORDER BY revenue DESC, "City" LIMIT 10',
    "dedup_orders": f"""SELECT * EXCLUDE (l_orderkey) FROM ({SALES})
        QUALIFY row_number() OVER (PARTITION BY "OrderID" ORDER BY "OrderDate", "CustomerID", "ProductID",
          "ProductName", "Category", "Quantity", "UnitPrice", "Discount", "Tax", "ShippingCost", "TotalAmount",
          "PaymentMethod", "City", "State") = 1""",
    "unique_sales": UNIQUE,
    "clean_sales": CLEAN,
    "cleaning_report": f"""
        WITH r AS (SELECT *, "OrderID" IS NOT NULL AND try_strptime("OrderDate", '%Y-%m-%d') IS NOT NULL
                   AND "TotalAmount" IS NOT NULL AS ok FROM ({RAW}))
        SELECT COUNT(*) AS rows_in, COUNT(*) FILTER (NOT ok) AS rejected,
          COUNT(*) FILTER (ok) - COUNT(DISTINCT "OrderID") FILTER (ok) AS duplicates,
          COUNT(*) FILTER ("TotalAmount" < 0) AS negative_amounts, COUNT(*) FILTER ("Quantity" < 1) AS low_quantities,
          COUNT(DISTINCT "OrderID") FILTER (ok) AS rows_out FROM r""",
    "null_counts": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT(*) FILTER ("{c}" IS NULL) AS missing FROM ({RAW})"""
        for c in ("OrderDate", "Quantity", "Discount", "TotalAmount")
    ),
    "fill_defaults": f"""SELECT "OrderID", GREATEST(COALESCE("Quantity", 0), 1) AS "Quantity",
        COALESCE("Discount", 0.0) AS "Discount", COALESCE("TotalAmount", 0.0) AS "TotalAmount",
        COALESCE("TotalAmount", 0.0) AS total_sales FROM ({RAW})""",
    "iqr_filter": """SELECT event_id, value FROM events,
        (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
        WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
    "join_merge": _JOIN,
    "join_broadcast": _JOIN,
    "skew_report": f"""WITH c AS (SELECT "Category", COUNT(*) AS count FROM ({SALES}) GROUP BY 1),
          t AS (SELECT SUM(count) AS n, median(count) AS m FROM c)
        SELECT "Category", count, CAST(count AS DOUBLE) / CAST(n AS DOUBLE) AS share,
          CAST(count AS DOUBLE) / CAST(m AS DOUBLE) AS ratio_to_median
        FROM c, t ORDER BY count DESC, "Category" LIMIT 5""",
    "share_by_value": f"""SELECT "PaymentMethod", COUNT(*) AS count,
        CAST(100.0 AS DOUBLE) * COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS percentage
        FROM ({SALES}) WHERE "PaymentMethod" IS NOT NULL GROUP BY 1""",
    "category_counts": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", "{c}" AS value, COUNT(*) AS count FROM ({SALES}) WHERE "{c}" IS NOT NULL GROUP BY "{c}" """
        for c in ("Category", "PaymentMethod", "City", "State")
    ),
    "status_share": """SELECT COUNT(*) AS rows, COUNT(*) FILTER (o_orderstatus = 'F') AS matching,
        CAST(100.0 AS DOUBLE) * COUNT(*) FILTER (o_orderstatus = 'F') / COUNT(*) AS percentage FROM orders""",
    "union_two_statuses": """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'O'""",
    "distinct_pairs": f"""SELECT DISTINCT "State", "PaymentMethod" FROM ({SALES})""",
    "avg_from_partials": f"""SELECT o_orderpriority, ROUND({money('o_totalprice')} / COUNT(*), 2) AS average
        FROM orders GROUP BY 1""",
}
