"""The order, listing and price tables as views over the star-schema Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.sources.schemas import LISTINGS_HEADER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Column -> (table it needs, expression)
_COLUMNS = {
    "OrderKey": ("lineitem", "l_orderkey"),
    "OrderID": ("lineitem", "concat(l_orderkey, '-', l_linenumber)"),
    "OrderDate": ("orders", "cast(o_orderdate AS date)"),
    "CustomerID": ("orders", "o_custkey"),
    "ProductID": ("lineitem", "l_partkey"),
    "ProductName": ("part", "p_name"),
    "Category": ("part", "p_type"),
    "Quantity": ("lineitem", "cast(l_quantity AS int)"),
    "UnitPrice": ("part", "p_retailprice"),
    "Discount": ("lineitem", "l_discount"),
    "Tax": ("lineitem", "l_tax"),
    "ShippingCost": ("part", "cast(p_size AS double)"),
    "TotalAmount": ("lineitem", "l_extendedprice"),
    "PaymentMethod": ("orders", "o_orderpriority"),
    "City": ("nation", "concat(n_name, '/', c_mktsegment)"),
    "State": ("nation", "n_name"),
}

ORDER_COLUMNS = tuple(c for c in _COLUMNS if c != "OrderKey")


def _joined(spark: SparkSession, sf_dir: str, needed: set[str]) -> DataFrame:
    """Order lines with the tables in ``needed``.

    Customer and nation are joined to the orders, before the lines are: of the two large tables
    the lines are four times as many, and this way they are shuffled once, by order key. The two
    are joined by merging: both grow with the data, and an estimate that makes one of them look
    small enough to broadcast is never worth following (it cost a factor of three at sf0.1).
    """
    lines = table(spark, sf_dir, "lineitem")
    if needed & {"orders", "nation"}:
        orders = table(spark, sf_dir, "orders")
        if "nation" in needed:
            orders = orders.join(
                table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
            ).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        lines = lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    if "part" in needed:
        lines = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines


def sales_view(spark: SparkSession, sf_dir: str, cols: Sequence[str] = ORDER_COLUMNS) -> DataFrame:
    """Order lines that have an order, customer, nation and part, with the wanted columns.

    All tables are joined whatever the columns, so that every report counts the same lines even
    where a parent is missing. Spark chooses each join's form by the size of the tables, and
    adaptive execution splits a hot key.
    """
    df = _joined(spark, sf_dir, {t for t, _ in _COLUMNS.values()})
    return df.select(*[F.expr(_COLUMNS[c][1]).alias(c) for c in cols])


def _every(n: int) -> Column:
    return F.col("OrderKey") % n == 0


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order table with planted faults, in every row whose order key meets the rule.

    Nulls in amount, discount and quantity, negative amounts, zero quantities and dates that
    cannot be read; order lines with equal keys are in the data already.
    """
    amount = F.col("TotalAmount")
    return (
        sales_view(spark, sf_dir, [*ORDER_COLUMNS, "OrderKey"])
        .withColumns(
            {
                "OrderDate": F.when(_every(19), "bad").otherwise(F.col("OrderDate").cast("string")),
                "TotalAmount": F.when(~_every(17), F.when(_every(11), -amount).otherwise(amount)),
                "Discount": F.when(~_every(13), F.col("Discount")),
                "Quantity": F.when(_every(7), 0).when(~_every(23), F.col("Quantity")),
            }
        )
        .drop("OrderKey")
    )


def listing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salary-listing lines made from order lines, with repeated headers and broken rows.

    One line per order line, and a copy of the lines of some orders. The rating is the line
    number, the salary the price, and so on; faults depend on the order key.
    """
    df = _joined(spark, sf_dir, {"orders", "nation", "part"}).withColumn("OrderKey", F.col("l_orderkey"))
    quantity = F.col("l_quantity").cast("int").cast("string")
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    suffix = lambda n, text: F.when(_every(n), text).otherwise("")
    line = F.concat(
        F.when(_every(29), "n/a").otherwise(F.col("l_linenumber").cast("string")),
        F.lit(","),
        F.when(_every(31), "  ").otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit("\t"))),
        F.lit(","),
        F.when(_every(37), F.concat(F.lit('"'), F.col("p_name"), F.lit(', senior"'))).otherwise(F.col("p_name")),
        F.lit(","),
        price,
        suffix(41, "f"),
        F.lit(","),
        quantity,
        suffix(43, ".0"),
        F.lit(",\u00a0"),
        F.col("n_name"),
        F.lit(" ,"),
        F.col("o_orderpriority"),
        F.lit(","),
        F.col("c_mktsegment"),
        suffix(53, ",extra"),
    )
    value = F.when(_every(47), LISTINGS_HEADER).otherwise(line)
    # Copies of some lines: exact duplicates that cleaning must remove.
    return df.select(F.explode(F.array_repeat(value, F.when(_every(5), 2).otherwise(1))).alias("value"))
