"""SQL building blocks shared by the comparison queries (DuckDB dialect)."""

SALES = """
  SELECT l_orderkey || '-' || l_linenumber AS "OrderID", CAST(o_orderdate AS DATE) AS "OrderDate",
         o_custkey AS "CustomerID", l_partkey AS "ProductID", p_name AS "ProductName", p_type AS "Category",
         CAST(l_quantity AS INTEGER) AS "Quantity", p_retailprice AS "UnitPrice", l_discount AS "Discount",
         l_tax AS "Tax", CAST(p_size AS DOUBLE) AS "ShippingCost", l_extendedprice AS "TotalAmount",
         o_orderpriority AS "PaymentMethod", n_name || '/' || c_mktsegment AS "City", n_name AS "State",
         l_orderkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
"""

RAW = f"""
  SELECT "OrderID", CASE WHEN l_orderkey % 19 = 0 THEN 'bad' ELSE strftime("OrderDate", '%Y-%m-%d') END AS "OrderDate",
         "ProductName", "Category",
         CASE WHEN l_orderkey % 7 = 0 THEN 0 WHEN l_orderkey % 23 <> 0 THEN "Quantity" END AS "Quantity",
         "UnitPrice", CASE WHEN l_orderkey % 13 <> 0 THEN "Discount" END AS "Discount", "Tax", "ShippingCost",
         CASE WHEN l_orderkey % 17 = 0 THEN NULL WHEN l_orderkey % 11 = 0 THEN -"TotalAmount" ELSE "TotalAmount" END AS "TotalAmount",
         "PaymentMethod", "City", "State"
  FROM ({SALES})
"""

NORMAL = f"""
  SELECT "OrderID", CAST(try_strptime("OrderDate", '%Y-%m-%d') AS DATE) AS "OrderDate", "ProductName", "Category",
         CASE WHEN "Quantity" < 1 THEN 1 ELSE "Quantity" END AS "Quantity", "UnitPrice",
         COALESCE("Discount", 0.0) AS "Discount", COALESCE("Tax", 0.0) AS "Tax",
         COALESCE("ShippingCost", 0.0) AS "ShippingCost", ABS("TotalAmount") AS "TotalAmount",
         "PaymentMethod", "City", "State"
  FROM ({RAW})
"""

UNIQUE = f"""
  SELECT * FROM ({NORMAL})
  WHERE "OrderID" IS NOT NULL AND "OrderDate" IS NOT NULL AND "TotalAmount" IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY "OrderID" ORDER BY "OrderDate", "ProductName", "Category",
    "Quantity" NULLS FIRST, "UnitPrice", "Discount", "Tax", "ShippingCost", "TotalAmount", "PaymentMethod",
    "City", "State") = 1
"""

CLEAN = f"""
  SELECT u.* FROM ({UNIQUE}) u,
    (SELECT quantile_cont("TotalAmount", 0.25) AS q1, quantile_cont("TotalAmount", 0.75) AS q3 FROM ({UNIQUE}))
  WHERE "TotalAmount" BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
"""


def money(column: str) -> str:
    """Exact sum of a column with two decimals, as a double."""
    return f"CAST(SUM(CAST({column} AS DECIMAL(18,2))) AS DOUBLE)"


def bucket(*keys: str, seed: int = 42) -> str:
    """The key hash of ``hash_bucket``."""
    text = ", ".join(f"COALESCE(length(CAST({k} AS VARCHAR)) || ':' || CAST({k} AS VARCHAR), '-')" for k in keys)
    return f"CAST('0x' || substr(md5(concat_ws('|', {text}, '{seed}')), 1, 8) AS BIGINT)"
