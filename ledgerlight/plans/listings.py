"""Salary listings: raw text lines to typed rows, and key-value summaries of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlight.operators import aggregates as agg
from ledgerlight.operators import lines as text
from ledgerlight.plans.sql import money
from ledgerlight.sources.sales import listing_lines, table
from ledgerlight.sources.schemas import LISTINGS, LISTINGS_HEADER


def _classified(spark, sf):
    return text.classify_lines(listing_lines(spark, sf), LISTINGS, header=LISTINGS_HEADER)


def _valid(spark, sf):
    return text.parse_lines(listing_lines(spark, sf), LISTINGS, header=LISTINGS_HEADER)[0]


KEY, VALUE = "Location", "Salary"

QUERIES = {
    "salary_valid_rows": _valid,
    "salary_rejects": lambda spark, sf: text.parse_lines(
        listing_lines(spark, sf), LISTINGS, header=LISTINGS_HEADER
    )[1],
    "salary_line_report": lambda spark, sf: text.line_report(
        listing_lines(spark, sf), LISTINGS, header=LISTINGS_HEADER
    ),
    "title_words": lambda spark, sf: text.token_counts(_valid(spark, sf), "Job Title"),
    "salary_status_share": lambda spark, sf: agg.share(_valid(spark, sf), F.col("Employment Status") == "1-URGENT"),
    "salary_total_by_location": lambda spark, sf: agg.key_totals(_valid(spark, sf), KEY, VALUE),
    "total_by_key": lambda spark, sf: agg.key_totals(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"),
    "values_by_key": lambda spark, sf: agg.key_values(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"),
    "ranges_by_key": lambda spark, sf: agg.key_ranges(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"),
    "count_by_key_top8": lambda spark, sf: agg.key_counts(_valid(spark, sf), KEY, top=8),
    "avg_by_key": lambda spark, sf: agg.key_averages(_valid(spark, sf), KEY, VALUE),
    "uplift_by_key": lambda spark, sf: agg.key_totals(_valid(spark, sf), KEY, VALUE, factor=1.1).withColumn(
        "total", F.round("total", 4)
    ),
}

LINES = f"""
  WITH base AS (
    SELECT l_orderkey AS k, concat_ws(',',
        CASE WHEN l_orderkey % 29 = 0 THEN 'n/a' ELSE CAST(l_linenumber AS VARCHAR) END,
        CASE WHEN l_orderkey % 31 = 0 THEN '  ' ELSE ' ' || c_name || chr(9) END,
        CASE WHEN l_orderkey % 37 = 0 THEN '"' || p_name || ', senior"' ELSE p_name END,
        CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || CASE WHEN l_orderkey % 41 = 0 THEN 'f' ELSE '' END,
        CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || CASE WHEN l_orderkey % 43 = 0 THEN '.0' ELSE '' END,
        chr(160) || n_name || ' ', o_orderpriority, c_mktsegment) AS line
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
  once AS (SELECT k, CASE WHEN k % 47 = 0 THEN '{LISTINGS_HEADER}' WHEN k % 53 = 0 THEN line || ',extra' ELSE line END AS value
           FROM base),
  lines AS (SELECT value FROM once UNION ALL SELECT value FROM once WHERE k % 5 = 0),
  data AS (SELECT value, string_split(value, ',') AS f FROM lines WHERE value <> '{LISTINGS_HEADER}'),
  checked AS (
    SELECT value, f, CASE WHEN len(f) <> 8 THEN 'field count'
        WHEN regexp_matches(value, '(^|,)\\s*(,|$)') THEN 'missing value'
        WHEN NOT regexp_full_match(trim(f[1]), '[+-]?[0-9]+(\\.[0-9]*)?')
          OR NOT regexp_full_match(trim(f[4]), '[+-]?[0-9]+(\\.[0-9]*)?')
          OR NOT regexp_full_match(trim(f[5]), '[+-]?[0-9]+') THEN 'not a number' END AS reason
    FROM data),
  valid AS (
    SELECT DISTINCT CAST(trim(f[1]) AS DOUBLE) AS "Rating", regexp_replace(f[2], '^\\s+|\\s+$', '', 'g') AS "Company Name",
      trim(f[3]) AS "Job Title", CAST(trim(f[4]) AS DOUBLE) AS "Salary", CAST(trim(f[5]) AS INTEGER) AS "Salaries Reported",
      trim(f[6], ' ' || chr(160)) AS "Location", trim(f[7]) AS "Employment Status", trim(f[8]) AS "Job Roles"
    FROM checked WHERE reason IS NULL)
"""

ORACLES = {
    "salary_valid_rows": LINES + "SELECT * FROM valid",
    "salary_rejects": LINES + "SELECT value, reason FROM checked WHERE reason IS NOT NULL",
    "salary_line_report": LINES
    + f"""SELECT (SELECT COUNT(*) FROM lines) AS lines,
            (SELECT COUNT(*) FROM lines WHERE value = '{LISTINGS_HEADER}') AS header_lines,
            COUNT(*) FILTER (reason = 'field count') AS bad_field_count,
            COUNT(*) FILTER (reason = 'missing value') AS bad_missing,
            COUNT(*) FILTER (reason = 'not a number') AS bad_number,
            COUNT(*) FILTER (reason IS NULL) - (SELECT COUNT(*) FROM valid) AS duplicates,
            (SELECT COUNT(*) FROM valid) AS rows_out FROM checked""",
    "title_words": LINES
    + """SELECT word, COUNT(*) AS count FROM (SELECT unnest(string_split("Job Title", ' ')) AS word FROM valid) GROUP BY 1""",
    "salary_status_share": LINES
    + """SELECT COUNT(*) AS rows, COUNT(*) FILTER ("Employment Status" = '1-URGENT') AS matching,
         CAST(100.0 AS DOUBLE) * COUNT(*) FILTER ("Employment Status" = '1-URGENT') / COUNT(*) AS percentage FROM valid""",
    "salary_total_by_location": LINES
    + f"""SELECT "Location", {money('"Salary"')} AS total FROM valid GROUP BY 1""",
    "total_by_key": f"SELECT o_orderpriority, {money('o_totalprice')} AS total FROM orders GROUP BY 1",
    "values_by_key": "SELECT o_orderpriority, o_totalprice, COUNT(*) AS copies FROM orders GROUP BY 1, 2",
    "ranges_by_key": """SELECT o_orderpriority, COUNT(o_totalprice) AS entries, MIN(o_totalprice) AS min_value,
        MAX(o_totalprice) AS max_value FROM orders GROUP BY 1""",
    "count_by_key_top8": LINES
    + """SELECT "Location", COUNT(*) AS count FROM valid GROUP BY 1 ORDER BY count DESC, "Location" LIMIT 8""",
    "avg_by_key": LINES
    + f"""SELECT "Location", ROUND({money('"Salary"')} / COUNT("Salary"), 2) AS average FROM valid GROUP BY 1""",
    "uplift_by_key": LINES
    + f"""SELECT "Location", ROUND({money('"Salary"')} * CAST(1.1 AS DOUBLE), 4) AS total FROM valid GROUP BY 1""",
}
