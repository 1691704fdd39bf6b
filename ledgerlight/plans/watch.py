"""Whole-table windows, unusual days, drift of inputs, mergeable sketches, stored layouts and event time."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ledgerlight.functions.columns import period_label
from ledgerlight.functions.staging import stage, stage_bucketed, staging_folder
from ledgerlight.operators import anomalies, drift, partitioning, quantiles
from ledgerlight.operators import series as ts
from ledgerlight.operators.aggregates import daily_totals
from ledgerlight.operators.frequent import top_keys
from ledgerlight.operators.running import Ordered
from ledgerlight.plans.series import _filled
from ledgerlight.plans.sql import SALES
from ledgerlight.sources.sales import sales_view, table
from ledgerlight.streaming.events import daily_windows, event_stream, start_daily

_INPUTS = ("Quantity", "UnitPrice", "Discount", "TotalAmount")
_PROBS = (0.1, 0.25, 0.5, 0.75, 0.9)


def _running_events(spark, sf):
    """Events in time order: number, running sum, extremes, earlier and later values, training share."""
    events = table(spark, sf, "events").select("ts", "event_id", "value", F.col("value").cast("decimal(18,4)").alias("amount"))
    ordered = Ordered(events, ["ts", "event_id"])
    found = ordered.with_columns(
        place="place",
        running={"total": ("sum", "amount"), "seen": ("count", "value"), "lowest": ("min", "value"), "highest": ("max", "value")},
        shifts={"previous": ("value", 1), "week_ago": ("value", 7), "next": ("value", -1)},
    )
    return found.withColumns({"total": F.col("total").cast("double"), "is_train": F.col("place") <= int(ordered.total * 0.8)}).drop("amount")


def _decomposed(spark, sf):
    daily = daily_totals(sales_view(spark, sf, ["PaymentMethod", "OrderDate", "TotalAmount"]), keys=["PaymentMethod"])
    return anomalies.flag_anomalies(anomalies.decompose(ts.calendar_fill(daily, keys=["PaymentMethod"]), ["PaymentMethod"]), ["PaymentMethod"])


def _input_drift(spark, sf):
    """Every month's inputs against those of the first year; TotalAmount is missing where a plan says so."""
    gap = F.when(F.expr("l_orderkey % 17 <> 0 OR year(OrderDate) < 1996"), F.col("TotalAmount"))
    view = stage(sales_view(spark, sf, [*_INPUTS, "OrderDate", "OrderID"]).withColumn("l_orderkey", F.split_part("OrderID", F.lit("-"), F.lit(1)).cast("bigint")).withColumn("TotalAmount", gap), "inputs")
    first = view.agg(F.min(F.year("OrderDate")).alias("y")).first().y or 0
    edges = drift.baseline_edges(view.where(F.year("OrderDate") == first), _INPUTS)
    counted = stage(drift.period_histograms(view, period_label("OrderDate", "month"), edges), "histograms")
    found = drift.distribution_drift(counted, F.col("period").startswith(str(first)), edges)
    return found.withColumns({"psi": F.round("psi", 6), "ks": F.round("ks", 6)})


def _sketch_ranks(spark, sf):
    """Rank error of quantiles from stored daily sketches, merged per month and over all days, within the stated bound."""
    rows = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "event_type", "value")
    stored = stage(quantiles.quantile_sketches(rows, "value", ["day", "event_type"]), "sketches")
    merged = quantiles.merge_sketches(stored, ["event_type"])
    found = quantiles.sketch_quantiles(merged, ["event_type"], _PROBS)
    ranks = rows.join(F.broadcast(found.select("event_type", "prob", F.col("value").alias("estimate"), "n")), "event_type").groupBy("event_type", "prob", "n")
    below, upto = F.count_if(F.col("value") < F.col("estimate")), F.count_if(F.col("value") <= F.col("estimate"))
    counted = ranks.agg(F.count("value").alias("rows"), below.alias("below"), upto.alias("upto"))
    off = F.greatest(F.col("below") / F.col("rows") - F.col("prob"), F.col("prob") - F.col("upto") / F.col("rows"), F.lit(0.0))
    return counted.select("event_type", "prob", "rows", F.col("n").alias("sketched"), (off <= quantiles.SKETCH_RANK_ERROR).alias("within_bound"))


def _streamed_days(spark, sf):
    """Closed days of the event table, streamed once with a watermark."""
    events = table(spark, sf, "events")
    # A pattern, because a stream takes a plain path for a folder and the table may be one file.
    stream = event_stream(spark, f"{sf}/events.parque[t]", events.schema)
    totals = daily_windows(stream, by=("event_type",), value=F.col("value").cast("decimal(18,4)"))
    folder = f"{staging_folder(spark)}/ledgerlight/stream-{uuid.uuid4().hex}"
    start_daily(totals, f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    days = spark.read.schema(totals.schema).parquet(f"{folder}/table")
    return days.select(F.to_date("day").alias("day"), "event_type", "events", F.col("total").cast("double").alias("total"))


def _bucketed(spark, sf):
    """Lines and orders stored by order key and joined where they lie."""
    lines = stage_bucketed(table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice"), "lines", "l_orderkey", 16)
    orders = stage_bucketed(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "orders", "o_orderkey", 16)
    joined = lines.hint("merge").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"))


def _layouts(spark, sf):
    """Partitions and rows of a table as it is spread evenly, spread by key, merged and held."""
    orders = table(spark, sf, "orders").select("o_orderkey")
    even = partitioning.spread(orders, 8)
    frames = {"even": even, "by_key": partitioning.spread(orders, 6, "o_orderkey"), "merged": partitioning.shrink(even, 2), "held": partitioning.hold(partitioning.spread(orders, 4))}
    rows = [partitioning.partition_counts(f).agg(F.lit(name).alias("layout"), F.count(F.lit(1)).alias("partitions"), F.sum("rows").alias("rows")) for name, f in frames.items()]
    found = stage(reduce(lambda a, b: a.unionByName(b), rows), "layouts")
    partitioning.release(frames["held"])
    return found


def _heavy_hitters(spark, sf):
    """Top keys of a column where a few stand out, and of one with nearly as many values as rows."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.pmod("l_orderkey", F.pmod(F.col("l_partkey"), F.lit(97)) + 1).alias("uneven"))
    tops = [top_keys(lines, c, counters=200).select(F.lit(c).alias("column"), F.col(c).alias("value"), "count", F.round("share", 9).alias("share")) for c in ("l_orderkey", "uneven")]
    return tops[0].unionByName(tops[1])


QUERIES = {
    "heavy_hitters": _heavy_hitters,
    "streamed_days": _streamed_days,
    "join_bucketed": _bucketed,
    "layouts": _layouts,
    "renamed_orders": lambda spark, sf: table(spark, sf, "orders").withColumnsRenamed({"o_orderkey": "OrderID", "o_totalprice": "TotalAmount"}).select("OrderID", "TotalAmount"),
    "running_events": _running_events,
    "seasonal_anomalies": lambda spark, sf: _decomposed(spark, sf).withColumns({c: F.round(c, 4) for c in ("trend", "seasonal", "remainder", "score")}),
    "anomaly_alerts": lambda spark, sf: anomalies.anomaly_alerts(_decomposed(spark, sf), ["PaymentMethod"], max_days=3),
    "input_drift_by_month": _input_drift,
    "ar1_likelihood_by_state": lambda spark, sf: ts.ar_coefficients(
        daily_totals(sales_view(spark, sf, ["State", "OrderDate", "TotalAmount"]), keys=["State"]), ["State"], p=1, d=0, centre=True
    ).select("State", "n", F.round(F.get("phi", F.lit(0)), 3).alias("phi")),
    "sketch_ranks": _sketch_ranks,
}

_SEASONS = "WITH " + _filled("PaymentMethod") + """,
  t AS (SELECT *, median(value) OVER (PARTITION BY "PaymentMethod" ORDER BY date ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS trend,
          isodow(date) AS phase FROM filled),
  m AS (SELECT "PaymentMethod", phase, median(value - trend) AS s FROM t GROUP BY ALL),
  c AS (SELECT "PaymentMethod", phase, s - avg(s) OVER (PARTITION BY "PaymentMethod") AS seasonal FROM m),
  r AS (SELECT "PaymentMethod", date, value, trend, seasonal, value - trend - seasonal AS remainder FROM t JOIN c USING ("PaymentMethod", phase)),
  o AS (SELECT *, abs(remainder - median(remainder) OVER (PARTITION BY "PaymentMethod")) AS off FROM r),
  d AS (SELECT *, median(off) OVER w AS mad, 1e-9::DOUBLE * max(abs(trend)) OVER w AS least FROM o WINDOW w AS (PARTITION BY "PaymentMethod")),
  f AS (SELECT "PaymentMethod", date, value, trend, seasonal, remainder, CASE WHEN mad > least THEN off / (1.4826::DOUBLE * mad) END AS score,
          CASE WHEN mad > least THEN off / (1.4826::DOUBLE * mad) > 3.5::DOUBLE ELSE off > least END AS is_anomaly FROM d)
"""


def _drift_sql() -> str:
    edges = ", ".join(f"""list_sort(list_distinct([{", ".join(f'round(quantile_cont(CAST("{c}" AS DOUBLE), {p}), 6)' for p in drift.DECILES)}])) AS "{c}" """ for c in _INPUTS)
    cells = " UNION ALL ".join(
        f"""SELECT period, '{c}' AS "column", CASE WHEN v."{c}" IS NULL THEN -1 ELSE len(list_filter(e."{c}", lambda x: x < v."{c}")) END AS bin FROM v, e""" for c in _INPUTS
    )
    grid = " UNION ALL ".join(f"""SELECT '{c}' AS "column", unnest(range(-1, len("{c}") + 1)) AS bin, len("{c}") + 2 AS bins FROM e""" for c in _INPUTS)
    return f"""WITH v AS (SELECT strftime("OrderDate", '%Y-%m') AS period, year("OrderDate") AS y, "Quantity", "UnitPrice", "Discount",
        CASE WHEN l_orderkey % 17 <> 0 OR year("OrderDate") < 1996 THEN "TotalAmount" END AS "TotalAmount" FROM ({SALES})),
      b AS (SELECT min(y) AS first FROM v),
      e AS (SELECT {edges} FROM v, b WHERE y = first),
      h AS (SELECT period, "column", bin, count(*) AS n FROM ({cells}) GROUP BY ALL),
      base AS (SELECT "column", bin, sum(n) AS m FROM h, b WHERE starts_with(period, CAST(first AS VARCHAR)) GROUP BY ALL),
      g AS (SELECT period, "column", bin, bins, coalesce(n, 0) AS n, coalesce(m, 0) AS m
            FROM (SELECT DISTINCT period FROM h) CROSS JOIN ({grid}) LEFT JOIN h USING (period, "column", bin) LEFT JOIN base USING ("column", bin)),
      s AS (SELECT *, (n + 0.5::DOUBLE) / (sum(n) OVER w + bins * 0.5::DOUBLE) AS p, (m + 0.5::DOUBLE) / (sum(m) OVER w + bins * 0.5::DOUBLE) AS q,
              abs(sum(CASE WHEN bin >= 0 THEN n ELSE 0 END) OVER u / CAST(nullif(sum(CASE WHEN bin >= 0 THEN n ELSE 0 END) OVER w, 0) AS DOUBLE)
                - sum(CASE WHEN bin >= 0 THEN m ELSE 0 END) OVER u / CAST(nullif(sum(CASE WHEN bin >= 0 THEN m ELSE 0 END) OVER w, 0) AS DOUBLE)) AS gap
            FROM g WINDOW w AS (PARTITION BY period, "column"), u AS (PARTITION BY period, "column" ORDER BY bin))
      SELECT period, "column", CAST(sum(n) AS BIGINT) AS rows, CAST(sum(CASE WHEN bin = -1 THEN n ELSE 0 END) AS BIGINT) AS missing,
        round(sum((p - q) * ln(p / q)), 6) AS psi, round(max(gap), 6) AS ks, sum((p - q) * ln(p / q)) > 0.2::DOUBLE AS alert
      FROM s GROUP BY period, "column" """


ORACLES = {
    "heavy_hitters": " UNION ALL ".join(
        f"""(SELECT '{c}' AS "column", {e} AS value, count(*) AS count, ROUND(count(*) / CAST((SELECT count(*) FROM lineitem) AS DOUBLE), 9) AS share
        FROM lineitem GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)""" for c, e in (("l_orderkey", "l_orderkey"), ("uneven", "l_orderkey % (l_partkey % 97 + 1)"))
    ),
    "streamed_days": """WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total
        FROM events GROUP BY 1, 2)
      SELECT * FROM d WHERE CAST(day + 1 AS TIMESTAMP) <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
    "join_bucketed": """SELECT o_orderpriority, count(*) AS lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS amount
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
    "layouts": """SELECT layout, CAST(n AS BIGINT) AS partitions, (SELECT count(*) FROM orders) AS rows FROM (VALUES ('even', 8), ('by_key', 6), ('merged', 2), ('held', 4)) t(layout, n)""",
    "renamed_orders": """SELECT o_orderkey AS "OrderID", o_totalprice AS "TotalAmount" FROM orders""",
    "running_events": """SELECT ts, event_id, value, row_number() OVER w AS place, CAST(sum(CAST(value AS DECIMAL(18, 4))) OVER w AS DOUBLE) AS total,
        count(value) OVER w AS seen, min(value) OVER w AS lowest, max(value) OVER w AS highest,
        lag(value, 1) OVER w AS previous, lag(value, 7) OVER w AS week_ago, lead(value, 1) OVER w AS next,
        row_number() OVER w <= floor((SELECT count(*) FROM events) * 0.8::DOUBLE) AS is_train
      FROM events WINDOW w AS (ORDER BY ts, event_id)""",
    "seasonal_anomalies": _SEASONS + """SELECT "PaymentMethod", date, value, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal, round(remainder, 4) AS remainder,
        round(score, 4) AS score, is_anomaly FROM f""",
    "anomaly_alerts": _SEASONS + """SELECT "PaymentMethod", count(*) AS days, count(*) FILTER (is_anomaly) AS anomalies, max(date) FILTER (is_anomaly) AS last_anomaly,
        arg_max(date, {'s': coalesce(score, 'inf'::DOUBLE), 'd': date}) FILTER (is_anomaly) AS worst_day, count(*) FILTER (is_anomaly) > 3 AS alert FROM f GROUP BY 1""",
    "input_drift_by_month": _drift_sql(),
    # The exact likelihood of AR(1) depends on four sums; a grid finds its maximum, first coarse, then fine.
    "ar1_likelihood_by_state": "WITH " + _filled("State") + """,
      x AS (SELECT "State", value - avg(value) OVER (PARTITION BY "State") AS x, row_number() OVER w AS i, count(*) OVER (PARTITION BY "State") AS n
            FROM filled WINDOW w AS (PARTITION BY "State" ORDER BY date)),
      l AS (SELECT *, lag(x) OVER (PARTITION BY "State" ORDER BY i) AS y FROM x),
      s AS (SELECT "State", max(n) AS n, sum(x * x) FILTER (i > 1) AS a, sum(x * y) AS b, sum(y * y) AS c, sum(x * x) FILTER (i = 1) AS f FROM l GROUP BY 1),
      coarse AS (SELECT s.*, phi FROM s, (SELECT unnest(range(-99, 100)) / 100.0::DOUBLE AS phi)
        QUALIFY row_number() OVER (PARTITION BY "State" ORDER BY n * ln(f * (1 - phi * phi) + a - 2 * phi * b + phi * phi * c) - ln(1 - phi * phi)) = 1),
      fine AS (SELECT "State", n, a, b, c, f, phi + step / 100000.0::DOUBLE AS phi FROM coarse, (SELECT unnest(range(-1000, 1001)) AS step)
        WHERE abs(phi + step / 100000.0::DOUBLE) < 1
        QUALIFY row_number() OVER (PARTITION BY "State" ORDER BY n * ln(f * (1 - (phi + step / 100000.0::DOUBLE) ** 2) + a - 2 * (phi + step / 100000.0::DOUBLE) * b + (phi + step / 100000.0::DOUBLE) ** 2 * c) - ln(1 - (phi + step / 100000.0::DOUBLE) ** 2)) = 1)
      SELECT "State", n, round(phi, 3) AS phi FROM fine""",
    "sketch_ranks": f"""SELECT event_type, prob, count(value) AS rows, count(value) AS sketched, TRUE AS within_bound
      FROM events, (SELECT unnest([{", ".join(f"{p}::DOUBLE" for p in _PROBS)}]) AS prob) GROUP BY 1, 2""",
}
