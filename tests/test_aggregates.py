import pytest
from helpers import plan
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlight.operators import aggregates as agg
from ledgerlight.operators import joins, partitioning, quality
from ledgerlight.sources.sales import sales_view, table


def pairs(spark, rows):
    return spark.createDataFrame(rows, "k string, v double")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(-(10**6), 10**6).map(lambda c: c / 100)), min_size=1, max_size=40))
def test_average_from_partials_equals_average(spark, rows):
    df = pairs(spark, rows)
    half = len(rows) // 2
    parts = [agg.key_partials(pairs(spark, part), "k", "v") for part in (rows[:half], rows[half:]) if part]
    assert agg.merge_partials(agg.bag_union(*parts), "k").collect() == agg.key_averages(df, "k", "v").collect()


def test_values_keep_every_copy(spark):
    got = agg.key_values(pairs(spark, [("a", 2.0), ("a", 1.0), ("a", 2.0), ("b", 5.0)]), "k", "v").collect()
    assert sorted(r[:] for r in got) == [("a", 1.0, 1), ("a", 2.0, 2), ("b", 5.0, 1)]


def test_ties_are_ordered_by_key(spark):
    df = pairs(spark, [("b", 1.0), ("a", 1.0), ("c", 9.0)])
    assert [r.k for r in agg.revenue_by(df, "k", "v", top=2).collect()] == ["c", "a"]
    assert [r.k for r in agg.key_counts(df, "k", top=2).collect()] == ["a", "b"]
    assert [r.k for r in agg.revenue_by(df, "k", "v", order="asc").collect()] == ["a", "b", "c"]


def test_shares(spark):
    df = pairs(spark, [("a", 1.0), ("a", 1.0), ("b", 1.0), (None, 1.0)])
    assert [(r.k, r["count"], round(r.percentage, 3)) for r in agg.value_shares(df, "k").collect()] == [("a", 2, 66.667), ("b", 1, 33.333)]
    assert agg.share(df, F.col("k") == "a").first()[:] == (4, 2, 50.0)
    assert agg.share(df.limit(0), F.col("k") == "a").first()[:] == (0, 0, None)


def test_union_keeps_duplicates_and_matches_names(spark):
    a, b = spark.sql("SELECT 1 AS x, 2 AS y"), spark.sql("SELECT 2 AS y, 1 AS x")
    assert [r[:] for r in agg.bag_union(a, b).collect()] == [(1, 2), (1, 2)]


def test_top_is_not_a_full_sort(spark, sf):
    df = agg.revenue_by(sales_view(spark, sf, ["ProductName", "TotalAmount"]), "ProductName", top=10)
    assert "TakeOrderedAndProject" in plan(df)


def test_totals_are_combined_before_the_shuffle(spark, sf):
    text = plan(agg.key_totals(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"))
    assert "partial_sum" in text and "WholeStageCodegen" not in text  # shown only in the final plan
    assert "ReadSchema: struct<o_totalprice:double,o_orderpriority:string>" in text


def test_view_joins_only_what_it_needs(spark, sf):
    assert plan(sales_view(spark, sf, ["Category"])).count("FileScan") == 5
    assert plan(sales_view(spark, sf)).count("FileScan") == 5


def test_join_forms(spark, sf):
    fact = sales_view(spark, sf, ["State", "TotalAmount"])
    dim = joins.derive_dimension(fact, "State", Region="Standard")
    merged, salted, broadcast = joins.join_merge(fact, dim, "State"), joins.join_merge(fact, dim, "State", 8), joins.join_broadcast(fact, dim, "State")
    assert "SortMergeJoin [State" in plan(merged) and "_salt" in plan(salted)
    assert "BroadcastHashJoin [State" in plan(broadcast)
    counts = {d.groupBy("State", "Region").count().exceptAll(merged.groupBy("State", "Region").count()).count() for d in (salted, broadcast)}
    assert counts == {0}
    assert salted.columns == merged.columns


def test_large_dimension_is_not_broadcast(spark):
    fact, dim = spark.range(100).select((F.col("id") % 10).alias("k")), spark.range(10).select(F.col("id").alias("k"))
    df = joins.join_broadcast(fact, dim, "k", max_bytes=20, salts=4)
    assert "Broadcast" not in plan(df) and df.count() == 100


def test_salted_join_spreads_a_hot_key(spark):
    hot = spark.range(0, 4000, 1, 8).select(F.lit("hot").alias("k"))
    dim = spark.createDataFrame([("hot", 1)], "k string, a int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the test data is small
    try:
        df = joins.join_merge(hot, dim, "k", salts=16)
        assert df.count() == 4000
        assert df.groupBy(F.spark_partition_id()).count().count() > 3
        assert joins.join_merge(hot, dim, "k").groupBy(F.spark_partition_id()).count().count() == 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_skew_report(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [("c",)] * 3, "k string")
    assert [r[:] for r in partitioning.skew_report(df, "k", top=2).collect()] == [("a", 6, 0.5, 2.0), ("b", 3, 0.25, 1.0)]


def test_partition_reports(spark):
    df = partitioning.spread(spark.range(100), 4)
    assert sum(r.rows for r in partitioning.partition_counts(df).collect()) == 100
    row = partitioning.partition_report(df, "after").first()
    assert row["label"] == "after" and row["count"] == 4 and sum(row["sample_distribution"]) == 100
    few = partitioning.spread(spark.range(100).select((F.col("id") % 2).alias("k")), 8, "k")
    assert partitioning.partition_counts(few).count() <= 2
    assert partitioning.shrink(df, 2).rdd.getNumPartitions() == 2


def test_hold_and_release(spark):
    df = partitioning.hold(spark.range(10))
    assert df.count() == 10 and df.storageLevel.useMemory and df.storageLevel.useDisk
    partitioning.release(df)
    assert not df.storageLevel.useMemory


def test_timing_log_runs_actions(spark):
    calls, log = [], partitioning.TimingLog(runs=3)
    assert log.run("Join", "after", "broadcast", lambda: calls.append(1) or spark.range(3).count()) == 3
    row = log.to_df(spark).first()
    assert len(calls) == 4 and row[:3] == ("Join", "after", "broadcast") and row.seconds > 0


def test_configure_sets_adaptive_execution(spark):
    partitioning.configure(spark)
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    partitioning.configure(spark, shuffle_bytes=10 * 2**40)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "81920"
    partitioning.configure(spark, shuffle_partitions=8)


def test_quality_rules(spark):
    df = spark.createDataFrame([(1.0, "3"), (None, "x"), (50.0, None)], "x double, t string")
    rules = quality.missing_rules(["x"]) | quality.range_rules({"x": (0, 10)}) | quality.type_rules({"t": "int"})
    got = {r.rule: (r.rows, r.violations, r.passed) for r in quality.quality_report(df, rules, 0.5).collect()}
    assert got == {"x missing": (3, 1, True), "x out of range": (3, 1, True), "t not int": (3, 1, True)}
    assert not quality.quality_report(df, rules).first().passed
    assert quality.quality_report(df.limit(0), rules).first().share == 0.0


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 2.0), (None, 1.0)], "y double, p double")
    row = quality.regression_metrics(df, "y", "p").first()
    assert row["rows"] == 3
    assert row.mse == pytest.approx(10 / 3) and row.rmse == pytest.approx((10 / 3) ** 0.5)
    assert row.mae == pytest.approx(4 / 3) and row.r2 == pytest.approx(1 - 10 / 8)
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "y double, p double")
    assert quality.regression_metrics(same, "y", "p").first().r2 == 0.0


def test_health_drift_and_alerts(spark):
    metrics = spark.createDataFrame([("2024-01", 100.0), ("2024-02", 105.0), ("2024-03", 150.0)], "month string, rmse double")
    health = quality.model_health(metrics, 120).orderBy("month").collect()
    assert [(r.status, r.action_required) for r in health] == [("HEALTHY", False), ("HEALTHY", False), ("DEGRADED", True)]
    alerted = quality.alerts(quality.drift(metrics, "month")).orderBy("month").collect()
    assert [r.alert for r in alerted] == [False, False, True]
    assert alerted[2].change_from_previous == pytest.approx(45 / 105)
