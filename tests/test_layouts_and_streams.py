"""Dictionaries, stored buckets and event-time windows."""

import datetime as dt

import pytest
from helpers import plan
from pyspark.sql import functions as F

from ledgerlight.functions import staging
from ledgerlight.operators import encoding
from ledgerlight.streaming import events as streams

SCHEMA = "event_id long, ts timestamp, kind string, value decimal(18,2)"


def test_dictionary_numbers_values_and_joins_by_size(spark):
    rows = [(i, f"v{i % 300:03d}" if i % 7 else None) for i in range(3000)] + [(9000 + i, "hot") for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, c string").repartition(6)
    known = encoding.category_dictionary(df, "c", partitions=5)
    values = sorted({c for _, c in rows if c})
    assert [(r.value, r["index"]) for r in known.orderBy("index").collect()] == [(v, i) for i, v in enumerate(values)]
    assert known.agg(F.sum("rows")).first()[0] == sum(c is not None for _, c in rows)
    wanted = {i: values.index(c) if c else len(values) for i, c in rows}
    for limit, join in ((64 << 20, "BroadcastHashJoin"), (10, "SortMergeJoin")):
        coded = encoding.encode(df, known, "c", max_bytes=limit)
        assert join in plan(coded)
        assert {r.id: r.c_idx for r in coded.collect()} == wanted
    few = encoding.encode(df, known.where("value < 'v002'"), "c", "n")
    assert {r.n for r in few.collect()} == {0, 1, 2, 3}
    none = encoding.category_dictionary(df.limit(0), "c")
    assert none.collect() == [] and {r.c_idx for r in encoding.encode(df, none, "c").collect()} == {0}


def test_bucketed_tables_join_without_a_shuffle(spark):
    since = len(staging.staged_paths())
    a = staging.stage_bucketed(spark.range(1000).selectExpr("id % 50 AS k", "id AS x"), "a", "k", 4)
    b = staging.stage_bucketed(spark.range(50).selectExpr("id AS j", "id * 2 AS y"), "b", "j", 4)
    joined = a.hint("merge").join(b, a.k == b.j)
    assert "Exchange" not in plan(joined) and "Exchange" not in plan(joined.groupBy("k").count())
    assert joined.agg(F.sum("y")).first()[0] == sum(2 * (i % 50) for i in range(1000))
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith("ledgerlight_")]
    assert len(names) >= 2
    staging.release(since)
    assert len([t.name for t in spark.catalog.listTables() if t.name.startswith("ledgerlight_")]) == len(names) - 2


def day(n, hour=12):
    return dt.datetime(2024, 1, n, hour)


def test_late_and_repeated_events_count_once_in_closed_days(spark, tmp_path):
    source, table, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))

    def arrive(rows):
        spark.createDataFrame([(i, t, k, v) for i, t, k, v in rows], "event_id long, ts timestamp, kind string, value double").selectExpr(
            "event_id", "ts", "kind", "cast(value AS decimal(18,2)) AS value"
        ).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = streams.event_stream(spark, source, spark.createDataFrame([], SCHEMA).schema)
        totals = streams.daily_windows(stream, by=("kind",), value=F.col("value"))
        streams.start_daily(totals, table, checkpoint).awaitTermination()
        return {(r.day.day, r.kind): (r.events, float(r.total)) for r in spark.read.schema(totals.schema).parquet(table).collect()}

    arrive([(1, day(1), "a", 1.5), (2, day(1), "a", 2.0), (2, day(1), "a", 2.0), (3, day(2), "b", 1.0), (4, None, "a", 9.0)])
    assert run() == {}  # nothing is closed yet
    arrive([(5, day(1, 23), "a", 4.0), (1, day(1), "a", 1.5), (6, day(4), "a", 1.0)])  # late by less than the delay, and a copy
    assert run() == {(1, "a"): (3, 7.5), (2, "b"): (1, 1.0)}
    arrive([(7, day(1), "a", 100.0), (8, day(8), "a", 1.0)])  # too late: its day is closed
    assert run() == {(1, "a"): (3, 7.5), (2, "b"): (1, 1.0), (4, "a"): (1, 1.0)}


def test_streams_without_values(spark, tmp_path):
    frame = spark.createDataFrame([], SCHEMA)
    stream = streams.event_stream(spark, f"file://{tmp_path}", frame.schema)
    assert streams.daily_windows(stream).columns == ["day", "events"]
    with pytest.raises(Exception, match="missing|cannot be resolved|UNRESOLVED"):
        streams.daily_windows(stream, time="missing")


def exact_top(rows, top):
    from collections import Counter

    return [(k, n) for k, n in sorted(Counter(rows).items(), key=lambda x: (-x[1], x[0] is not None, x[0]))][:top]


@pytest.mark.parametrize("counters", [3, 50, 5_000])
def test_top_keys_equal_the_exact_report(spark, counters):
    import random

    from ledgerlight.operators import frequent

    rng = random.Random(counters)
    columns = {
        "distinct": [f"k{i}" for i in range(4000)],  # as many values as rows
        "hot": ["a"] * 2000 + ["b"] * 900 + [None] * 500 + [f"k{i}" for i in range(600)],
        "zipf": [f"k{int(rng.paretovariate(0.7))}" for _ in range(4000)],
        "ties": [f"k{i % 40:02d}" for i in range(4000)],
    }
    for name, values in columns.items():
        rng.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], f"{name} string").repartition(4)
        got = frequent.top_keys(df, name, 5, counters).collect()
        assert [(r[name], r["count"]) for r in got] == exact_top(values, 5), name
        assert got[0].share == got[0]["count"] / 4000
    assert frequent.top_keys(df.limit(0), "ties").collect() == []


def test_summaries_bound_every_count(spark):
    from collections import Counter

    from ledgerlight.operators import frequent

    values = [i % (i % 50 + 1) for i in range(6000)]
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(3)
    merged, error, rows = frequent.merge_summaries(frequent.frequent_summary(df, "v", 7))
    low, true = {r.value: r.low for r in merged.collect()}, Counter(values)
    assert rows == 6000 and all(low.get(v, 0) <= n <= low.get(v, 0) + error for v, n in true.items())
    assert error <= 6000 / 8
