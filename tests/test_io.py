import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.operators.cleaning import OrderRules
from ledgerlight.sources import readers, schemas, sinks
from ledgerlight.sources.sales import sales_view, table
from ledgerlight.streaming import ingest


def uri(path):
    return f"file:{path}"


ORDER_LINES = """OrderID,OrderDate,CustomerID,ProductID,ProductName,Category,Quantity,UnitPrice,Discount,Tax,ShippingCost,TotalAmount,PaymentMethod,City,State
{}
"""


def order_file(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(ORDER_LINES.format("\n".join(rows)))


GOOD = "{},2024-01-0{},c,p,n,k,2,1.0,0.1,,3.0,{},m,x,y"


def test_csv_with_schema_and_corrupt_rows(spark, tmp_path):
    order_file(tmp_path / "in", "a.csv", GOOD.format("a", 1, 10), "b,2024-01-02,c,p,n,k,two,1,0,0,0,5,m,x,y")
    df = readers.read_csv(spark, uri(tmp_path / "in"), schemas.ORDERS, keep_corrupt=True).cache()
    rows = {r.OrderID: r for r in df.collect()}
    assert rows["a"].TotalAmount == 10.0 and rows["a"]._corrupt_record is None
    assert rows["b"].Quantity is None and rows["b"]._corrupt_record.startswith("b,")
    inferred = dict(readers.read_csv(spark, uri(tmp_path / "in")).dtypes)
    assert inferred["TotalAmount"] in ("double", "int")


def test_lines_and_header(spark, tmp_path):
    (tmp_path / "x.txt").write_text("head\na,b\n")
    path = uri(tmp_path / "x.txt")
    assert readers.first_line(spark, path) == "head"
    assert [r.value for r in readers.read_lines(spark, path).collect()] == ["head", "a,b"]


def test_transfer_between_formats(spark, sf, tmp_path):
    csv, parquet = uri(tmp_path / "csv"), uri(tmp_path / "pq")
    n = table(spark, sf, "customer").count()
    assert sinks.transfer(spark, f"{sf}/customer.parquet", "parquet", csv, "csv") == n
    schema = table(spark, sf, "customer").schema
    assert sinks.transfer(spark, csv, "csv", parquet, schema=schema) == n
    assert spark.read.parquet(parquet).exceptAll(table(spark, sf, "customer")).count() == 0
    for args in (("orc", parquet, "parquet"), ("csv", parquet, "orc")):
        with pytest.raises(ValueError, match="unknown format"):
            sinks.transfer(spark, csv, *args)
    assert spark.range(1).count() == 1  # the session is still there


def test_verify_write_finds_changes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "i int, s string")
    path = uri(tmp_path / "t")
    sinks.write_parquet(df.repartition(3), path)
    assert sinks.verify_write(df, path).first().matches
    sinks.write_parquet(df.dropDuplicates().union(df.limit(0)), path)
    assert not sinks.verify_write(df, path).first().matches
    sinks.write_parquet(df.withColumn("s", F.lit("b")), path)
    assert not sinks.verify_write(df, path).first().matches


def test_partitioned_write_is_pruned(spark, sf, tmp_path):
    path = uri(tmp_path / "silver")
    df = sales_view(spark, sf, ["OrderID", "OrderDate"]).withColumn("year", F.year("OrderDate"))
    sinks.write_parquet(df, path, ["year"])
    text = spark.read.parquet(path).filter("year = 1997")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in text
    assert spark.read.parquet(path).count() == df.count()


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "o.csv").write_text("x,b,a\n1,2.5,7\n1,bad,8\n1,2,3,4\n ,\" 3\",9\n")
    path = uri(tmp_path / "o.csv")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType())])
    rows = readers.read_csv(spark, path, schema, keep_corrupt=True).collect()
    assert [(r.a, r.b) for r in rows if not r[readers.CORRUPT]] == [(7, 2.5), (9, 3.0)] and len(rows) == 4
    with pytest.raises(ValueError, match="missing columns: z"):
        readers.read_csv(spark, path, T.StructType([T.StructField("z", T.StringType())]))


def test_csv_copies_lose_nothing_and_damage_is_found(spark, tmp_path):
    df = spark.sql("""SELECT * FROM VALUES (' lead', timestamp_ntz'2024-01-01 00:00:00.123456'), ('a\nb "q"', NULL), ('', NULL), (NULL, NULL) t(s, t)""")
    src, csv = uri(tmp_path / "src"), uri(tmp_path / "copy")
    sinks.write_parquet(df, src)
    assert sinks.transfer(spark, src, "parquet", csv, "csv", multi_line=True) == 4
    back = readers.read_csv(spark, csv, df.schema, multi_line=True, null_mark=sinks.NULL_MARK)
    assert back.exceptAll(df).count() == 0
    with pytest.raises(RuntimeError, match="differ"):
        sinks.transfer(spark, src, "parquet", uri(tmp_path / "broken"), "csv")


def test_report_file_layout_is_the_callers_choice(spark, tmp_path):
    df = spark.range(0, 100, 1, 4)
    sinks.write_report(df, uri(tmp_path / "small"))
    assert len(list((tmp_path / "small").glob("*.csv"))) == 1
    sinks.write_report(df, uri(tmp_path / "large"), single_file=False)
    assert len(list((tmp_path / "large").glob("*.csv"))) == 4
    assert readers.read_csv(spark, uri(tmp_path / "large")).count() == 100


def test_report_keeps_its_order(spark, tmp_path):
    df = spark.range(0, 2000, 1, 8).orderBy(F.desc("id"))
    sinks.write_report(df, uri(tmp_path / "r"))
    (file,) = (tmp_path / "r").glob("*.csv")
    assert file.read_text().split() == ["id", *map(str, range(1999, -1, -1))]


def test_manifest_round_trip(spark, tmp_path):
    health = spark.sql("SELECT 12.34567D AS rmse, 0.98765D AS r2, 'HEALTHY' AS status, false AS action_required")
    path = uri(tmp_path / "logs")
    sinks.write_manifest(health, path, "run-1", "Linear", "file")
    row = readers.read_manifest(spark, path).first()
    assert row[:] == ("run-1", "Linear", "file", 12.3457, 0.9877, "HEALTHY", False)


def test_optional_sink_failure_is_recorded(spark, tmp_path):
    log = sinks.SinkLog()
    bad = lambda: sinks.write_csv(spark.sql("SELECT array(1) AS a"), uri(tmp_path / "x"))
    assert log.run("good", lambda: sinks.write_csv(spark.range(1), uri(tmp_path / "y")))
    assert not log.run("optional", bad, required=False)
    with pytest.raises(Exception):
        log.run("needed", bad)
    assert [(r.sink, r.status) for r in log.to_df(spark).collect()] == [("good", "written"), ("optional", "failed"), ("needed", "failed")]


def test_layers_and_schemes():
    assert sinks.layer_path("hdfs://n/base/", "silver", "orders") == "hdfs://n/base/silver/orders"
    with pytest.raises(ValueError):
        sinks.layer_path("x", "tin", "orders")
    with pytest.raises(ValueError, match="file system"):
        readers.require_scheme("/models/a")
    assert readers.require_scheme("file:/models/a") == "file:/models/a"


def test_stream_takes_in_each_order_once(spark, tmp_path):
    order_file(tmp_path / "in", "1.csv", GOOD.format("a", 5, 10), GOOD.format("b", 6, -20), GOOD.format("x", 5, ""), GOOD.format("far", 5, 9999))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run(checkpoint):
        raw = ingest.order_stream(spark, str(tmp_path / "in"))
        ingest.start_ingest(raw, out, checkpoint, OrderRules(), bounds=(0, 100)).awaitTermination(120)
        return sorted((r.OrderID, r.TotalAmount, r.Tax) for r in spark.read.parquet(out).collect())

    assert run(state) == [("a", 10.0, 0.0), ("b", 20.0, 0.0)]
    late = GOOD.format("old", 1, 40).replace("2024", "1999")
    order_file(tmp_path / "in", "2.csv", GOOD.format("a", 5, 10), GOOD.format("c", 7, 30), GOOD.format("c", 7, 30), late)
    whole = [("a", 10.0, 0.0), ("b", 20.0, 0.0), ("c", 30.0, 0.0), ("old", 40.0, 0.0)]
    assert run(state) == whole
    assert run(str(tmp_path / "lost")) == whole  # all files again, nothing twice
