from datetime import date

import pytest
from helpers import plan
from pyspark.sql import functions as F

from ledgerlight.operators import cleaning as c
from ledgerlight.operators.lines import classify_lines, line_report, parse_lines, token_counts, without_header
from ledgerlight.sources.schemas import LISTINGS, LISTINGS_HEADER, ORDERS

GOOD = dict(OrderID="a", OrderDate="2024-01-02", CustomerID="c", ProductID="p", ProductName="n", Category="k", Quantity=2,
            UnitPrice=1.0, Discount=0.1, Tax=0.2, ShippingCost=3.0, TotalAmount=10.0, PaymentMethod="m", City="x", State="y")


def orders(spark, *changes):
    return spark.createDataFrame([tuple((GOOD | ch)[n] for n in ORDERS.names) for ch in changes], ORDERS)


def test_clean_orders_repairs_and_drops(spark):
    raw = orders(
        spark,
        {"OrderID": "neg", "TotalAmount": -5.0},
        {"OrderID": "low", "Quantity": 0},
        {"OrderID": "noqty", "Quantity": None},
        {"OrderID": "nodisc", "Discount": None, "Tax": None, "ShippingCost": None},
        {"OrderID": None},
        {"OrderID": "nodate", "OrderDate": None},
        {"OrderID": "baddate", "OrderDate": "2024-13-40"},
        {"OrderID": "noamount", "TotalAmount": None},
    )
    got = {r.OrderID: r for r in c.clean_orders(raw, c.OrderRules(iqr_factor=None)).collect()}
    assert set(got) == {"neg", "low", "noqty", "nodisc"}
    assert got["neg"].TotalAmount == 5.0 and got["low"].Quantity == 1 and got["noqty"].Quantity is None
    assert (got["nodisc"].Discount, got["nodisc"].Tax, got["nodisc"].ShippingCost) == (0.0, 0.0, 0.0)
    assert got["neg"].OrderDate == date(2024, 1, 2)
    assert "CustomerID" not in got["neg"].asDict()


def test_default_quantity_does_not_escape_the_clamp(spark):
    rules = c.OrderRules(iqr_factor=None, defaults={"Quantity": 0})
    assert c.clean_orders(orders(spark, {"Quantity": None}), rules).first().Quantity == 1


def test_broken_copy_does_not_displace_a_good_one(spark):
    raw = orders(spark, {"TotalAmount": None}, {"TotalAmount": 7.0}, {"OrderDate": "bad"})
    assert [r.TotalAmount for r in c.clean_orders(raw, c.OrderRules(iqr_factor=None)).collect()] == [7.0]


def test_clean_orders_stores_what_the_caller_shapes(spark):
    raw = orders(spark, *[{"OrderID": str(i), "TotalAmount": 10.0 + i} for i in range(9)], {"OrderID": "far", "TotalAmount": 1e6})
    shaped = c.clean_orders(raw, shape=lambda rows: rows.select("TotalAmount", (F.col("Quantity") * 2).alias("twice")))
    assert shaped.columns == ["TotalAmount", "twice"]
    assert sorted(map(tuple, shaped.collect())) == sorted((r.TotalAmount, r.Quantity * 2) for r in c.clean_orders(raw).collect())
    assert "Project" not in plan(shaped) and "Window" not in plan(shaped)


def test_clean_orders_removes_outliers_and_pushes_the_bounds(spark):
    raw = orders(spark, *[{"OrderID": str(i), "TotalAmount": float(i)} for i in range(1, 21)], {"OrderID": "far", "TotalAmount": 1e6})
    clean = c.clean_orders(raw)
    assert {r.OrderID for r in clean.collect()} == {str(i) for i in range(1, 21)}
    assert "GreaterThanOrEqual(TotalAmount" in plan(clean) and "LessThanOrEqual(TotalAmount" in plan(clean)


def test_clean_orders_of_nothing(spark):
    assert c.clean_orders(orders(spark, {"OrderID": None})).count() == 0


def test_cleaning_report(spark):
    raw = orders(spark, {}, {}, {"OrderDate": "bad"}, {"OrderID": "b", "TotalAmount": -1.0}, {"OrderID": "c", "Quantity": 0, "TotalAmount": None})
    got = c.cleaning_report(raw).first().asDict()
    assert got == dict(rows_in=5, rejected=2, duplicates=1, negative_amounts=1, low_quantities=1, rows_out=2)


def test_dedup_keeps_the_first_and_filters_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 3, "x"), (1, 2, "y"), (2, 9, "z")], "k int, o int, v string")
    result = c.dedup(df, ["k"], ["o"])
    assert sorted(r.v for r in result.collect()) == ["y", "z"]
    assert sorted(r.v for r in c.dedup(df, ["k"], [F.desc("o")]).collect()) == ["x", "z"]
    text = plan(result)
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_dedup_on_all_columns(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert c.dedup(df, ["a", "b"]).count() == 1


def test_clamp_keeps_null_and_type(spark):
    df = spark.createDataFrame([(0,), (None,), (4,)], "q int")
    out = c.clamp_min(df, "q", 1)
    assert [r.q for r in out.collect()] == [1, None, 4] and out.dtypes == [("q", "int")]


def test_mask_keeps_rows(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None), (3, 30.0)], "id int, x double")
    got = c.mask(df, F.col("x") > 15, keep=["id"]).collect()
    assert [r[:] for r in got] == [(1, None), (2, None), (3, 30.0)]


def test_filter_complement_and_null_make_the_whole(spark):
    df = spark.createDataFrame([(float(i) if i % 3 else None,) for i in range(60)], "x double")
    inside = c.range_filter(df, "x", 10, 20).count()
    outside = df.filter(~F.col("x").between(10, 20)).count()
    assert inside + outside + df.filter("x IS NULL").count() == 60


def test_fill_missing_leaves_text_alone(spark):
    df = spark.createDataFrame([(None, None)], "a int, b string")
    assert c.fill_missing(df).first()[:] == (0, None)
    assert c.fill_missing(df, {"b": "x", "absent": 1}).first()[:] == (None, "x")


def test_require_columns_names_the_missing(spark):
    with pytest.raises(ValueError, match="b, c"):
        c.require_columns(spark.range(1), ["id", "b", "c"])


def test_drop_ignores_absent_columns(spark):
    assert c.drop_columns(spark.range(1), "nope").columns == ["id"]


def test_no_python_in_the_cleaning_plan(spark):
    text = plan(c.unique_orders(orders(spark, {})))
    assert "Python" not in text


LINES = [
    LISTINGS_HEADER,
    "4.5, Acme\t,Engineer,1000.5,3, Pune ,Full Time,IT",
    LISTINGS_HEADER,
    "4.5,Acme,Engineer,1000.5,3,Pune,Full Time,IT",
    "4,Beta,Data  Engineer,7,1,Goa,Intern,IT",
    "4,Beta,Engineer,7,1,Goa,Intern",
    '4,Beta,"Engineer, senior",7,1,Goa,Intern,IT',
    "4,Beta,,7,1,Goa,Intern,IT",
    "4,Beta,  ,7,1,Goa,Intern,IT",
    "n/a,Beta,x,7,1,Goa,Intern,IT",
    "4,Beta,x,7f,1,Goa,Intern,IT",
    "4,Beta,x,7,1.0,Goa,Intern,IT",
    "4,Beta,x,7,1,Goa,Intern,",
    "",
]


def test_lines(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    valid, rejects = parse_lines(lines, LISTINGS, header=LISTINGS_HEADER)
    assert sorted(r[:] for r in valid.collect()) == [
        (4.0, "Beta", "Data  Engineer", 7.0, 1, "Goa", "Intern", "IT"),
        (4.5, "Acme", "Engineer", 1000.5, 3, "Pune", "Full Time", "IT"),
    ]
    reasons = [r.reason for r in rejects.collect()]
    assert sorted(reasons) == ["field count"] * 3 + ["missing value"] * 3 + ["not a number"] * 3
    report = line_report(lines, LISTINGS, header=LISTINGS_HEADER).first().asDict()
    assert report == dict(lines=14, header_lines=2, bad_field_count=3, bad_missing=3, bad_number=3, duplicates=1, rows_out=2)
    words = {r.word: r["count"] for r in token_counts(valid, "Job Title").collect()}
    assert words == {"Engineer": 2, "Data": 1, "": 1}


def test_every_line_is_valid_rejected_or_header(spark):
    lines = spark.createDataFrame([(x,) for x in LINES * 3], "value string")
    classified = classify_lines(lines, LISTINGS, header=LISTINGS_HEADER)
    assert classified.count() + lines.count() - without_header(lines, LISTINGS_HEADER).count() == len(LINES) * 3


def test_other_separators(spark):
    lines = spark.createDataFrame([("1|a|b|2|3|c|d|e",)], "value string")
    assert parse_lines(lines, LISTINGS, sep="|")[0].first()[:3] == (1.0, "a", "b")


def test_default_date_format_agrees_with_try_to_date(spark):
    texts = ["2024-02-29", "2023-02-29", "2024-13-01", "2024-1-2", "24-01-02", "2024-01-02 ", "2024-01-02T10", "2024", "0001-01-01", "bad", "", None]
    df = spark.createDataFrame([(t, t) for t in texts], "text string, d string")
    got = c.parse_date(df, "d").withColumn("want", F.try_to_date("text", "yyyy-MM-dd")).collect()
    assert [r.d for r in got] == [r.want for r in got]
    other = c.parse_date(spark.createDataFrame([("02/01/2024",)], "d string"), "d", "dd/MM/yyyy")
    assert other.first().d == date(2024, 1, 2)
