"""Declared schemas. Declaring them saves the extra pass of inference and keeps types stable."""

from __future__ import annotations

from pyspark.sql import types as T

_DOUBLE, _STRING, _INT, _DATE = T.DoubleType(), T.StringType(), T.IntegerType(), T.DateType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# OrderDate stays text here: parsing it is part of cleaning.
ORDERS = _schema(
    OrderID=_STRING, OrderDate=_STRING, CustomerID=_STRING, ProductID=_STRING, ProductName=_STRING,
    Category=_STRING, Quantity=_INT, UnitPrice=_DOUBLE, Discount=_DOUBLE, Tax=_DOUBLE,
    ShippingCost=_DOUBLE, TotalAmount=_DOUBLE, PaymentMethod=_STRING, City=_STRING, State=_STRING,
)

LISTINGS = _schema(
    **{
        "Rating": _DOUBLE,
        "Company Name": _STRING,
        "Job Title": _STRING,
        "Salary": _DOUBLE,
        "Salaries Reported": _INT,
        "Location": _STRING,
        "Employment Status": _STRING,
        "Job Roles": _STRING,
    }
)
LISTINGS_HEADER = ",".join(LISTINGS.names)

PRICES = _schema(timestamp=T.TimestampType(), price=_DOUBLE)

SCORING = _schema(OrderDate=_DATE, Quantity=_DOUBLE, Discount=_DOUBLE, Tax=_DOUBLE, ShippingCost=_DOUBLE)

MANIFEST = _schema(
    pipeline_run=_STRING,
    model_type=_STRING,
    deployment_source=_STRING,
    metrics=_schema(rmse=_DOUBLE, r2=_DOUBLE),
    monitoring=_schema(status=_STRING, action_required=T.BooleanType()),
)
