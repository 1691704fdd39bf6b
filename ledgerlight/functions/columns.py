"""Scalar column expressions. Everything here is a built-in expression, so it stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a number may look like in a text field. Java also reads "1d" and "1f"
# as numbers; a data file that holds those holds text.
FLOAT_PATTERN = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
INTEGER_PATTERN = r"^[+-]?\d+$"

# The characters Unicode counts as whitespace, which ``trim`` alone leaves in place.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Remove leading and trailing whitespace, including tabs and non-breaking spaces."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def is_blank(c: str | Column) -> Column:
    """True for an empty or whitespace-only string."""
    return strip(c) == ""


def parse_double(c: str | Column) -> Column:
    """Text without outer whitespace to double; null where it is not a number."""
    return F.when(_col(c).rlike(FLOAT_PATTERN), _col(c).try_cast("double"))


def parse_long(c: str | Column) -> Column:
    """Text without outer whitespace to long; null where it is not whole (``4.0`` is not)."""
    return F.when(_col(c).rlike(INTEGER_PATTERN), _col(c).try_cast("bigint"))


def period_label(date: str | Column, period: str, separator: str = " ") -> Column:
    """Label a date with its ``month`` (2022-03), ``year_quarter`` (2022 Q1) or ``quarter`` (Q1)."""
    date = _col(date)
    quarter = F.concat(F.lit("Q"), F.quarter(date).cast("string"))
    if period == "month":
        return F.date_format(date, "yyyy-MM")
    if period == "year_quarter":
        return F.concat(F.year(date).cast("string"), F.lit(separator), quarter)
    if period == "quarter":
        return quarter
    raise ValueError(f"unknown period {period!r}: use month, year_quarter or quarter")


def calendar_fields(date: str | Column) -> dict[str, Column]:
    """Day of month, day of week (1 = Sunday), month, year and ISO week of a date."""
    date = _col(date)
    return {
        "day_of_month": F.dayofmonth(date),
        "day_of_week": F.dayofweek(date),
        "month": F.month(date),
        "year": F.year(date),
        "week_of_year": F.weekofyear(date),
    }


def hash_bucket(keys: Sequence[str | Column], seed: int) -> Column:
    """A number in [0, 2^32) that depends only on the key values and the seed.

    Unlike ``rand(seed)`` it does not change when the data is partitioned differently, so a
    lost executor, a repartition or another cluster size gives the same sample. md5 rather
    than xxhash64 so that any SQL engine can repeat it.
    """
    parts = [_col(k).cast("string") for k in keys]
    # Lengths and a mark for null, so that different keys never give the same text.
    marked = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    text = F.concat_ws("|", *marked, F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of the numeric columns, in schema order."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ("ProductName",)) -> list[str]:
    """Names of the string columns, in schema order, without the free-text ones."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in exclude
    ]


def finite_or_null(df: DataFrame, name: str) -> Column:
    """The column as a number with NaN read as missing."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c
