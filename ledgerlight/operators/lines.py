"""Typed rows out of untyped text lines, with the malformed ones set aside."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions.columns import parse_double, parse_long, strip


def _typed(i: int, kind: T.DataType) -> Column:
    c = F.get("fields", F.lit(i))
    if isinstance(kind, T.DoubleType):
        return parse_double(c)
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return parse_long(c).try_cast(kind)
    return c.cast(kind)


def _row(schema: T.StructType) -> list[Column]:
    return [_typed(i, f.dataType).alias(f.name) for i, f in enumerate(schema.fields)]


def without_header(lines: DataFrame, header: str) -> DataFrame:
    """Drop every line equal to ``header``, also where files were joined and it repeats."""
    return lines.filter(F.col("value") != header)


def classify_lines(
    lines: DataFrame, schema: T.StructType, sep: str = ",", header: str | None = None
) -> DataFrame:
    """Split ``lines.value`` on ``sep`` (quotes have no meaning) and check every field.

    Adds ``fields`` (array of text without outer whitespace), ``typed`` (the fields as the schema's types)
    and ``reason``: null for a good line, otherwise ``field count``, ``missing value`` or ``not a number``.
    """
    if header is not None:
        lines = without_header(lines, header)
    # -1 keeps trailing empty fields. split takes a regex, and has a faster way for one character.
    fields = F.transform(F.split("value", re.escape(sep), -1), strip)
    # Exploding a one-element array keeps the optimizer from copying the split into every
    # expression that reads a field, and a cast into every one that reads its number: each line is
    # split once and each number read once.
    lines = lines.select("*", F.explode(F.array(fields)).alias("fields"))
    lines = lines.select("*", F.explode(F.array(F.struct(*_row(schema)))).alias("typed"))
    bad_number = F.lit(False)
    for f in schema.fields:
        if isinstance(f.dataType, T.NumericType):
            bad_number = bad_number | F.col("typed")[f.name].isNull()
    return lines.withColumn(
        "reason",
        F.when(F.size("fields") != len(schema), "field count")
        .when(F.array_contains("fields", ""), "missing value")
        .when(bad_number, "not a number"),
    )


def typed_lines(classified: DataFrame) -> DataFrame:
    """Good lines as stripped, typed columns."""
    return classified.filter(F.col("reason").isNull()).select("typed.*")


def rejected_lines(classified: DataFrame) -> DataFrame:
    """Bad lines as (value, reason), for a quarantine table."""
    return classified.filter(F.col("reason").isNotNull()).select("value", "reason")


def parse_lines(
    lines: DataFrame, schema: T.StructType, sep: str = ",", header: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejects)``: distinct typed rows, and the rejected lines with their reason."""
    classified = classify_lines(lines, schema, sep, header)
    return typed_lines(classified).distinct(), rejected_lines(classified)


def line_report(
    lines: DataFrame, schema: T.StructType, sep: str = ",", header: str | None = None
) -> DataFrame:
    """One row: lines read, header lines, rejects per reason, duplicates and distinct rows.

    Lines that give the same typed row are counted together before the shuffle, so copies of one
    line cost nothing extra however many there are.
    """
    is_header = F.lit(False) if header is None else F.col("value") == header
    classified = classify_lines(lines.withColumn("header", is_header), schema, sep)
    state = F.when(F.col("header"), "header").otherwise(F.coalesce("reason", F.lit("valid")))
    counted = (
        classified.select(state.alias("state"), F.when(F.col("reason").isNull() & ~F.col("header"), F.col("typed")).alias("row"))
        .groupBy("state", "row")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    of = lambda s: F.coalesce(F.sum(F.when(F.col("state") == s, F.col("n"))), F.lit(0).cast("bigint"))
    distinct = F.count_if(F.col("state") == "valid")
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("lines"),
        of("header").alias("header_lines"),
        of("field count").alias("bad_field_count"),
        of("missing value").alias("bad_missing"),
        of("not a number").alias("bad_number"),
        (of("valid") - distinct).alias("duplicates"),
        distinct.alias("rows_out"),
    )


def tokens(df: DataFrame, col: str, sep: str = " ", name: str = "word") -> DataFrame:
    """One row per token of ``col``; empty tokens are kept."""
    return df.select(F.explode(F.split(col, re.escape(sep), -1)).alias(name))


def token_counts(df: DataFrame, col: str, sep: str = " ", name: str = "word") -> DataFrame:
    """How often each token occurs."""
    return tokens(df, col, sep, name).groupBy(name).agg(F.count(F.lit(1)).alias("count"))
