"""Reading tables, text lines, models and run records."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.sources.schemas import MANIFEST

CORRUPT = "_corrupt_record"


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    header: bool = True,
    keep_corrupt: bool = False,
    multi_line: bool = False,
    null_mark: str = "",
) -> DataFrame:
    """A CSV table. Without a schema types are inferred, at the price of one more pass.

    With a schema and a header the declared columns are found by their names, in any order and
    among others; a missing one is an error. Every field is read as text and cast, so a field that
    does not fit is null and its row known: ``keep_corrupt`` adds a ``_corrupt_record`` column with
    the text of such rows, and of rows with too many or too few fields. Without a header columns
    are taken by position. All files of a table share one header.

    ``multi_line`` reads records that contain line breaks; a file is then one task. ``null_mark``
    is the text that stands for null.
    """
    reader = spark.read.option("header", header).option("mode", "PERMISSIVE").option("escape", '"')
    reader = reader.option("multiLine", multi_line).option("nullValue", null_mark)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    if header:
        names = reader.csv(path).columns
        missing = [f.name for f in schema.fields if f.name not in names]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
    else:
        names = schema.names
    texts = T.StructType([T.StructField(n, T.StringType()) for n in (*names, CORRUPT)])
    rows = reader.option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", not header).schema(texts).csv(path)
    typed = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema.fields}
    chosen = [c.alias(n) for n, c in typed.items()]
    if not keep_corrupt:
        return rows.select(*chosen)
    unread = reduce(or_, [F.col(f"`{n}`").isNotNull() & c.isNull() for n, c in typed.items()])
    whole = F.to_csv(F.struct(*[F.col(f"`{n}`") for n in names]))
    return rows.select(*chosen, F.coalesce(CORRUPT, F.when(unread, whole)).alias(CORRUPT))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines as one ``value`` column; a header is an ordinary line."""
    return spark.read.text(path)


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a single text file, to pass as its header."""
    row = spark.read.text(path).first()
    return None if row is None else row["value"]


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


READERS = {"csv": read_csv, "parquet": read_parquet, "text": read_lines}


def read_table(spark: SparkSession, path: str, fmt: str, schema: T.StructType | None = None, **options) -> DataFrame:
    """Read ``path`` in one of the supported formats; any other name is an error.

    ``options`` are those of :func:`read_csv`.
    """
    if fmt not in READERS:
        raise ValueError(f"unknown format {fmt!r}: use {', '.join(sorted(READERS))}")
    if fmt == "csv":
        return read_csv(spark, path, schema, **options)
    return READERS[fmt](spark, path)


def frame_from_rows(spark: SparkSession, rows: Iterable, schema: T.StructType | str) -> DataFrame:
    """A frame from a few local rows, such as one form entry."""
    return spark.createDataFrame(list(rows), schema)


def require_scheme(path: str) -> str:
    """Reject a path without scheme: where it would end up depends on the cluster's default."""
    if ":" not in path.split("/", 1)[0]:
        raise ValueError(f"name the file system of {path!r}, for example file: or hdfs:")
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(require_scheme(path))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A run manifest with its nested fields as flat columns."""
    return spark.read.schema(MANIFEST).json(path).select(
        "pipeline_run", "model_type", "deployment_source", "metrics.*", "monitoring.*"
    )
