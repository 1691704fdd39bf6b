"""Writing tables, small reports, models and run records, and checking what was written."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions.staging import stage, staged
from ledgerlight.sources.readers import read_table, require_scheme
from ledgerlight.sources.schemas import MANIFEST

LAYERS = ("bronze", "silver", "gold", "logs")


def layer_path(base: str, layer: str, dataset: str) -> str:
    """``<base>/<layer>/<dataset>`` for one of the four storage layers."""
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer!r}: use {', '.join(LAYERS)}")
    return f"{base.rstrip('/')}/{layer}/{dataset}"


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite a Parquet table, optionally partitioned by columns with few values."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


#: The text that stands for null in copies that must not lose anything.
NULL_MARK = "\\N"
_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_csv(df: DataFrame, path: str, null_mark: str = "") -> None:
    """Overwrite a CSV table; every task writes its own file, whatever the size.

    Blanks, quotes, line breaks and microseconds are kept. Empty text and null differ only if
    ``null_mark`` is not empty.
    """
    options = {"header": True, "escape": '"', "nullValue": null_mark, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**options, timestampFormat=_TIME + "XXX", timestampNTZFormat=_TIME).csv(path)


def write_report(df: DataFrame, path: str, single_file: bool = True) -> None:
    """Write a result as CSV: one file in the order of ``df``, or one per task.

    The result is computed once, in as many tasks as it needs, and stored; only the stored rows
    move to one task. ``coalesce(1)`` on the result itself would run its last steps there too.
    """
    if not single_file:
        write_csv(df, path)
        return
    with staged():
        stored = stage(df.withColumn("_row", F.monotonically_increasing_id()), "report")
        write_csv(stored.repartition(1).sortWithinPartitions("_row").drop("_row"), path)


def write_records(df: DataFrame, path: str) -> None:
    """Overwrite a few records, such as run metrics, as JSON."""
    df.write.mode("overwrite").json(path)


def write_manifest(health: DataFrame, path: str, run: str, model: str, deployment: str) -> None:
    """Write the health of a model (rmse, r2, status, action_required) as a manifest record."""
    record = health.select(
        F.lit(run).alias("pipeline_run"),
        F.lit(model).alias("model_type"),
        F.lit(deployment).alias("deployment_source"),
        F.struct(F.round("rmse", 4).alias("rmse"), F.round("r2", 4).alias("r2")).alias("metrics"),
        F.struct("status", "action_required").alias("monitoring"),
    )
    write_records(record.to(MANIFEST), path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(require_scheme(path))


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, checksum): equal for equal bags of rows, in any order and partitioning."""
    return df.agg(*_counts(df))


def _counts(df: DataFrame) -> list[Column]:
    """rows and checksum: equal for equal bags of rows, in any order and partitioning."""
    return [F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")).alias("checksum")]


def _compared(expected: DataFrame, written: DataFrame) -> DataFrame:
    sides = expected.withColumn("side", F.lit("expected")).unionByName(written.withColumn("side", F.lit("written")))
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return sides.agg(
        *[pick(side, c).alias(f"{side}_{c}") for c in ("rows", "checksum") for side in ("expected", "written")]
    ).withColumn(
        "matches",
        (F.col("expected_rows") == F.col("written_rows"))
        & F.col("expected_checksum").eqNullSafe(F.col("written_checksum")),
    )


def _read_back(df: DataFrame, path: str, fmt: str, **options) -> DataFrame:
    written = read_table(df.sparkSession, path, fmt, df.schema, **options)
    return fingerprint(written.select(*[F.col(f"`{c}`") for c in df.columns]))


def verify_write(df: DataFrame, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """One row: rows and checksum of ``df`` and of the table at ``path``, and whether they match.

    CSV is read back with the schema of ``df`` and the ``options`` of the CSV reader.
    """
    return _compared(fingerprint(df), _read_back(df, path, fmt, **options))


def write_observed(df: DataFrame, path: str, write: Callable[[DataFrame, str], None] = write_parquet, fmt: str = "parquet", **options) -> DataFrame:
    """Write ``df`` and compare what was written with what passed the writer: the row of :func:`verify_write`.

    Rows and checksum are counted while ``write(df, path)`` runs, so the source is read once, not
    again for the comparison. The table is read back with the ``options`` of the reader. ``write`` must
    consume ``df`` in exactly one action.
    """
    seen = Observation()
    write(df.observe(seen, *_counts(df)), path)
    found = seen.get
    expected = df.sparkSession.range(1).select(F.lit(found["rows"]).alias("rows"), F.lit(found["checksum"]).cast("decimal(38,0)").alias("checksum"))
    return _compared(expected, _read_back(df, path, fmt, **options))


def transfer(
    spark: SparkSession,
    src: str,
    src_fmt: str,
    dst: str,
    dst_fmt: str = "parquet",
    schema: T.StructType | None = None,
    multi_line: bool = False,
) -> int:
    """Copy a table between any two Hadoop file systems and formats; returns the rows written.

    The session stays open. Rows and checksum of source and copy are compared, and a difference is
    an error. CSV marks null as ``\\N``; texts with line breaks need ``multi_line``.
    """
    if dst_fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown format {dst_fmt!r}: use csv, parquet")
    csv = {"multi_line": multi_line, "null_mark": NULL_MARK}
    df = read_table(spark, src, src_fmt, schema, **(csv if src_fmt == "csv" else {}))
    write = write_parquet if dst_fmt == "parquet" else lambda table, path: write_csv(table, path, NULL_MARK)
    found = write_observed(df, dst, write, dst_fmt, **(csv if dst_fmt == "csv" else {})).first()
    if not found.matches:
        raise RuntimeError(f"{dst} has {found.written_rows} rows that differ from the {found.expected_rows} of {src}")
    return found.written_rows


@dataclass
class SinkLog:
    """Runs writes and records their outcome; an optional one that fails does not stop the run."""

    rows: list[tuple[str, bool, str, str | None]] = field(default_factory=list)

    def run(self, name: str, write: Callable[[], object], required: bool = True) -> bool:
        try:
            write()
        except Exception as error:
            self.rows.append((name, required, "failed", f"{type(error).__name__}: {error}"[:500]))
            if required:
                raise
            return False
        self.rows.append((name, required, "written", None))
        return True

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "sink string, required boolean, status string, error string")
