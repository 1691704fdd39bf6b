"""Intermediate tables in the shared folder, and their removal.

Tables are Parquet files below ``spark.checkpoint.dir``. An operator that has consumed a table
drops it at once; tables that a returned DataFrame still reads stay until :func:`release`.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.functions.staging import staging_folder

_KEPT: dict[str, list[str]] = defaultdict(list)
_TABLES: dict[str, list[str]] = defaultdict(list)


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder name in shared storage, remembered for :func:`release`."""
    path = f"{staging_folder(spark)}/ledgerlight-llm/{name}-{uuid.uuid4().hex}"
    _KEPT[spark.sparkContext.applicationId].append(path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the stored table, whose lineage is the files alone."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._scratch_path = path
    return stored


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
    paths = _KEPT[spark.sparkContext.applicationId]
    if path in paths:
        paths.remove(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables of :func:`keep` that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table._scratch_path)


def remember_table(spark: SparkSession, name: str) -> None:
    """Let :func:`release` drop a named table of this session."""
    _TABLES[spark.sparkContext.applicationId].append(name)


def release(spark: SparkSession) -> None:
    """Delete every table this session has kept; results that read them become unreadable."""
    for name in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in list(_KEPT[spark.sparkContext.applicationId]):
        remove(spark, path)
