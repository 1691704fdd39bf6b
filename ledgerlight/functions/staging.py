"""Writing an intermediate table to shared storage.

A cleaned table is read several times: by each pass of the quantile search, by the final filter
and by every report. Without a written copy each read would repeat the deduplication shuffle,
and a lost executor would repeat all of it. A Parquet copy in the folder named by
``spark.checkpoint.dir`` survives executor loss, is read column by column, and takes pushed-down
filters, which a cached or checkpointed row set does not.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_LOCAL: list[str] = []
_STAGED: list[tuple[SparkSession, str]] = []
_TABLES: dict[str, str] = {}


def staging_folder(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="ledgerlight-"))
    return _LOCAL[0]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and return the table read back.

    The copy stays until :func:`release`, because the result is read later.
    """
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/ledgerlight/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append((spark, path))
    stored = spark.read.schema(df.schema).parquet(path)
    stored._staged_path = path
    return stored


def stage_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` in ``buckets`` buckets, sorted by ``key``, and return the table read back.

    Tables with equal buckets of their join keys are joined and grouped by key without a shuffle, as
    often as they are read. The rows meet their bucket before the write, so there is one file per bucket.
    """
    spark = df.sparkSession
    table = f"ledgerlight_{name}_{uuid.uuid4().hex}"
    path = f"{staging_folder(spark)}/ledgerlight/{table}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    _STAGED.append((spark, path))
    _TABLES[path] = table
    return spark.table(table)


def staged_paths() -> list[str]:
    """Folders of all copies that have not been released."""
    return [path for _, path in _STAGED]


def release(since: int = 0) -> None:
    """Delete the copies made after the first ``since`` ones; frames that read them become unreadable."""
    while len(_STAGED) > since:
        spark, path = _STAGED.pop()
        if path in _TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(path)}")
        _delete(spark, path)


def discard(stored: DataFrame) -> None:
    """Delete one copy made by :func:`stage` that nothing reads any more."""
    entry = (stored.sparkSession, stored._staged_path)
    if entry in _STAGED:
        _STAGED.remove(entry)
        _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


@contextmanager
def staged():
    """Delete on leaving what was staged inside."""
    since = len(_STAGED)
    try:
        yield
    finally:
        release(since)
