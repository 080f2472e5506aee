"""Intermediate tables in the folder that all executors share.

Long lineages are cut by writing Parquet below ``spark.checkpoint.dir``, so a lost executor costs a reread and not a
recomputation. A folder of our own is used only where the session names none (local runs and tests).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders, and names of tables that are in the catalog, written since the innermost ``settled`` began.
_written: ContextVar[list[tuple[str, str | None]] | None] = ContextVar("written", default=None)


def _note(path: str, table: str | None = None) -> None:
    if (written := _written.get()) is not None:
        written.append((path, table))


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; sets a temporary one where it is unset, in local mode only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessaline-"))
    return sc.getCheckpointDir().rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/tessaline/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: computed once, lineage cut."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _note(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int, name: str = "step") -> DataFrame:
    """Like ``materialise``, as a table bucketed by ``key``, which grouped operators then read without a shuffle."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{own_dir(spark)}/{table}"
    _note(path, table)
    rows = df.repartition(buckets, key).write.bucketBy(buckets, key)
    rows.option("path", path).saveAsTable(table)
    return spark.table(table)


def settled(make: Callable[[], DataFrame], name: str = "step") -> DataFrame:
    """``materialise`` of what ``make`` returns; then the intermediate tables that ``make`` wrote are deleted, as nothing reads them any more.

    So ``make`` must not hand out a table in another way. If it fails, its tables stay until ``clear``.
    """
    token = _written.set([])
    try:
        df = make()
        written = _written.get()
    finally:
        _written.reset(token)
    out = materialise(df, name)
    for path, table in written:
        if table:
            out.sparkSession.sql(f"DROP TABLE IF EXISTS `{table}`")
        _delete(out.sparkSession, path)
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes the intermediate tables that this application has written, once no result needs them any more."""
    _delete(spark, own_dir(spark))
