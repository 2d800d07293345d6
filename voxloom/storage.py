"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of sessions that are deleted when their JVM ends.
_MARKED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the directory set on the context.

    Only a local session without either gets a temporary folder of this machine;
    on a cluster a missing setting is an error, as executors could not share it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    on_context = spark.sparkContext.getCheckpointDir()
    if on_context:
        return on_context.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="voxloom-")
    atexit.register(shutil.rmtree, path, True)
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def session_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/voxloom-{spark.sparkContext.applicationId}"
    if path not in _MARKED:
        files, at = _files(spark, path)
        files.mkdirs(at)
        files.deleteOnExit(at)
        _MARKED.add(path)
    return path


def place(spark: SparkSession, label: str) -> str:
    """A new path in the session's folder."""
    return f"{session_dir(spark)}/{label}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results not yet read or written are lost."""
    path = session_dir(spark)
    remove(spark, path)
    _MARKED.discard(path)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    The result has no lineage beyond its files, so a lost executor costs no
    recomputation, and later reads prune columns and rows. The table stays until it is
    discarded, the session's tables are released, or the application ends.
    """
    spark = df.sparkSession
    path = place(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`cut` that no unfinished result reads any more."""
    for table in tables:
        remove(table.sparkSession, table._cut_at)
