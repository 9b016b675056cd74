"""Cuts of lineage for loops whose plans would grow, and files that last as long as the application."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Paths to delete when an application ends, and folders made for local ones.
_PATHS: dict[str, list[str]] = {}
_ROOTS: dict[str, str] = {}


def delete(context: SparkContext, path: str) -> None:
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def gone_at_stop(spark: SparkSession, path: str) -> None:
    """Delete the path as the context stops, or at the interpreter's exit where nobody stops it."""
    context = spark.sparkContext
    app = context.applicationId
    if app not in _PATHS:
        _PATHS[app], stop = [], context.stop

        def drop() -> None:
            for known in _PATHS.pop(app, []):
                if context._jsc is not None:
                    delete(context, known)

        def stopped() -> None:
            try:
                drop()
            finally:
                stop()

        context.stop = stopped
        atexit.register(drop)
    if path not in _PATHS[app]:
        _PATHS[app].append(path)


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may leave that unset and gets a temporary folder."""
    folder, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if folder:
        return folder.rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _ROOTS:
        _ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="posetrail-")
        gone_at_stop(spark, _ROOTS[context.applicationId])
    return _ROOTS[context.applicationId]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for files that last as long as the application."""
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    gone_at_stop(spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the application's folder below spark.checkpoint.dir."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root(df.sparkSession))
    gone_at_stop(df.sparkSession, context.getCheckpointDir())
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet in the application's folder: worked out once, where a checkpoint works out its last stage twice, and read by column."""
    path = scratch(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
