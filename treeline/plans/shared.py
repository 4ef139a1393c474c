"""Tables and folders that every executor can reach, used to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, with its file system's scheme; where that is unset, a temporary one in local mode (as in tests) and an error on a cluster."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="treeline-")
        spark.sparkContext.setCheckpointDir(configured)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(configured)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


#: The folder of the work at hand, if it has an owner.
_owned: ContextVar[str | None] = ContextVar("owned", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the owner's folder, or else in the application's, under the shared one."""
    folder = _owned.get() or f"{shared_dir(spark)}/treeline/{spark.sparkContext.applicationId}"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextmanager
def owned(spark: SparkSession) -> Iterator[str]:
    """Tables that are stored within go to a folder of their own, which is deleted at the end; results have to be written by then."""
    folder = scratch(spark, "owned")
    token = _owned.set(folder)
    try:
        yield folder
    finally:
        _owned.reset(token)
        drop(spark, folder)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a path through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Stored:
    """A DataFrame written once as Parquet in the shared folder; ``drop`` frees it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, scratch(df.sparkSession, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop(self.spark, self.path)


def store(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes a DataFrame to the shared folder and reads it again: lineage ends here."""
    return Stored(df, name).df


def file_heads(spark: SparkSession, path: str, size: int) -> list[tuple[str, bytes]]:
    """The files of a path, a folder or a pattern, with their first bytes, through Spark's file system layer."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for found in files.globStatus(top) or []:
        for status in files.listStatus(found.getPath()):
            if status.isFile() and not status.getPath().getName().startswith(("_", ".")):
                stream = files.open(status.getPath())
                out.append((status.getPath().toString(), bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))))
                stream.close()
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of tables that nothing refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hash_partitions(df: DataFrame, *columns: str) -> DataFrame:
    """Repartitions by columns into the session's number of shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
