"""Staged tables: cut lineage by writing Parquet to the cluster's shared folder.

A staged table survives the loss of any executor, because it is a committed
write to storage that every node can reach.  The folder is the one the cluster
names in ``spark.checkpoint.dir``; a folder of our own is used only where that
setting is absent (tests, local mode).
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Used only when the session names no checkpoint folder, in local mode.
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints/sparkslab"

_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this cluster, without a trailing slash."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor shares")
    return (folder or LOCAL_CHECKPOINT_DIR).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table called ``name``."""
    path = f"{shared_dir(spark)}/sparkslab/{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    return path


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables staged by this driver, but for the first ``since``; returns how many went.

    Call it once the results that read them have been written.
    """
    gone = 0
    while len(_staged) > since:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged inside when the block ends, also by an error."""
    since = len(_staged)
    try:
        yield
    finally:
        release(spark, since)
