"""Tables in the folder that the driver and all executors share: what cuts lineage or is written on the way."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Only a session on one machine may do without that setting, as in tests; on a cluster
    a machine's own folder would scatter the tables, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/terralith-{name}-{uuid.uuid4().hex}"


#: Paths of what a thread wrote within ``scratch``.
_own = threading.local()
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables ``written`` inside are deleted at its end, and shuffle files of a query as soon as it is done: queries in a row need no more disk than one.

    What is to stay is written to a folder of its own.
    """
    before, outer = spark.conf.get(CLEANED, None), getattr(_own, "paths", None)
    _own.paths = []
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        for path in _own.paths:
            removed(spark, path)
        _own.paths = outer
        if before is None:
            spark.conf.unset(CLEANED)
        else:
            spark.conf.set(CLEANED, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: what follows starts from its files."""
    path = shared_folder(df.sparkSession, name)
    if getattr(_own, "paths", None) is not None:
        _own.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder, whatever store it lies in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
