"""Tables that a job keeps in the folder all executors share, so that lineage ends at files that outlive any executor."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or (only where that is unset and all run in one process, as in tests) a new local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: The folder of the query that is being made, if it is made `alone`.
_HERE: ContextVar[str | None] = ContextVar("folder", default=None)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session's setting for what is run within."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def fresh(spark: SparkSession, name: str) -> str:
    """A folder that isn't there yet."""
    return f"{_HERE.get() or shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df written as Parquet (below folder) and read back: computed once, and its size is known to the planner."""
    path = f"{folder or _HERE.get() or shared_dir(df.sparkSession)}/millrace-table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Work:
    """A folder for the rounds of one job: `cut` writes into it, and it is gone at the end; what a job returns is cut elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/millrace-work-{uuid.uuid4().hex}"

    def __enter__(self) -> Work:
        return self

    def cut(self, df: DataFrame) -> DataFrame:
        return cut(df, self.folder)

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of make(), written; every table that it cut on its way is removed."""
    with Work(spark) as work:
        before = _HERE.set(work.folder)
        try:
            made = make()
        finally:
            _HERE.reset(before)
        return cut(made)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)
