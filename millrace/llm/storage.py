"""Tables and files that a job keeps in the folder all executors share, and the memory that its tasks keep."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


#: Rows of a batch that goes to a Python task, where the session doesn't say: texts of some KB make batches of some MB.
BATCH_ROWS = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Let batches have BATCH_ROWS rows, unless the session sets a number of its own."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, BATCH_ROWS)


def settle() -> None:
    """Give freed memory back to the system; workers live on after a task, and the driver's Python after a fit."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """task, which gives back memory at its end."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            settle()

    return run


def _hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder: spark.checkpoint.dir, or (only where that is unset, as in tests) a new local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", base)
    path, fs = _hadoop_path(spark, base)
    return path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()


def scratch(spark: SparkSession, name: str) -> str:
    """URI of a new, not yet existing folder below the shared one."""
    return f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"


def make_dir(spark: SparkSession, uri: str) -> str:
    path, fs = _hadoop_path(spark, uri)
    fs.mkdirs(path)
    return uri


def save(df: DataFrame, uri: str) -> DataFrame:
    """Write df as Parquet and read it back: lineage ends at files that outlive any executor."""
    df.write.mode("overwrite").parquet(uri)
    return df.sparkSession.read.parquet(uri)


def remove(spark: SparkSession, *uris: str) -> None:
    for uri in uris:
        path, fs = _hadoop_path(spark, uri)
        fs.delete(path, True)


def kept_alone(df: DataFrame, folder: str) -> DataFrame:
    """df written beside folder and read back, and folder, from which it was made, removed."""
    out = save(df, f"{folder}-out")
    remove(df.sparkSession, folder)
    return out


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it; file: with one slash, as Hadoop prints it, is taken too."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
