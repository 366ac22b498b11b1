"""Files that are loaded into a table once each: COPY INTO, and the name by which a file source is known."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LEDGER = "path string, length long, modified timestamp, load string"


def source_name(path: Column) -> Column:
    """What a file source is called: its path with `_` for all but letters, digits and `_`, without `_` at its ends."""
    return F.regexp_replace(F.regexp_replace(path, "[^A-Za-z0-9_]", "_"), "^_+|_+$", "")


def read_files(spark: SparkSession, path: str, format: str, schema: StructType | str | None = None, **options: str) -> DataFrame:
    """The rows of all files at path, with the file's name and the source's."""
    reader = spark.read.format(format).options(**options)
    rows = (reader.schema(schema) if schema is not None else reader).load(path)
    return rows.withColumn("source_file", F.col("_metadata.file_name")).withColumn("source_name", source_name(F.lit(path.rstrip("/").rsplit("/", 1)[-1])))


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modified of each file at or below path; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ledger")
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(_LEDGER).parquet(f"{folder}/ledger") if there else spark.createDataFrame([], _LEDGER)


def copy_into(spark: SparkSession, folder: str, path: str, format: str, schema: StructType | str, **options: str) -> int:
    """Append the rows of those files at path that were not loaded yet; how many files these are.

    A file is known by its path, length and time, so a file that was written anew is loaded again. The rows of a load lie in a folder of
    their own, and count once the ledger names them: a load that broke off leaves nothing that is read, and is made again.
    """
    known = _ledger(spark, folder)
    new = _listing(spark, path).join(known, ["path", "length", "modified"], "left_anti").persist()
    try:
        names = [r["path"] for r in new.select("path").orderBy("path").collect()]  # as Spark's own list of the files it reads
        if names:
            load = uuid.uuid4().hex
            reader = spark.read.format(format).options(**options).schema(schema)
            rows = reader.load(names).withColumn("source_file", F.col("_metadata.file_name"))
            rows.write.parquet(f"{folder}/data/load={load}")
            new.withColumn("load", F.lit(load)).coalesce(1).write.mode("append").parquet(f"{folder}/ledger")
        return len(names)
    finally:
        new.unpersist()


def loaded(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """All rows that were copied in, each with source_file."""
    whole = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.read.schema(StructType(whole.fields).add("source_file", "string").add("load", "string")).option("basePath", f"{folder}/data").parquet(f"{folder}/data")
    counted = _ledger(spark, folder).select("load").distinct()
    return rows.join(counted, "load", "left_semi").drop("load")
