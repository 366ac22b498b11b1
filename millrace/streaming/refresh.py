"""A stored graph that arriving extractions change in place, one source's partition at a time.

An extraction is a set of edge rows with source_id and generation; a source that has no edges any more arrives as one row whose
source_col is null. The newest generation of a source stands whole. Batches overwrite the partitions of their sources and no others, and
leave out generations older than what is stored, so a batch that is applied twice, or late, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.shared import Work

#: Rows of a part, about: a source's rows are dealt into as many parts as that takes, each sorted and written by one task, as one source
#: may hold a large share of all.
ROWS = 250_000


def _stored(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """All stored rows in like's columns; none before the first batch."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) or not any(s.isDirectory() for s in fs.listStatus(at)):
        return like.limit(0)
    # Read by like's schema, as a partition's name is no number, even if all are digits.
    return spark.read.schema(like.schema).parquet(folder).select(like.columns)


def read_graph(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """The stored edges, in the columns of like (a batch)."""
    return _stored(spark, folder, like).where("source_col is not null")


def apply(batch: DataFrame, folder: str) -> list[str]:
    """Put a batch's newest extractions into the table at folder; the sources whose partitions were replaced, in order."""
    spark = batch.sparkSession
    with Work(spark) as work:
        rows = work.cut(batch.where("source_id is not null and generation is not null"))
        newest = work.cut(rows.groupBy("source_id").agg(F.max("generation").alias("generation"), F.ceil(F.count("*") / ROWS).alias("parts")))
        # Of partitions of the batch's sources (others are pruned) one column is read.
        known = _stored(spark, folder, batch).join(newest.select("source_id"), "source_id", "left_semi").groupBy("source_id").agg(F.max("generation").alias("stored"))
        due = work.cut(newest.join(known, "source_id", "left").where("stored is null or generation >= stored").select("source_id", "generation", "parts"))
        sources = due.orderBy("source_id").collect()  # a row for each of the batch's sources
        fit = rows.join(due, ["source_id", "generation"]).withColumn("part", F.pmod(F.xxhash64("source_col", "target_col"), F.col("parts")))
        # Dealt by source and row, so that one source's rows are written by several tasks and few tasks write each source. The row that
        # says that a source has no edges stays, or an older generation could come back.
        dealt = fit.repartition(max(1, sum(r["parts"] for r in sources)), "source_id", "part").select(batch.columns)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(folder)
        return [r["source_id"] for r in sources]


def follow(spark: SparkSession, arrivals: str, schema, folder: str, checkpoint: str, files_at_once: int | None = None) -> None:
    """Apply all files that have arrived since the last call, as a stream with its own checkpoint; returns when none is left."""
    reader = spark.readStream.schema(schema)
    reader = reader if files_at_once is None else reader.option("maxFilesPerTrigger", files_at_once)
    stream = reader.parquet(arrivals).writeStream.foreachBatch(lambda batch, _: apply(batch, folder) and None)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
