"""Several sources' edges and warnings side by side, keyed by source_id: refresh, removal and listings.

Both relations have a source_id beside their own columns, so a file that two sources share belongs to each on its own. Stored
as tables partitioned by source_id, a refresh is an overwrite of one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def refresh(held: DataFrame, source_id: str, new: DataFrame) -> DataFrame:
    """held (edges or warnings) with source_id's rows replaced by new, which has no source_id."""
    return held.where(~F.col("source_id").eqNullSafe(source_id)).unionByName(new.withColumn("source_id", F.lit(source_id)))


def delete(held: DataFrame, source_id: str) -> DataFrame:
    """held without source_id's rows; an unknown one takes nothing away."""
    return held.where(~F.col("source_id").eqNullSafe(source_id))


def listing(registry: DataFrame, edges: DataFrame, warnings: DataFrame) -> DataFrame:
    """registry's source_id, name and kind (and nothing secret) with the numbers of files, edges and warnings."""
    of_edges = edges.groupBy("source_id").agg(F.count_distinct("source_file").alias("file_count"), F.count("*").alias("edge_count"))
    said = warnings.groupBy("source_id").agg(F.count("*").alias("warning_count"))
    out = registry.select("source_id", "name", "kind").join(of_edges, "source_id", "left").join(said, "source_id", "left")
    return out.fillna(0, ["file_count", "edge_count", "warning_count"])


def warnings_of(warnings: DataFrame) -> DataFrame:
    """All warnings, each with its source."""
    return warnings.select("source_id", "file", "error", "severity")
