"""Connected components of links held in a DataFrame, by alternating stars.

Each round moves every node's links to its smallest neighbour, first of the larger and then of the
smaller ones, until only stars are left. A round is a few aggregations and joins; rounds grow with the
logarithm of a component's size. Rounds are written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = both.join(least, "u").where("v > u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """links have u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _print(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node it can reach) of every node with a link to another; nulls and self links don't count."""
    spark = links.sparkSession
    links = links.where(f"{a} is not null and {b} is not null and {a} != {b}")
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    folder = storage.scratch(spark, "components")
    links = storage.save(links, f"{folder}/0")
    n, before = 0, None
    while (now := _print(links)) != before:
        before, n = now, n + 1
        links = storage.save(_small_star(_large_star(links)), f"{folder}/{n}")
        if n > 1:
            storage.remove(spark, f"{folder}/{n - 2}")
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
