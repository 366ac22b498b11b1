"""Layers of a graph, and how sure what a column reaches is: rounds of equi-joins that go on from what has changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.shared import Work, cut, union

#: From the least to the most sure (fixed values); anything else is less sure than all.
CONFIDENCE = ("approximate", "certain")


def layers(edges: DataFrame) -> DataFrame:
    """node, layer, place, cyclic: the longest way from a node without predecessors, and the node's place in its layer by name.

    A node gets its layer when all of its predecessors have theirs. Where none is left that can, all that remain lie on a cycle or behind
    one; of these, the ones with a predecessor that has a layer (if none has, the first by name) get theirs as if the others were
    no predecessors, and are cyclic. An edge from a node to itself counts for nothing. There are as many rounds as layers.
    """
    pairs = edges.select("source_col", "target_col").where("source_col is not null and target_col is not null")
    with Work(edges.sparkSession) as work:
        steps = work.cut(pairs.where("source_col != target_col").distinct())
        ends = pairs.select(F.col("source_col").alias("node")).unionAll(pairs.select("target_col")).distinct()
        waits = ends.join(steps.groupBy(F.col("target_col").alias("node")).agg(F.count("*").alias("waits")), "node", "left")
        left = work.cut(waits.select("node", F.coalesce("waits", F.lit(0)).alias("waits"), F.lit(0).alias("met")))
        done, layer = [], 0
        while not left.isEmpty():
            free = left.where("waits = 0")
            cyclic = free.isEmpty()
            if cyclic:
                free = left.where("met > 0")
                free = left.orderBy("node").limit(1) if free.isEmpty() else free
            now = work.cut(free.select("node", F.lit(layer).alias("layer"), F.lit(cyclic).alias("cyclic")))
            done.append(now)
            fewer = steps.join(now.select(F.col("node").alias("source_col")), "source_col", "left_semi").groupBy(F.col("target_col").alias("node")).agg(F.count("*").alias("gone"))
            rest = left.join(now.select("node"), "node", "left_anti").join(fewer, "node", "left")
            left = work.cut(rest.select("node", (F.col("waits") - F.coalesce("gone", F.lit(0))).alias("waits"), (F.col("met") + F.coalesce("gone", F.lit(0))).alias("met")))
            layer += 1
        if not done:
            return edges.sparkSession.createDataFrame([], "node string, layer int, place int, cyclic boolean")
        return cut(_placed(union(done), work).select("node", "layer", "place", "cyclic"))


def _placed(rows: DataFrame, work: Work) -> DataFrame:
    """rows with `place`, a node's number by name within its layer. One layer may hold most nodes, so ranges of nodes are numbered apart, and
    moved on by what lies before them in their layer."""
    ranged = rows.repartitionByRange("layer", "node").sortWithinPartitions("layer", "node")
    # An id grows by one within a partition, whose number its upper bits hold.
    ranged = work.cut(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    sizes = work.cut(ranged.groupBy("layer", "part").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    earlier = Window.partitionBy("layer").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("layer", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return ranged.join(before, ["layer", "part"]).withColumn("place", (F.col("at") - F.col("first") + F.col("before") + 1).cast("int"))


def _level(confidence: Column) -> Column:
    out = F.lit(-1)
    for level, name in enumerate(CONFIDENCE):
        out = F.when(confidence == name, level).otherwise(out)
    return out


def confidence_of(edges: DataFrame, column: str, up: bool = False) -> DataFrame:
    """node, confidence, hops: of each column that `column` reaches (or, up, comes from) the best confidence of any path, which has
    that of its least sure edge, and the fewest edges of such a path.

    A column is gone through again when it is found on a surer path than before, so rounds grow with the longest such path.
    """
    start, end = ("target_col", "source_col") if up else ("source_col", "target_col")
    spark = edges.sparkSession
    with Work(spark) as work:
        steps = work.cut(edges.select(F.col(start).alias("at"), F.col(end).alias("node"), _level(F.col("confidence")).alias("sure")).groupBy("at", "node").agg(F.max("sure").alias("sure")))
        front = work.cut(spark.createDataFrame([(column, len(CONFIDENCE), 0)], "node string, level int, hops int"))
        best, hops = front, 0
        while not front.isEmpty():
            hops += 1
            found = steps.join(front.select(F.col("node").alias("at"), "level"), "at").groupBy("node").agg(F.max(F.least("level", "sure")).alias("level"))
            found = found.join(best.select("node", F.col("level").alias("before")), "node", "left").where("before is null or level > before")
            front = work.cut(found.select("node", "level", F.lit(hops).alias("hops")))
            both = best.unionAll(front).groupBy("node").agg(F.max(F.struct("level", (-F.col("hops")).alias("h"))).alias("b"))
            best = work.cut(both.select("node", F.col("b.level").alias("level"), (-F.col("b.h")).cast("int").alias("hops")))
        named = F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), F.greatest(F.col("level") + 1, F.lit(1)))
        return cut(best.where(F.col("node") != column).select("node", F.when(F.col("level") >= 0, named).otherwise("unknown").alias("confidence"), "hops"))
