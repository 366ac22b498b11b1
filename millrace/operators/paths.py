"""Path enumeration and the steps by which a column is written, as rounds of equi-joins over edges.

A wildcard column `t.*` stands for every column of t: an edge into it is followed from any `t.c`, and an edge
`p.* -> t.*` then comes from `p.c`.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.lineage import FILTERS, JOIN_KEY, column_of, file_kind, is_synthetic, numbered, table_of
from millrace.sources.shared import Work, cut, union

#: Paths that are enumerated, steps of a trace, and views that a trace looks through, at most: limits that belong to the questions.
MAX_PATHS, MAX_STEPS, VIEW_DEPTH = 500, 50, 16

#: What a step of a path says about its edge.
_STEP = {"transform_type": "string", "expression": "string", "source_file": "string", "source_line": "int", "confidence": "string"}


def _wildcard(column_id: Column) -> Column:
    return F.concat(table_of(column_id), F.lit(".*"))


def _keys(column_id: Column) -> Column:
    """A column and the wildcard of its table: the targets by which edges into it are found."""
    return F.array_distinct(F.array(column_id, _wildcard(column_id)))


def _named(source: Column, key: Column, column_id: Column) -> Column:
    """The source of an edge found by `key`: a wildcard found by a wildcard takes the column's own name."""
    through = key.endswith(".*") & source.endswith(".*")
    return F.when(through, F.concat(table_of(source), F.lit("."), column_of(column_id))).otherwise(source)


def leading_to(edges: DataFrame, column: str) -> DataFrame:
    """The edges by which trace_paths can come to column; one that several columns are met by stands several times.

    Edges are read in each round, but for columns of tables that no edge leads into.
    """
    spark = edges.sparkSession
    with Work(spark) as work:
        made = work.cut(edges.select(table_of(F.col("target_col")).alias("table")).distinct())
        front = work.cut(spark.createDataFrame([(column,)], "node string"))
        seen, met = [front], [edges.limit(0)]
        while not front.isEmpty():
            asked = front.withColumn("__key", F.explode(_keys(F.col("node"))))
            found = work.cut(edges.join(asked, edges.target_col == F.col("__key")))
            met.append(found.select(edges.columns))
            new = found.select(_named(F.col("source_col"), F.col("__key"), F.col("node")).alias("node")).distinct()
            new = work.cut(new.join(union(seen), "node", "left_anti"))
            seen.append(new)
            front = work.cut(new.join(made, table_of(F.col("node")) == F.col("table"), "left_semi"))
        return cut(union(met))


def trace_paths(edges: DataFrame, column: str, max_paths: int = MAX_PATHS) -> DataFrame:
    """path (columns joined by ` > `, the oldest first), hops, transforms (joined by `,`, in order), steps, truncated.

    Simple paths into column that begin where no further column precedes. No more than max_paths, the first in the order of their
    columns read backwards; truncated says (on every row) that so many were found. Every path at hand leads to one result at
    least, so no round keeps more. steps has each edge's ends, transform, expression, file, line and confidence; of several edges
    between two columns (one of them by a wildcard) the first by transform counts.
    """
    spark = edges.sparkSession
    with Work(spark) as work:
        edge = F.struct(*[F.col(c).cast(t).alias(c) if c in edges.columns else F.lit(None).cast(t).alias(c) for c, t in _STEP.items()])
        into = edges.select(F.col("target_col").alias("key"), F.col("source_col").alias("source"), edge.alias("edge"))
        step = ", ".join(f"{c}: {t}" for c, t in {"source_col": "string", "target_col": "string", **_STEP}.items())
        at_hand = spark.createDataFrame([([column], [])], f"back array<string>, steps array<struct<{step}>>")  # from column backwards
        done: list[DataFrame] = []
        while not at_hand.isEmpty():
            head = F.element_at("back", -1)
            asked = at_hand.withColumn("key", F.explode(_keys(head)))
            longer = asked.join(into, "key").withColumn("source", _named(F.col("source"), F.col("key"), head))
            longer = longer.where(~F.array_contains("back", F.col("source")))
            longer = work.cut(longer.groupBy("back", "steps", "source").agg(F.min("edge").alias("edge")))
            done.append(work.cut(at_hand.join(longer.select("back").distinct(), "back", "left_anti").where(F.size("back") > 1)))
            one = F.struct(F.col("source").alias("source_col"), head.alias("target_col"), *[F.col(f"edge.{c}") for c in _STEP])
            longer = longer.select(F.concat("back", F.array("source")).alias("back"), F.concat(F.array(one), "steps").alias("steps"))
            at_hand = work.cut(longer.orderBy("back").limit(max_paths))
        found = union(done)
        n = found.count()
        return cut(found.orderBy("back").limit(max_paths).select(
            F.array_join(F.reverse("back"), " > ").alias("path"), (F.size("back") - 1).alias("hops"), F.array_join(F.transform("steps", lambda s: s["transform_type"]), ",", "").alias("transforms"), "steps", F.lit(n >= max_paths).alias("truncated"),
        ))


def path_steps(paths: DataFrame) -> DataFrame:
    """A row for each step of each path, numbered from the oldest: path, step, source_col, target_col and the edge's attributes."""
    return paths.select("path", F.posexplode("steps").alias("step", "s")).select("path", (F.col("step") + 1).alias("step"), "s.*")


def path_summary(paths: DataFrame) -> DataFrame:
    """path, origin (the first table, without its schema), via, dominant transform (the last that isn't passthrough, else the last) and hops."""
    ids, kinds = F.split("path", " > "), F.split("transforms", ",")
    short = lambda x: F.substring_index(table_of(x), ".", -1)
    tables = F.transform(F.slice(ids, 2, F.greatest(F.size(ids) - 2, F.lit(0))), short)
    telling = F.filter(kinds, lambda t: t != "passthrough")
    via = F.when(F.size(tables) == 0, "direct").otherwise(F.concat(F.lit("via "), F.array_join(tables, " → ")))
    dominant = F.when(F.size(telling) > 0, F.element_at(telling, -1)).otherwise(F.element_at(kinds, -1))
    return paths.select("path", short(F.element_at(ids, 1)).alias("origin"), via.alias("via"), dominant.alias("dominant"), "hops")


def path_groups(summaries: DataFrame, text: str = "") -> DataFrame:
    """path, origin, label (via, numbered where an origin has it more than once), and group_size, by which groups are shown."""
    low = text.lower()
    kept = summaries.where(F.contains(F.lower("origin"), F.lit(low)) | F.contains(F.lower("via"), F.lit(low)))
    sizes = kept.groupBy("origin").agg(F.count("*").alias("group_size"))
    repeats = kept.groupBy("origin", "via").agg(F.count("*").alias("__n"))
    each = numbered(kept, ["origin", "via"], ["path"], "__i").join(repeats, ["origin", "via"]).join(sizes, "origin")
    label = F.when(F.col("__n") > 1, F.concat("via", F.lit(" ("), F.col("__i").cast("string"), F.lit(")"))).otherwise(F.col("via"))
    return each.select("path", "origin", label.alias("label"), "group_size")


def _grouped(raw: DataFrame, sinks: list[str]) -> DataFrame:
    """owner (a table), stmt_id, kind, predicate: the predicates or join keys of tables, their columns in the order in which they came."""
    name = column_of(F.col("target_col"))
    kind = F.when(name == JOIN_KEY, "join")
    for sink, word in FILTERS.items():
        kind = F.when(name == sink, word).otherwise(kind)
    own = raw.where(name.isin(sinks)).select(table_of(F.col("target_col")).alias("owner"), "stmt_id", kind.alias("kind"), F.coalesce("expression", F.lit("")).alias("e"), F.col("source_line").alias("line"), "source_col", "seq")
    own = own.groupBy("owner", "stmt_id", "kind", "e", "line", "source_col").agg(F.min("seq").alias("seq"))
    held = own.groupBy("owner", "stmt_id", "kind", "e", "line").agg(F.array_sort(F.collect_list(F.struct("seq", "source_col"))).alias("c"))
    columns = F.array_join(F.transform("c", lambda x: x["source_col"]), ",")
    return held.select("owner", "stmt_id", "kind", F.concat_ws(" ", F.concat("kind", F.lit(":")), F.nullif("e", F.lit("")), F.concat(F.lit("["), columns, F.lit("]"))).alias("predicate"))


def lineage_trace(resolved: DataFrame, raw: DataFrame, column: str, max_steps: int = MAX_STEPS) -> DataFrame:
    """The steps that write column, one for each source table, file and cell: how, under which predicates and joins, and through which temporary views.

    Where raw has stmt_id, a step has the predicates and joins of its own statements alone; without it, all of its target table's. Cells
    are those of source_cell, if there is such a column. A temporary view is a table that raw edges write and the resolved graph doesn't have; its predicates and joins count with
    the step's. Lists are joined by `; ` (views by `,`) in a fixed order. Steps are those first by file and line.
    """
    table = table_of(F.lit(column))
    with Work(raw.sparkSession) as work:
        missing = {c: F.lit(None).cast("int") if c == "source_cell" else F.lit(0) for c in ("source_cell", "stmt_id") if c not in raw.columns}
        raw = raw.withColumns(missing) if missing else raw
        writers = raw.where((F.col("target_col") == column) & F.contains("source_col", F.lit(".")))
        writers = work.cut(writers.withColumn("source_table", table_of(F.col("source_col"))))
        there = resolved.where((F.col("source_col") == column) | (F.col("target_col") == column)).limit(1).count()
        writers = writers if there else writers.limit(0)
        named = resolved.select(table_of(F.col("source_col")).alias("t")).unionAll(resolved.select(table_of(F.col("target_col")))).distinct()
        views = raw.select(table_of(F.col("target_col")).alias("t")).distinct().join(named, "t", "left_anti")
        views = work.cut(views)
        synthetic = [*FILTERS, JOIN_KEY]
        feeds = raw.where(~column_of(F.col("target_col")).isin(synthetic) & F.contains("source_col", F.lit("."))).select(table_of(F.col("target_col")).alias("t"), table_of(F.col("source_col")).alias("next")).distinct()
        feeds = work.cut(feeds.join(views, "t", "left_semi"))
        frontier = work.cut(writers.select(F.col("source_table").alias("start"), F.col("source_table").alias("t")).distinct().join(views, "t", "left_semi"))
        seen = [frontier]
        for _ in range(VIEW_DEPTH - 1):
            if frontier.isEmpty():
                break
            further = frontier.join(feeds, "t").select("start", F.col("next").alias("t")).distinct().join(views, "t", "left_semi")
            frontier = work.cut(further.select("start", "t").join(union([s.select("start", "t") for s in seen]), ["start", "t"], "left_anti"))
            seen.append(frontier)
        via = union([s.select("start", "t") for s in seen])
        step = ["source_table", "source_file", "source_cell"]
        real = ~is_synthetic(column_of(F.col("source_col"))) & (F.col("source_col") != column)
        write = F.concat_ws(" ", "transform_type", "expression")
        steps = writers.groupBy(*step).agg(
            F.min("source_line").alias("source_line"), F.array_join(F.array_sort(F.collect_set(write)), "; ").alias("writes"),
            F.array_join(F.array_sort(F.collect_set(F.when(real, F.col("source_col")))), ",").alias("upstream_columns"),
        )
        # Predicates of the step's own statements, and all of the views it reads.
        said = work.cut(_grouped(raw, synthetic))
        own = writers.select(*step, table.alias("owner"), "stmt_id").distinct().withColumnRenamed("stmt_id", "s").join(said, "owner").where(F.col("s").eqNullSafe(F.col("stmt_id")))
        of_views = writers.select(*step).distinct().join(via.select(F.col("start").alias("source_table"), F.col("t").alias("owner")), "source_table").join(said, "owner")
        named = ["kind", "predicate"]
        said = own.select(*step, *named).unionAll(of_views.select(*step, *named)).distinct().groupBy(*step).agg(
            F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") != "join", F.col("predicate")))), "; ").alias("filters"),
            F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == "join", F.col("predicate")))), "; ").alias("joins"),
        )
        said = said.select([F.col(c).alias(f"said_{c}") for c in step] + ["filters", "joins"])
        through = via.groupBy(F.col("start").alias("source_table")).agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("via_temp_views"))
        out = steps.join(said, reduce(and_, [F.col(c).eqNullSafe(F.col(f"said_{c}")) for c in step]), "left").join(through, "source_table", "left").fillna("", ["filters", "joins", "via_temp_views"])
        out = out.orderBy("source_file", F.coalesce("source_line", F.lit(0)), "source_table", "source_cell").limit(max_steps)
        return cut(out.select(file_kind(F.col("source_file")).alias("kind"), *step, "source_line", table.alias("target_table"), "writes", "filters", "joins", "via_temp_views", "upstream_columns"))
