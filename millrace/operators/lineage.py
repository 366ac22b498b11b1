"""Lineage questions as DataFrame operators over an edge relation.

An edge table has source_col, target_col (`table.column`), transform_type and source_file, and may have expression,
source_line, confidence and seq (of two edges between the same columns the later has the larger one). Nothing here
collects edges or nodes to the driver: closures advance a frontier by equi-joins, and each round is written to the
folder that all executors share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.shared import Work, alone, cut, union

#: Transforms from the most to the least telling (fixed values).
PRIORITY = {"window": 5, "cast": 4, "aggregation": 3, "expression": 2, "passthrough": 1}
#: Columns that stand for a table's predicates and join keys (fixed values).
FILTERS = {"__filter__": "where", "__having__": "having", "__qualify__": "qualify"}
JOIN_KEY = "__joinkey__"
#: The file that warnings about the whole graph are given (fixed value), and their texts.
GRAPH_FILE = "<graph>"
WARNING = "file string, error string, severity string"
#: Frontiers that are kept apart before they are put together.
ROUNDS = 12
#: Edges of one column that may come together in one task, and parts by which edges are counted to find columns with more.
CROWD, PARTS = 100_000, 32_768


def table_of(column_id: Column) -> Column:
    """What precedes the last dot; without a dot, the whole id."""
    before = F.char_length(column_id) - F.char_length(F.substring_index(column_id, ".", -1)) - 1
    return F.when(F.instr(column_id, ".") > 0, F.substring(column_id, F.lit(1), before)).otherwise(column_id)


def column_of(column_id: Column) -> Column:
    return F.when(F.instr(column_id, ".") > 0, F.substring_index(column_id, ".", -1)).otherwise(F.lit(""))


def is_synthetic(name: Column) -> Column:
    return name.startswith("__") & name.endswith("__")


def normalize_case(edges: DataFrame) -> DataFrame:
    return edges.withColumns({c: F.lower(c) for c in ("source_col", "target_col")})


def dedup_edges(edges: DataFrame, order: str = "seq") -> DataFrame:
    """One edge for each source and target: the last by `order`, further columns breaking ties.

    A struct with texts is aggregated by sorting, so edges are dealt first, to be sorted once, and sorted by a hash, as ids begin alike.
    """
    rest = sorted(c for c in edges.columns if c not in ("source_col", "target_col", order))
    dealt = edges.repartition("source_col", "target_col")
    last = dealt.groupBy(F.xxhash64("source_col", "target_col").alias("__hash"), "source_col", "target_col").agg(F.max(F.struct(order, *rest)).alias("last"))
    return last.select("source_col", "target_col", *[f"last.{c}" for c in edges.columns if c not in ("source_col", "target_col")])


def compose(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both graphs; where both have an edge, the new one's attributes stand."""
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
    return dedup_edges(both, "__age").drop("__age")


def remove_files(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of other files than those in files.source_file; nodes without an edge go with them."""
    return edges.join(files.select("source_file").distinct(), "source_file", "left_anti").select(edges.columns)


def reached(edges: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """node, depth, parent: `column` (depth 0) and all it reaches, going from edges' `start` to their `end`; of several parents the smallest.

    Edges are read in each round, so they should be written ones, or cheap to derive. Edges that stand more than once change nothing.
    Nodes of tables from which no edge starts are reached, but lead no round.
    """
    spark = edges.sparkSession
    with Work(spark) as work:
        going = work.cut(edges.select(table_of(F.col(start)).alias("table")).distinct())
        steps = edges.select(F.col(start).alias("parent"), F.col(end).alias("next"))
        rounds = [work.cut(spark.createDataFrame([(column, 0, None)], "node string, depth int, parent string"))]
        depth, front = 0, rounds[0]
        while True:
            depth += 1
            found = steps.join(front.select(F.col("node").alias("parent")), "parent")
            found = found.groupBy(F.col("next").alias("node")).agg(F.lit(depth).alias("depth"), F.min("parent").alias("parent"))
            new = work.cut(found.join(union(rounds).select("node"), "node", "left_anti"))
            # The newest stays apart.
            rounds = [*rounds, new] if len(rounds) < ROUNDS else [work.cut(union(rounds)), new]
            front = work.cut(new.join(going, table_of(F.col("node")) == F.col("table"), "left_semi"))
            if front.isEmpty():
                return cut(union(rounds))


def _edges_at(edges: DataFrame, column: str, start: str, end: str) -> DataFrame:
    return edges.join(reached(edges, column, start, end).select(F.col("node").alias(start)), start, "left_semi").select(edges.columns)


def upstream(edges: DataFrame, column: str) -> DataFrame:
    """Edges on paths into column; none for an unknown one. Cycles end where they were met."""
    return _edges_at(edges, column, "target_col", "source_col")


def downstream(edges: DataFrame, column: str) -> DataFrame:
    """Edges on paths out of column."""
    return _edges_at(edges, column, "source_col", "target_col")


def impact(edges: DataFrame, column: str) -> DataFrame:
    return downstream(edges, column).agg(F.count_distinct("target_col").alias("affected_count"))


def lineage(edges: DataFrame, column: str) -> DataFrame:
    """The edges up and down from column, with direction (`upstream` or `downstream`)."""
    up = upstream(edges, column).withColumn("direction", F.lit("upstream"))
    return up.unionAll(downstream(edges, column).withColumn("direction", F.lit("downstream")))


def payload(edges: DataFrame, column: str) -> DataFrame:
    """kind (`node` or `edge`), source and target: column, all nodes beside it on its edges up and down, and these edges."""
    both = cut(lineage(edges, column).select("source_col", "target_col"))
    ends = both.select(F.col("source_col").alias("source")).unionAll(both.select("target_col")).unionAll(edges.sparkSession.createDataFrame([(column,)], "source string"))
    nodes_ = ends.distinct().select(F.lit("node").alias("kind"), "source", F.lit(None).cast("string").alias("target"))
    return nodes_.unionAll(both.select(F.lit("edge"), "source_col", "target_col"))


def tree(edges: DataFrame, column: str, up: bool = True) -> DataFrame:
    """node, depth, parent of the tree of all that column comes from (or goes to), every node at its least depth."""
    return reached(edges, column, *(("target_col", "source_col") if up else ("source_col", "target_col")))


def nodes(edges: DataFrame) -> DataFrame:
    """node, is_source, is_target."""
    ends = edges.select(F.col("source_col").alias("node"), F.lit(1).alias("s"), F.lit(0).alias("t"))
    ends = ends.unionAll(edges.select("target_col", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg((F.max("s") == 1).alias("is_source"), (F.max("t") == 1).alias("is_target"))


def node_class(edges: DataFrame, target: str | None = None) -> DataFrame:
    """node and its class: target (the column asked for), pseudo (a synthetic column), source, sink or inner."""
    kind = F.when(~F.col("is_target"), "source").when(~F.col("is_source"), "sink").otherwise("inner")
    kind = F.when(F.col("node") == F.lit(target), "target").when(is_synthetic(column_of(F.col("node"))), "pseudo").otherwise(kind)
    return nodes(edges).select("node", kind.alias("node_class"))


def tables(edges: DataFrame) -> DataFrame:
    """table_name, column_count, role and whether the name is synthetic (`__x__`)."""
    each = nodes(edges).groupBy(table_of(F.col("node")).alias("table_name"))
    each = each.agg(F.count("*").alias("column_count"), F.max("is_source").alias("s"), F.max("is_target").alias("t"))
    role = F.when(F.col("table_name") == "result", "result").when(F.col("s") & F.col("t"), "intermediate").when(F.col("t"), "target").otherwise("source")
    return each.select("table_name", "column_count", role.alias("role"), is_synthetic(F.col("table_name")).alias("synthetic"))


def tables_by_role(edges: DataFrame, text: str = "") -> DataFrame:
    """role, how many tables have it, and their names in order; only names that contain text, whatever its case."""
    kept = tables(edges).where(F.contains(F.lower("table_name"), F.lit(text.lower())))
    return kept.groupBy("role").agg(F.count("*").alias("table_count"), F.array_join(F.array_sort(F.collect_list("table_name")), ",").alias("table_names"))


def search(edges: DataFrame, text: str) -> DataFrame:
    """Nodes with a dot that contain text, whatever its case."""
    return nodes(edges).where(F.contains("node", F.lit("."))).where(F.contains(F.lower("node"), F.lit(text.lower()))).select("node")


def table_edges(edges: DataFrame) -> DataFrame:
    """Edges between tables: how many column edges each stands for, and their transforms in order."""
    pair = edges.select(table_of(F.col("source_col")).alias("source_table"), table_of(F.col("target_col")).alias("target_table"), "transform_type")
    pair = pair.where("source_table != target_table").groupBy("source_table", "target_table")
    return pair.agg(F.count("*").alias("edge_count"), F.array_join(F.array_sort(F.collect_set("transform_type")), ",").alias("transforms"))


def file_kind(file: Column) -> Column:
    return F.when(F.lower(file).rlike(r"\.(py|ipynb)$"), "pyspark").otherwise("sql")


def file_stats(edges: DataFrame, warnings: DataFrame) -> DataFrame:
    """source_file, kind, edge_count, approximate_count, warning_count, error_count; files with warnings (file, severity) alone are there too."""
    of_edges = edges.groupBy("source_file").agg(F.count("*").alias("edge_count"), F.count_if(F.col("confidence") == "approximate").alias("approximate_count"))
    said = warnings.groupBy(F.col("file").alias("source_file")).agg(F.count("*").alias("warning_count"), F.count_if(F.col("severity") == "error").alias("error_count"))
    counts = ["edge_count", "approximate_count", "warning_count", "error_count"]
    both = of_edges.join(said, "source_file", "full").fillna(0, counts)
    return both.select("source_file", file_kind(F.col("source_file")).alias("kind"), *counts)


def error_files(warnings: DataFrame) -> DataFrame:
    return warnings.where("severity = 'error'").select(F.col("file").alias("source_file")).distinct()


def file_confidence(edges: DataFrame, warnings: DataFrame) -> DataFrame:
    """File statistics with confidence: low with an error, medium with a warning or an approximate edge, else high."""
    confidence = F.when(F.col("error_count") > 0, "low").when((F.col("approximate_count") > 0) | (F.col("warning_count") > 0), "medium").otherwise("high")
    return file_stats(edges, warnings).select("source_file", "edge_count", "approximate_count", "warning_count", confidence.alias("confidence"))


def severity_counts(warnings: DataFrame) -> DataFrame:
    """severity (an unknown one counts as warn), how many warnings have it, and whether it is the gravest there is."""
    severity = F.when(F.col("severity").isin("error", "warn", "info"), F.col("severity")).otherwise("warn")
    each = warnings.groupBy(severity.alias("severity")).agg(F.count("*").alias("warning_count"))
    grave = F.when(F.col("severity") == "error", 3).when(F.col("severity") == "warn", 2).otherwise(1)
    most = each.agg(F.max(grave).alias("__most"))
    return each.crossJoin(F.broadcast(most)).select("severity", "warning_count", (grave == F.col("__most")).alias("dominant"))  # three rows by one


def priority(transform: Column) -> Column:
    out = F.lit(0)
    for name, rank in PRIORITY.items():
        out = F.when(transform == name, rank).otherwise(out)
    return out


def best_predecessor(edges: DataFrame) -> DataFrame:
    """For each target the source with the most telling transform; the first (by seq, then name) among equals."""
    rank = F.struct((-priority(F.col("transform_type"))).alias("r"), "seq", F.col("source_col").alias("s"), F.col("transform_type").alias("t"))
    return edges.groupBy("target_col").agg(F.min(rank).alias("best")).select("target_col", F.col("best.s").alias("source_col"), F.col("best.t").alias("transform_type"))


def incoming_expressions(edges: DataFrame, column: str) -> DataFrame:
    """The distinct expressions (none that is null or `*`) with file and line by which column is made."""
    kept = edges.where((F.col("target_col") == column) & F.col("expression").isNotNull() & (F.col("expression") != "*"))
    return kept.select("expression", "source_file", "source_line").distinct()


def _table_from(source: Column) -> Column:
    """The table of a source; null without a dot."""
    return F.when(F.contains(source, F.lit(".")), table_of(source))


def _in_order(edges: DataFrame, value: Column, name: str, glue: str) -> DataFrame:
    """target_col and its edges' distinct values, joined in the order in which they came."""
    first = edges.select("target_col", "seq", "source_col", value.alias("v")).where("v is not null").groupBy("target_col", "v").agg(F.min(F.struct("seq", "source_col")).alias("at"))
    held = first.groupBy("target_col").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("held"))
    return held.select("target_col", F.array_join(F.transform("held", lambda x: x["v"]), glue).alias(name))


def _crowded(names: DataFrame) -> DataFrame:
    """Values of column_name in more than CROWD rows. Rows are counted by parts first, so that names move only of parts that may hold such a value."""
    part = F.pmod(F.xxhash64("column_name"), F.lit(PARTS))
    full = cut(names.groupBy(part.alias("part")).agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("part"))
    if full.isEmpty():
        return names.limit(0)
    there = names.withColumn("part", part).join(F.broadcast(full), "part", "left_semi")  # PARTS rows at most
    return there.groupBy("column_name").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("column_name")


def _columns_apart(into: DataFrame) -> DataFrame:
    """column_name, source_tables, expressions and first edge (f) of the targets of these edges; no target's edges come together in one task."""
    into = cut(dedup_edges(into))
    first = into.groupBy("target_col").agg(F.first("column_name").alias("column_name"), F.min(F.struct("seq", "source_col", "source_file", "source_line", "transform_type")).alias("f"))
    out = first.join(_in_order(into, _table_from(F.col("source_col")), "source_tables", ","), "target_col", "left")
    out = out.join(_in_order(into, F.when(F.col("expression") != "", F.col("expression")), "expressions", "\n"), "target_col", "left")
    return out.select("column_name", F.coalesce("source_tables", F.lit("")).alias("source_tables"), "expressions", "f")


def _columns_at_once(ends: DataFrame) -> DataFrame:
    """As `_columns_apart`, of column names and their edges (`edge`, from source_col and seq on; null for none), which move once and come together."""
    held = ends.repartition("column_name").groupBy(F.xxhash64("column_name").alias("__hash"), "column_name").agg(F.collect_list("edge").alias("e"))
    held = held.select("column_name", F.sort_array("e").alias("e"))
    # Of a source's edges the last one stands.
    held = held.select("column_name", F.filter("e", lambda x, i: ~F.get("e", i + 1)["source_col"].eqNullSafe(x["source_col"]) | (i + 1 == F.size("e"))).alias("e"))
    at = ("seq", "source_col", "source_file", "source_line", "transform_type", "expression")
    held = held.select("column_name", F.sort_array(F.transform("e", lambda x: F.struct(*[x[c].alias(c) for c in at]))).alias("e"))
    tables_ = F.array_distinct(F.transform("e", lambda x: _table_from(x["source_col"])))
    held = held.select("column_name", F.get("e", F.lit(0)).alias("f"), tables_.alias("t"), F.array_distinct(F.filter(F.col("e.expression"), lambda x: x != "")).alias("x"))
    return held.select(
        "column_name", F.array_join("t", ",").alias("source_tables"), F.when(F.size("x") > 0, F.array_join("x", "\n")).alias("expressions"),
        F.struct(*[f"f.{c}" for c in at[:-1]]).alias("f"),
    )


def list_columns(edges: DataFrame, table: str) -> DataFrame:
    """Every column of table: node_id, column_name, its source tables and expressions in order, and file, line and transform of its first edge.

    Of edges between the same columns the last counts, as in `dedup_edges`. A column's edges are moved once, to one task, unless there are more than CROWD of them.
    """
    name = {end: F.substring(F.col(end), F.lit(len(table) + 2), F.char_length(end)) for end in ("source_col", "target_col")}
    own = {end: F.startswith(F.col(end), F.lit(f"{table}.")) & ~F.contains(name[end], F.lit(".")) for end in name}
    into = edges.where(own["target_col"])
    rest = sorted(c for c in edges.columns if c not in ("source_col", "target_col", "seq"))
    ends = into.select(name["target_col"].alias("column_name"), F.struct("source_col", "seq", *rest).alias("edge"))
    ends = ends.unionByName(edges.where(own["source_col"]).select(name["source_col"].alias("column_name")).distinct(), allowMissingColumns=True)
    crowded = alone(edges.sparkSession, lambda: _crowded(into.select(name["target_col"].alias("column_name"))))
    if crowded.isEmpty():
        out = _columns_at_once(ends)
    else:
        apart = alone(edges.sparkSession, lambda: _columns_apart(into.withColumn("column_name", name["target_col"]).join(crowded, "column_name", "left_semi")))
        out = _columns_at_once(ends.join(crowded, "column_name", "left_anti")).unionAll(apart)
    return out.select(F.concat(F.lit(f"{table}."), "column_name").alias("node_id"), "column_name", "source_tables", "expressions", "f.source_file", "f.source_line", "f.transform_type")


def short_names(edges: DataFrame) -> DataFrame:
    """short, candidates, full: table names that are the end of others, how many, and the first of those; ids without a dot name no table.

    Only the longest forms are candidates: what is itself the end of a longer name stands for that one.
    """
    ends = edges.select(F.explode(F.array("source_col", "target_col")).alias("id")).where(F.contains("id", F.lit(".")))
    names = cut(ends.select(table_of(F.col("id")).alias("name")).distinct())
    longer = names.withColumn("dots", F.length("name") - F.length(F.replace("name", F.lit("."), F.lit("")))).where("dots > 0")
    longer = longer.select(F.col("name").alias("long"), F.explode(F.expr("transform(sequence(1, dots), i -> substring_index(name, '.', -i))")).alias("name"))
    met = cut(names.join(longer, "name").select(F.col("name").alias("short"), "long"))
    # What ends with a candidate of a short name is a candidate of it, too, so only names that end no other can count.
    whole = met.join(met.select(F.col("short").alias("long")).distinct(), "long", "left_anti")
    return whole.groupBy("short").agg(F.count("*").alias("candidates"), F.min("long").alias("full"))


def resolve_short_names(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Endpoints of a table that is the end of exactly one other table's name get that name; ambiguous ones stay."""
    # Written, so that Spark broadcasts the names where they are few, and edges stay where they are.
    known = cut((short_names(edges) if known is None else known).where("candidates = 1").select("short", "full"))
    out = edges
    for end in ("source_col", "target_col"):
        named = out.withColumn("short", F.when(F.contains(end, F.lit(".")), table_of(F.col(end)))).join(known, "short", "left")
        whole = F.when(F.col("full").isNotNull(), F.concat("full", F.lit("."), column_of(F.col(end)))).otherwise(F.col(end))
        out = named.withColumn(end, whole).select(edges.columns)
    return out


def ambiguity_warnings(known: DataFrame) -> DataFrame:
    """A warning for each of `short_names` with more than one candidate."""
    text = F.concat(F.lit("ambiguous table name '"), "short", F.lit("' matches multiple qualified tables — leaving as-is; qualify references to disambiguate"))
    return known.where("candidates > 1").select(F.lit(GRAPH_FILE).alias("file"), text.alias("error"), F.lit("warn").alias("severity"))


def _peeled(edges: DataFrame, work: Work) -> DataFrame:
    """Written edges without those that lead nowhere or come from nowhere, round by round.

    What leads nowhere goes first in each round, and what comes from nowhere is looked for in the rest.
    """
    left = edges
    n = left.count()
    while n:
        sources = left.select(F.col("source_col").alias("target_col")).distinct()
        rest = work.cut(left.join(sources, "target_col", "left_semi"))
        targets = rest.select(F.col("target_col").alias("source_col")).distinct()
        fewer = work.cut(rest.join(targets, "source_col", "left_semi").select(edges.columns))
        now = fewer.count()
        if now == n:
            break
        left, n = fewer, now
    return left if n else left.limit(0)


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges that are left when nodes without an incoming or outgoing edge are taken away until none is: empty if there is no cycle.

    The edges between tables are treated so first: an edge of the core lies between two tables whose edge is of theirs, so that the rest
    need not be moved. Edges that stand more than once do so in the core, too.
    """
    with Work(edges.sparkSession) as work:
        of_tables = {c: table_of(F.col(c)) for c in ("source_col", "target_col")}
        pairs = _peeled(work.cut(edges.select(*[table.alias(c) for c, table in of_tables.items()]).distinct()), work)
        pairs = work.cut(pairs.select(F.col("source_col").alias("__from"), F.col("target_col").alias("__to")))
        within = edges.join(pairs, (of_tables["source_col"] == F.col("__from")) & (of_tables["target_col"] == F.col("__to")), "left_semi")
        return cut(_peeled(work.cut(within), work))


def cycle_warning(edges: DataFrame) -> DataFrame:
    """One warning that names the nodes of one cycle in order, or no row.

    Of the cyclic core every node steps to its smallest predecessor; from the smallest node these steps end in a cycle.
    Steps are doubled by self-joins, so rounds grow with the logarithm of the core's nodes.
    """
    core = cyclic_core(edges.select("source_col", "target_col"))
    step = cut(core.groupBy(F.col("target_col").alias("node")).agg(F.min("source_col").alias("to")))
    n = step.count()
    if not n:
        return edges.sparkSession.createDataFrame([], WARNING)
    with Work(edges.sparkSession) as work:
        jump, length = step, 1
        held = step.agg(F.min("node").alias("node"))
        while length < n:
            jump = work.cut(jump.select("node", F.col("to").alias("mid")).join(jump.select(F.col("node").alias("mid"), "to"), "mid").select("node", "to"))
            length *= 2
        on_cycle = work.cut(held.join(jump, "node").select(F.col("to").alias("node")))
        jump, length = step, 1
        while length < n * 2:
            on_cycle = work.cut(on_cycle.unionAll(on_cycle.join(jump, "node").select("to")).distinct())
            jump = work.cut(jump.select("node", F.col("to").alias("mid")).join(jump.select(F.col("node").alias("mid"), "to"), "mid").select("node", "to"))
            length *= 2
        # Named by one row: a warning's text holds its whole cycle.
        names = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("'"), "node", F.lit("'")))), ", ")
        text = F.concat(F.lit("Circular lineage detected involving: ["), names, F.lit("]"))
        return cut(on_cycle.agg(F.lit(GRAPH_FILE).alias("file"), text.alias("error"), F.lit("warn").alias("severity")))


def built_edges(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Extracted edges in lower case and with whole names (known: their short_names in lower case), one between two columns."""
    return dedup_edges(resolve_short_names(normalize_case(edges), known))


def built_warnings(edges: DataFrame, warnings: DataFrame, known: DataFrame) -> DataFrame:
    """warnings (file, error, severity) and what is wrong with the graph of these edges; edges that stand more than once change nothing."""
    named = resolve_short_names(normalize_case(edges.select("source_col", "target_col")), known)
    return cut(warnings.select("file", "error", "severity").unionAll(ambiguity_warnings(known)).unionAll(cycle_warning(named)))


def build_graph(edges: DataFrame, warnings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, warnings, file statistics) of extracted edges: lower case, whole names, one edge between two columns, and what is wrong with the graph."""
    known = cut(short_names(normalize_case(edges)))
    graph = cut(built_edges(edges, known))
    said = built_warnings(graph, warnings, known)
    return graph, said, file_stats(graph, said)


def visible(edges: DataFrame, filters: bool = False, join_keys: bool = False) -> DataFrame:
    """Edges without those of predicates and join keys, unless asked for; an edge without a transform is visible."""
    hidden = [t for t, shown in (("filter", filters), ("join_key", join_keys)) if not shown]
    return edges.where(F.coalesce(~F.col("transform_type").isin(hidden), F.lit(True))) if hidden else edges


def export_json(edges: DataFrame, by_table: bool = False) -> DataFrame:
    """One JSON text (column `item`) for each node and each edge, of columns or of tables."""
    if by_table:
        pairs = table_edges(edges)
        ends = pairs.select(F.col("source_table").alias("id")).unionAll(pairs.select("target_table")).distinct()
        one = F.struct(F.col("source_table").alias("source"), F.col("target_table").alias("target"), "edge_count", "transforms")
    else:
        pairs, ends = edges, nodes(edges).select(F.col("node").alias("id"))
        one = F.struct(F.col("source_col").alias("source"), F.col("target_col").alias("target"), "transform_type", "source_file")
    return ends.select(F.to_json(F.struct("id")).alias("item")).unionAll(pairs.select(F.to_json(one)))


def numbered(df: DataFrame, within: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))
