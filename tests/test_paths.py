"""Paths, views, traces, cycles and sources on small graphs by hand."""

from millrace.operators import lineage, paths, registry
from millrace.sources import foreign_keys

EDGE = "source_col string, target_col string, transform_type string, source_file string, expression string, source_line int, confidence string, seq long"


def edges_of(spark, *rows):
    """(source, target, transform, expression) with numbers in order."""
    full = [(s, t, kind, "f.sql", e, i, "certain", i) for i, (s, t, kind, e) in enumerate(rows)]
    return spark.createDataFrame(full, EDGE)


def test_paths_end_in_cycles_and_follow_wildcards(spark):
    edges = edges_of(spark, ("a.x", "b.x", "cast", None), ("b.x", "c.x", "expression", "e"), ("c.x", "b.x", "cast", None), ("raw.*", "a.*", "passthrough", None), ("k.one", "a.*", "window", None))
    found = {r["path"]: (r["hops"], r["transforms"], r["truncated"]) for r in paths.trace_paths(edges, "c.x").collect()}
    assert found == {"raw.x > a.x > b.x > c.x": (3, "passthrough,cast,expression", False), "k.one > a.x > b.x > c.x": (3, "window,cast,expression", False)}
    assert paths.trace_paths(edges, "raw.x").count() == 0 and paths.trace_paths(edges.limit(0), "c.x").count() == 0
    both = paths.trace_paths(edges, "c.x", 2).collect()
    assert len(both) == 2 and all(r["truncated"] for r in both)
    groups = {r["path"]: (r["origin"], r["label"]) for r in paths.path_groups(paths.path_summary(paths.trace_paths(edges, "c.x")), "RAW").collect()}
    assert groups == {"raw.x > a.x > b.x > c.x": ("raw", "via a → b")}


def test_a_trace_of_an_unknown_or_unwritten_column_is_empty(spark):
    edges = edges_of(spark, ("a.x", "b.x", "cast", "c"), ("a.y", "b.__filter__", "filter", "y > 1"), ("a.z", "b.__filter__", "filter", "y > 1"))
    edges = edges.withColumn("source_line", lineage.F.lit(4))
    assert paths.lineage_trace(edges, edges, "z.z").count() == 0 and paths.lineage_trace(edges, edges, "a.x").count() == 0
    (step,) = paths.lineage_trace(edges, edges, "b.x").collect()
    assert (step["writes"], step["filters"], step["joins"], step["via_temp_views"], step["upstream_columns"]) == ("cast c", "where: y > 1 [a.y,a.z]", "", "", "a.x")


def test_two_writers_of_a_table_keep_their_predicates_apart(spark):
    """By statement, and by cell: two cells that write from one table are two steps."""
    rows = [("a.x", "t.x", "cast", "c", 1, 1, 10), ("b.x", "t.x", "cast", "d", 2, 2, 20), ("a.x", "t.x", "cast", "e", 3, 3, 30), ("a.k", "t.__filter__", "filter", "k > 1", 1, 1, 10), ("b.k", "t.__filter__", "filter", "k > 2", 2, 2, 20), ("v.k", "v.__filter__", "filter", "v", 9, 9, 90), ("v.x", "t.x", "cast", "f", 4, 4, 40)]
    raw = spark.createDataFrame([(s, t, kind, "f.py", e, line, "certain", i, stmt, cell) for i, (s, t, kind, e, stmt, cell, line) in enumerate(rows)], EDGE + ", stmt_id int, source_cell int")
    raw = raw.unionByName(raw.where("source_col = 'a.x' and stmt_id = 1").withColumns({"source_col": lineage.F.lit("s.y"), "target_col": lineage.F.lit("v.x"), "stmt_id": lineage.F.lit(9)}))
    resolved = raw.where("not startswith(source_col, 'v.') and not startswith(target_col, 'v.')")
    steps = {(r["source_table"], r["source_cell"]): (r["writes"], r["filters"], r["via_temp_views"]) for r in paths.lineage_trace(resolved, raw, "t.x").collect()}
    assert steps == {("a", 1): ("cast c", "where: k > 1 [a.k]", ""), ("b", 2): ("cast d", "where: k > 2 [b.k]", ""), ("a", 3): ("cast e", "", ""), ("v", 4): ("cast f", "where: v [v.k]", "v")}
    unscoped = paths.lineage_trace(resolved, raw.drop("stmt_id"), "t.x").collect()
    assert {r["filters"] for r in unscoped if r["source_table"] != "v"} == {"where: k > 1 [a.k]; where: k > 2 [b.k]"}


def test_steps_of_a_path_say_what_their_edges_say(spark):
    edges = edges_of(spark, ("raw.*", "a.*", "passthrough", None), ("a.x", "b.x", "cast", "c"))
    steps = [(r["step"], r["source_col"], r["target_col"], r["expression"], r["source_line"], r["confidence"]) for r in paths.path_steps(paths.trace_paths(edges, "b.x")).orderBy("step").collect()]
    assert steps == [(1, "raw.x", "a.x", None, 0, "certain"), (2, "a.x", "b.x", "c", 1, "certain")]


def test_one_cycle_is_named(spark):
    edges = edges_of(spark, *[(f"t.{i}", f"t.{i + 1}", "cast", None) for i in range(9)], ("t.7", "t.3", "cast", None), ("s.x", "s.x", "cast", None))
    assert [r["error"] for r in lineage.cycle_warning(edges.where("source_col != 's.x'")).collect()] == ["Circular lineage detected involving: ['t.3', 't.4', 't.5', 't.6', 't.7']"]
    assert [r["error"] for r in lineage.cycle_warning(edges.where("source_col = 's.x'")).collect()] == ["Circular lineage detected involving: ['s.x']"]
    assert lineage.cycle_warning(edges.limit(0)).count() == 0


def test_the_last_edge_stands_and_the_first_predecessor_comes_first(spark):
    edges = edges_of(spark, ("b.x", "t.x", "cast", "late"), ("a.x", "t.x", "cast", "early"), ("b.x", "t.x", "window", "*"))
    kept = lineage.dedup_edges(edges)
    assert {(r["source_col"], r["transform_type"], r["seq"]) for r in kept.collect()} == {("b.x", "window", 2), ("a.x", "cast", 1)}
    (row,) = lineage.list_columns(kept, "t").collect()
    assert (row["source_tables"], row["expressions"], row["transform_type"]) == ("a,b", "early\n*", "cast")
    assert lineage.list_columns(kept, "none").count() == 0
    assert [r["expression"] for r in lineage.incoming_expressions(kept, "t.x").collect()] == ["early"]
    tree = {(r["node"], r["depth"], r["parent"]) for r in lineage.tree(kept, "t.x").collect()}
    assert tree == {("t.x", 0, None), ("a.x", 1, "t.x"), ("b.x", 1, "t.x")}


def test_an_unknown_source_takes_nothing_away(spark):
    held = edges_of(spark, ("a.x", "b.x", "cast", None)).withColumn("source_id", lineage.F.lit("s1"))
    assert registry.delete(held, "s2").count() == 1 and registry.delete(held, "s1").count() == 0
    again = registry.refresh(held, "s1", held.drop("source_id").limit(0))
    assert again.count() == 0 and again.columns == held.columns
    assert held.columns[:-1] == foreign_keys.COLUMNS


def test_severities_and_nulls(spark):
    said = spark.createDataFrame([("f", "e", "info"), ("f", "e", None)], lineage.WARNING)
    assert {tuple(r) for r in lineage.severity_counts(said).collect()} == {("info", 1, False), ("warn", 1, True)}
    assert lineage.severity_counts(said.limit(0)).count() == 0
    edges = edges_of(spark, ("a.x", "b.x", None, None), ("a.x", "c.x", "filter", None))
    assert [r["target_col"] for r in lineage.visible(edges).collect()] == ["b.x"] and lineage.visible(edges, filters=True, join_keys=True).count() == 2


def test_edges_that_lead_to_a_column(spark):
    edges = spark.createDataFrame([("raw.*", "mid.*"), ("mid.x", "out.x"), ("mid.y", "out.y"), ("out.x", "far.x"), ("out.x", "mid.x")], "source_col string, target_col string")
    rows = {tuple(r) for r in paths.leading_to(edges, "out.x").collect()}
    assert rows == {("raw.*", "mid.*"), ("mid.x", "out.x"), ("out.x", "mid.x")}
