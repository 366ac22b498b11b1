"""Lineage operators: against SQL on the order tables, and on small graphs by hand."""

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

import __spark_entry__
from millrace.operators import lineage

DATA = "/root/testdata/sf0.01"
OWN = sorted(name for name in __spark_entry__.oracle_sql() if not name.startswith("op"))
EDGE = "source_col string, target_col string, transform_type string, source_file string"


@pytest.mark.parametrize("name", OWN)
def test_sql_says_the_same(spark, name):
    assert assert_same(__spark_entry__.queries()[name](spark, DATA), DATA, __spark_entry__.oracle_sql()[name]) > 0


def test_nested_forms_of_a_name_are_one_table(spark):
    """`orders`, `s.orders` and `c.s.orders` are one; two longest forms are ambiguous."""
    edges = spark.createDataFrame([("orders.id", "x.id", "cast", "1"), ("s.orders.id", "y.id", "cast", "1"), ("c.s.orders.id", "z.id", "cast", "1"), ("t.id", "s.t.id", "cast", "1"), ("c.s.t.id", "d.t.id", "cast", "1")], EDGE)
    rows = {(r["source_col"], r["target_col"]) for r in lineage.resolve_short_names(edges).collect()}
    assert rows == {("c.s.orders.id", "x.id"), ("c.s.orders.id", "y.id"), ("c.s.orders.id", "z.id"), ("t.id", "c.s.t.id"), ("c.s.t.id", "d.t.id")}
    (warning,) = lineage.ambiguity_warnings(lineage.short_names(edges)).collect()
    assert "'t'" in warning["error"]


def test_cycles_end_and_unknown_columns_have_nothing(spark):
    edges = spark.createDataFrame([("a.x", "b.x", "cast", "1"), ("b.x", "a.x", "window", "1"), ("b.x", "c.x", "cast", "1")], EDGE)
    assert lineage.downstream(edges, "a.x").count() == 3
    assert lineage.upstream(edges, "c.x").count() == 3
    assert lineage.upstream(edges, "z.z").count() == 0
    assert lineage.downstream(edges.limit(0), "a.x").count() == 0


def test_newer_edges_stand(spark):
    old = spark.createDataFrame([("a.x", "b.x", "window", "1"), ("a.y", "b.y", "cast", "1")], EDGE)
    new = spark.createDataFrame([("a.x", "b.x", "cast", "2")], EDGE)
    rows = {(r["source_col"], r["transform_type"], r["source_file"]) for r in lineage.compose(old, new).collect()}
    assert rows == {("a.x", "cast", "2"), ("a.y", "cast", "1")}


def test_what_is_left_of_a_cycle(spark):
    edges = spark.createDataFrame([("a.x", "b.x", "cast", "1"), ("b.x", "c.x", "cast", "1"), ("c.x", "b.x", "cast", "1"), ("c.x", "d.x", "cast", "1"), ("e.x", "e.x", "cast", "2")], EDGE)
    assert {(r["source_col"], r["target_col"]) for r in lineage.cyclic_core(edges).collect()} == {("b.x", "c.x"), ("c.x", "b.x"), ("e.x", "e.x")}
    assert lineage.cyclic_core(edges.where("source_col = 'a.x' or target_col = 'd.x'")).count() == 0
    assert lineage.cyclic_core(edges.limit(0)).count() == 0


def test_short_names_with_one_longer_name_get_it(spark):
    edges = spark.createDataFrame([("uc.prod.orders.id", "x.id", "cast", "1"), ("orders.id", "y.id", "cast", "1"), ("staging.t.id", "prod.t.id", "cast", "1"), ("t.id", "nodot", "cast", "1"), (None, "y.id", "cast", "1")], EDGE)
    rows = {(r["source_col"], r["target_col"]) for r in lineage.resolve_short_names(edges).collect()}
    assert rows == {("uc.prod.orders.id", "x.id"), ("uc.prod.orders.id", "y.id"), ("staging.t.id", "prod.t.id"), ("t.id", "nodot"), (None, "y.id")}


def test_parts_of_names(spark):
    names = ["a.b.c", "a.", ".x", "nodot", "", None, "a\n.b", "é.ü.x", "..", "t.*"]
    rows = spark.createDataFrame([(n,) for n in names], "id string").select(lineage.table_of(lineage.F.col("id")), lineage.column_of(lineage.F.col("id"))).collect()
    assert [tuple(r) for r in rows] == [("a.b", "c"), ("a", ""), ("", "x"), ("nodot", ""), ("", ""), (None, ""), ("a\n", "b"), ("é.ü", "x"), (".", ""), ("t", "*")]


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_edges_are_sorted_once_after_they_are_dealt(spark):
    plan = _plan(lineage.dedup_edges(spark.createDataFrame([("a.x", "b.x", "cast", "1", 1)], EDGE + ", seq int")))
    assert "SortAggregate" in plan and "SortAggregate" not in plan[plan.index("Exchange") :]


@pytest.mark.parametrize("name", ["g07_file_stats", "g08_error_files", "g13_impact", "g23_file_confidence", "g34_warnings", "g47_severity_counts"])
def test_edges_that_are_read_several_times_are_made_once(spark, name):
    assert "SortAggregate" not in _plan(__spark_entry__.queries()[name](spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("name", ["g14_lineage", "g15_payload"])
def test_closures_move_no_attributes(spark, monkeypatch, name):
    """Up and down from a column only the ends of edges are read, of all edges as they come."""
    monkeypatch.setattr(lineage, "dedup_edges", lambda edges, order="seq": edges.select(F.raise_error(F.lit("sorted"))))
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize("name", ["g18_source_columns", "g19_list_columns"])
def test_columns_of_a_table_move_their_edges_once(spark, name):
    """Dealt by column, and nothing more but what only feeds other columns; no edges are written or taken once before."""
    plan = _plan(__spark_entry__.queries()[name](spark, "/root/testdata/sf0.001"))
    assert plan.count("Exchange hashpartitioning(column_name") == plan.count("Exchange ") == 2 and "millrace-table" not in plan


@pytest.mark.parametrize("crowd", [0, 2, 4, 100_000])
def test_columns_of_a_table_however_many_edges_come_together(spark, monkeypatch, crowd):
    """Of edges between the same columns the last counts; sources without a dot are no tables; empty and null expressions are none."""
    monkeypatch.setattr(lineage, "CROWD", crowd, raising=False)
    monkeypatch.setattr(lineage, "PARTS", 2, raising=False)
    rows = [("b.x", "s.t.x", "cast", "late", 5), ("a.x", "s.t.x", "window", "e", 1), ("b.x", "s.t.x", "cast", "early", 0), ("nodot", "s.t.x", "cast", "e", 2), (None, "s.t.x", "cast", "", 3), ("b.y", "s.t.x", "cast", None, 5)]
    rows += [("z.x", "s.t.y", "cast", None, 1), ("a.x", "s.t.y", "window", "", 1), ("s.t.y", "s.t.", "cast", "*", 1), ("s.t.only", "a.x", "cast", "o", 1), ("s.t.x", "s.t.x", "cast", "self", 9)]
    rows += [("a.x", "t.x", "cast", "other", 1), ("s.t.deep.x", "s.t", "cast", "other", 1), ("a.x", None, "cast", "other", 1)]
    edges = spark.createDataFrame([(s, t, kind, "f", e, n, "certain", n) for s, t, kind, e, n in rows], EDGE + ", expression string, source_line int, confidence string, seq long")
    found = {tuple(r) for r in lineage.list_columns(edges, "s.t").collect()}
    assert found == {
        ("s.t.x", "x", "a,b,s.t", "e\nlate\nself", "f", 1, "window"), ("s.t.y", "y", "a,z", None, "f", 1, "window"),
        ("s.t.", "", "s.t", "*", "f", 1, "cast"), ("s.t.only", "only", "", None, None, None, None),
    }
    assert lineage.list_columns(edges, "none").count() == 0 and lineage.list_columns(edges.limit(0), "s.t").count() == 0
