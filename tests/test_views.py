"""View inlining by its rules, each on a small graph by hand."""

import pytest
from test_paths import EDGE, edges_of

from millrace.operators import views


def inlined(edges, names):
    rows = [(r["source_col"], r["target_col"], r["transform_type"], r["expression"]) for r in views.inline_views(edges, names).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def pairs(edges, names):
    return {r[:2] for r in inlined(edges, names)}


def test_chains_end_outside_of_views_whatever_the_case(spark):
    edges = edges_of(
        spark, ("Src.id", "V1.id", "window", "w"), ("v1.id", "v2.id", "passthrough", None), ("v2.id", "out.id", "cast", "c"), ("v2.ID", "out.n", "passthrough", None), ("v2.id", "v3.x", "cast", "dropped"), ("A.x", "b.x", "filter", "f"),
    )
    assert inlined(edges, ["v1", "V2", "v3"]) == {("src.id", "out.id", "window", "w"), ("src.id", "out.n", "window", "w"), ("A.x", "b.x", "filter", "f")}


def test_all_columns_of_a_view(spark):
    """`v.* -> t.*` takes the sources of all of v's columns, and stands for an edge of each named one."""
    edges = edges_of(spark, ("src.id", "v.id", "cast", "c"), ("src.a", "v.n", "passthrough", None), ("src.b", "v.n", "passthrough", None), ("v.*", "t.*", "passthrough", None))
    want = {("src.id", "t.id", "cast", "c"), ("src.a", "t.n", "passthrough", None), ("src.b", "t.n", "passthrough", None), ("src.id", "t.*", "cast", "c"), ("src.a", "t.*", "passthrough", None), ("src.b", "t.*", "passthrough", None)}
    assert inlined(edges, ["v"]) == want
    named = edges_of(spark, ("src.id", "v.id", "cast", "c"), ("v.*", "t.whole", "passthrough", None))
    assert inlined(named, ["v"]) == {("src.id", "t.whole", "cast", "c")}


def test_all_columns_through_two_views(spark):
    edges = edges_of(spark, ("src.id", "v1.id", "window", "w"), ("v1.*", "v2.*", "passthrough", None), ("v2.*", "t.*", "passthrough", None))
    assert inlined(edges, ["v1", "v2"]) == {("src.id", "t.*", "window", "w")}
    assert pairs(edges_of(spark, ("src.*", "v1.*", "cast", "c"), ("v1.*", "v2.*", "passthrough", None), ("v2.n", "t.n", "passthrough", None)), ["v1", "v2"]) == {("src.n", "t.n")}


def test_a_named_source_of_a_wildcard_counts_for_its_own_name(spark):
    edges = edges_of(spark, ("src.b", "v.*", "cast", None), ("p.*", "v.*", "passthrough", None), ("v.a", "t.a", "passthrough", None), ("v.B", "t.b", "passthrough", None))
    assert pairs(edges, ["v"]) == {("p.a", "t.a"), ("p.b", "t.b"), ("src.b", "t.b")}
    alone = edges_of(spark, ("src.b", "v.*", "cast", None), ("v.a", "t.a", "passthrough", None))
    assert pairs(alone, ["v"]) == {("v.a", "t.a")}


def test_the_wildcard_is_a_fallback_only(spark):
    edges = edges_of(spark, ("src.id", "v.id", "cast", None), ("other.*", "v.*", "passthrough", None), ("v.id", "t.id", "passthrough", None), ("v.n", "t.n", "passthrough", None), ("v.*", "u.all", "passthrough", None))
    assert pairs(edges, ["v"]) == {("src.id", "t.id"), ("other.n", "t.n"), ("other.*", "u.all")}


def test_what_has_no_source_stays(spark):
    """A column nobody writes, here or further up, and views that feed themselves alone."""
    edges = edges_of(
        spark, ("v.gone", "t.x", "cast", "c"), ("v.gone2", "w.y", "window", "w"), ("w.y", "t.y", "passthrough", None), ("loop.x", "loop.x", "cast", None), ("loop.x", "out.loop", "cast", None),
        ("a.x", "b.x", "cast", None), ("b.x", "a.x", "cast", None), ("src.k", "b.x", "window", "far"), ("a.x", "t.a", "passthrough", None),
    )
    assert inlined(edges, ["v", "w", "loop", "a", "b"]) == {("v.gone", "t.x", "cast", "c"), ("v.gone2", "t.y", "window", "w"), ("loop.x", "out.loop", "cast", None), ("src.k", "t.a", "window", "far")}


def test_one_edge_with_the_best_of_two_chains(spark):
    edges = edges_of(spark, ("src.a", "v.x", "cast", "c"), ("src.a", "w.x", "window", "w"), ("v.x", "u.x", "passthrough", None), ("w.x", "u.x", "passthrough", None), ("u.x", "t.x", "passthrough", None))
    assert inlined(edges, ["u", "v", "w"]) == {("src.a", "t.x", "window", "w")}


def test_a_longer_chain_that_tells_more(spark):
    edges = edges_of(spark, ("src.a", "v.x", "passthrough", None), ("v.x", "u.x", "passthrough", None), ("v.x", "w.x", "window", "w"), ("w.x", "u.x", "passthrough", None), ("u.x", "t.x", "passthrough", None))
    assert inlined(edges, ["u", "v", "w"]) == {("src.a", "t.x", "window", "w")}


def test_the_deepest_of_equals_and_the_consumers_own(spark):
    edges = edges_of(spark, ("src.a", "v.x", "expression", "deep"), ("v.x", "u.x", "expression", "near"), ("u.x", "t.x", "passthrough", "own"), ("u.x", "t.y", "expression", "own"), ("u.x", "t.z", "filter", "own"))
    assert inlined(edges, ["u", "v"]) == {("src.a", "t.x", "expression", "deep"), ("src.a", "t.y", "expression", "own"), ("src.a", "t.z", "expression", "deep")}


def test_consumers_keep_their_file_line_and_confidence(spark):
    rows = [("src.a", "v.x", "cast", "made.sql", "c", 3, "approximate", 1), ("v.x", "t.x", "passthrough", "used.sql", None, 9, "certain", 2)]
    (row,) = views.inline_views(spark.createDataFrame(rows, EDGE), ["v"]).collect()
    assert tuple(row) == ("src.a", "t.x", "cast", "used.sql", "c", 9, "certain", 2)


def test_one_name_in_two_files(spark):
    rows = [(s, t, "passthrough", f, None, 1, "certain", i) for i, (s, t, f) in enumerate([
        ("a.id", "v.id", "one"), ("v.id", "t.one", "one"), ("b.id", "v.id", "two"), ("v.id", "t.two", "two"), ("c.id", "v.id", "three"), ("v.id", "t.three", "three"), ("v.id", "t.none", None),
    ])]
    known = spark.createDataFrame([("one", "V"), ("two", "v"), ("two", "v"), ("four", "v"), (None, "v"), ("one", None)], "source_file string, view string")
    assert pairs(spark.createDataFrame(rows, EDGE), known) == {("a.id", "t.one"), ("b.id", "t.two"), ("c.id", "v.id"), ("v.id", "t.three"), ("v.id", "t.none")}


@pytest.mark.parametrize("names", [[], ["v"]])
def test_nothing_to_do(spark, names):
    edges = edges_of(spark, ("a.x", "b.x", "cast", None), ("nodot", "b.y", "cast", None), ("v", "b.z", "cast", None))
    assert pairs(edges, names) == {("a.x", "b.x"), ("nodot", "b.y"), ("v", "b.z")}
    assert pairs(edges.limit(0), names) == set()
