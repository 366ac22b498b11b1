"""Layers and confidence on small graphs."""

from test_paths import EDGE, edges_of

from millrace.operators import layers
from millrace.sources.shared import setting


def layers_of(edges):
    return {r["node"]: (r["layer"], r["place"], r["cyclic"]) for r in layers.layers(edges).collect()}


def graph(spark, *pairs):
    return edges_of(spark, *[(s, t, "cast", None) for s, t in pairs])


def test_a_layer_is_the_longest_way_from_a_root(spark):
    edges = graph(spark, ("a", "b"), ("b", "c"), ("a", "c"), ("a", "c"), ("x", "c"), ("c", "d"), ("x", "e"), ("self", "self"))
    assert layers_of(edges) == {"a": (0, 1, False), "self": (0, 2, False), "x": (0, 3, False), "b": (1, 1, False), "e": (1, 2, False), "c": (2, 1, False), "d": (3, 1, False)}
    assert layers_of(edges.limit(0)) == {}


def test_cycles_end(spark):
    behind_a_root = layers_of(graph(spark, ("r", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "z")))
    assert behind_a_root == {"r": (0, 1, False), "a": (1, 1, True), "b": (2, 1, False), "c": (3, 1, False), "z": (4, 1, False)}
    alone = layers_of(graph(spark, ("b", "a"), ("a", "b")))
    assert alone == {"a": (0, 1, True), "b": (1, 1, False)}
    two = layers_of(graph(spark, ("b", "a"), ("a", "b"), ("d", "c"), ("c", "d"), ("b", "c"), (None, "a")))
    assert two["a"] == (0, 1, True) and two["b"][0] == 1 and two["c"] == (2, 1, True) and two["d"][0] == 3


def sure(spark, column, *edges, up=False):
    rows = [(s, t, "cast", "f", None, 1, c, i) for i, (s, t, c) in enumerate(edges)]
    return {r["node"]: (r["confidence"], r["hops"]) for r in layers.confidence_of(spark.createDataFrame(rows, EDGE), column, up).collect()}


def test_the_best_path_counts(spark):
    """A short unsure way and a longer sure one; what lies behind is sure as well."""
    edges = [("a", "z", "approximate"), ("a", "b", "certain"), ("b", "c", "certain"), ("c", "z", "certain"), ("z", "end", "certain"), ("z", "a", "certain"), ("end", "odd", "guess"), ("odd", "last", "certain"), ("y", "z", "certain")]
    assert sure(spark, "a", *edges) == {"z": ("certain", 3), "b": ("certain", 1), "c": ("certain", 2), "end": ("certain", 4), "odd": ("unknown", 3), "last": ("unknown", 4)}
    assert sure(spark, "z", *edges, up=True)["a"] == ("certain", 3)
    assert sure(spark, "nobody", *edges) == {}


def test_a_path_is_as_sure_as_its_least_sure_edge(spark):
    edges = [("a", "b", "certain"), ("b", "c", "approximate"), ("c", "d", "certain"), ("a", "b", None), ("d", "d", "certain")]
    assert sure(spark, "a", *edges) == {"b": ("certain", 1), "c": ("approximate", 2), "d": ("approximate", 3)}


def test_a_layer_is_numbered_by_many_tasks(spark):
    """All nodes but one lie in one layer: places go on from one range of names to the next, and no window holds the layer."""
    edges = spark.range(20_000).selectExpr("'root' as source_col", "concat('n', id) as target_col")
    found = layers.layers(edges)
    rows = [(r["node"], r["layer"], r["place"]) for r in found.collect()]
    want = sorted(f"n{i}" for i in range(20_000))
    assert sorted(rows) == sorted([("root", 0, 1), *((n, 1, i) for i, n in enumerate(want, 1))])
    with layers.Work(spark) as work, setting(spark, "spark.sql.adaptive.enabled", "false"):
        placed = layers._placed(found.drop("place"), work)
        assert placed.select("part").distinct().count() > 4
