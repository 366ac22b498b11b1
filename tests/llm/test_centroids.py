"""Centroid clustering: trees keep their promises, and rounds are those of a plain Lloyd."""

import hashlib

import numpy as np
import pytest
from oracle import assert_same

from millrace.llm import centroids, entry

DATA = "/root/testdata/sf0.001"


def plain(points, seeds, rounds):
    c = seeds.astype(object)
    far = lambda: ((points.astype(object)[:, None, :] - c[None]) ** 2).sum(-1)
    for _ in range(rounds):
        of = far().argmin(1)
        for k in range(len(c)):
            own = points[of == k].astype(object)
            if len(own):
                c[k] = [int(s) // len(own) for s in own.sum(0)]
    d = far()
    return d.argmin(1), d.min(1), c


def _clouds(rng, n, dims, spread):
    middle = rng.integers(-900, 900, (12, dims))
    return middle[rng.integers(0, 12, n)] + rng.integers(-spread, spread + 1, (n, dims))


@pytest.mark.parametrize("spread", [0, 3, 40, 2000])
def test_trees_are_cover_trees_and_their_walk_is_exact(spread):
    rng = np.random.default_rng(spread)
    points = _clouds(rng, 700, 8, spread)
    tree = centroids.Tree.of(points)
    assert sorted(tree.order.tolist()) == list(range(700)) and (points[tree.order] == tree.points).all()
    for i in range(len(tree.first)):
        own = tree.points[tree.first[i] : tree.last[i]]
        far = np.sqrt(((own - tree.points[tree.middle[i]]) ** 2).sum(1))
        assert far.max() <= tree.radius[i]
        below = range(tree.child[i], tree.child[i] + tree.children[i])
        if tree.children[i]:
            assert tree.first[below[0]] == tree.first[i] and tree.last[below[-1]] == tree.last[i]
            middles = tree.points[tree.middle[list(below)]]
            apart = np.sqrt(((middles[:, None] - middles[None]) ** 2).sum(-1))
            assert apart[~np.eye(len(middles), dtype=bool)].min() > max(tree.radius[c] for c in below) / (1 + 1e-8)
    middles = np.concatenate([points[:30], points[:5], rng.integers(-2000, 2000, (5, 8))])  # ties and far ones
    of, computed = centroids.assign(tree, centroids.Tree.of(middles, 1))
    assert (of == ((tree.points[:, None] - middles[None]) ** 2).sum(-1).argmin(1)).all()
    if 0 < spread <= 40:
        assert computed < 700 * 40 / 2


def test_large_components_are_compared_exactly():
    rng = np.random.default_rng(9)
    points = rng.integers(-(1 << 26), 1 << 26, (60, 64))
    far = centroids.distances(points, points[:7])
    assert far.dtype == np.int64 and (far == ((points.astype(object)[:, None] - points[None, :7].astype(object)) ** 2).sum(-1)).all()


def test_rounds_against_a_plain_lloyd(spark):
    rng = np.random.default_rng(4)
    points = np.concatenate([_clouds(rng, 1500, 6, 50), np.repeat(_clouds(rng, 1, 6, 50), 900, 0), rng.integers(-(1 << 24), 1 << 24, (3, 6))])
    seeds = np.concatenate([points[:11], points[:1], np.full((1, 6), 1 << 25)])  # one twice, one that gets nothing
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, vector array<long>")
    start = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(seeds)], "i int, vector array<long>").orderBy("i")
    got = {r["vec_id"]: r for r in centroids.cluster(rows.repartition(5), start, 4, 6).collect()}
    of, far, c = plain(points, seeds, 4)
    assert len(got) == len(points)
    for i, r in got.items():
        assert (r["cluster"], r["distance"]) == (of[i], far[i])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[of[i]])).encode()).hexdigest()
        assert r["cluster_inertia"] == far[of == of[i]].sum() and r["inertia"] == far.sum()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, -0.5], "x"), (1, [1.0, -0.5], "x"), (2, None, None), (3, [1.0], "x"), (4, [1.0, None], "x"), (5, [nan, 1.0], "x"), (6, [inf, 1.0], "x"), (7, [-inf, 0.0], "x"), (None, [0.0, 0.0], "x"), (8, [], "x"), (9, [-0.001, 3.0], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, vector string")
    kept = centroids.whole_vectors(table, 2, 256)
    assert sorted(((r["vec_id"], r["vector"]) for r in kept.collect()), key=repr) == sorted([(1, [256, -128]), (1, [256, -128]), (None, [0, 0]), (9, [-1, 768])], key=repr)
    out = centroids.cluster(kept, kept.orderBy("vec_id").limit(2), 3, 2)
    assert out.count() == 4
    assert centroids.cluster(kept.limit(0), kept.limit(0), 3, 2).collect() == []
    with pytest.raises(Exception, match="components must be below"):
        centroids.cluster(spark.createDataFrame([(1, [1 << 40, 0])], "vec_id long, vector array<long>"), kept.select("vector").limit(1), 1, 2).collect()


@pytest.mark.parametrize("data", [DATA, "/root/testdata/sf0.01"])
def test_sql_says_the_same(spark, data):
    assert_same(entry.op13_centroids(spark, data), data, entry.oracle_sql()["op13_centroids"])
