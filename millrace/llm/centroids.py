"""Lloyd's rounds by two trees: a cover tree over each block of vectors and one over the centroids of a round.

Vectors stay where they are read: each task puts up to BLOCK of them into a cover tree, and writes them in the tree's order. A
node is a ball: its middle is one of its vectors, its children's middles are further apart than half its radius rounded up to a
power of two, and every vector lies within that distance of its child's middle. In each round the trees are walked together:
of a node of vectors and the nodes of centroids that may hold its nearest ones, those go whose least possible distance is
above the largest possible distance to the nearest; the wider of both is opened. Where one centroid is left, all of the
node's vectors are its; leaves are compared exactly. A level whose balls would hold fewer than GATHERED vectors each is not
made, its vectors are one leaf: where vectors lie alike far apart (as random ones in many dimensions do) trees spare little.

A round's sums are whole numbers, added up in tasks and then by Spark; what reaches the driver are centroids x components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

#: Vectors of one tree, and of a leaf that is not divided further.
BLOCK, LEAF = 1024, 16
GATHERED = 3
#: Components are below this, so that squared distances fit into a long; and below the other, so that a double holds them.
LARGEST, EXACT = 1 << 27, 1 << 21
#: Bounds are widened by this share, as they are computed in doubles.
SLACK = 1e-9
_TREE = "ids array<long>, points binary, first array<int>, last array<int>, middle array<int>, radius array<double>, child array<int>, children array<int>"


def distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances as whole numbers (in doubles where these hold them exactly)."""
    if max(np.abs(points).max(initial=0), np.abs(others).max(initial=0)) < EXACT:
        a, b = points.astype(float), others.astype(float)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    return np.stack([((points - other) ** 2).sum(1) for other in others], 1)


@dataclass
class Tree:
    """Nodes breadth first: node i has the points first[i] to last[i] - 1 and the children child[i] to child[i] + children[i] - 1."""

    points: np.ndarray
    first: np.ndarray
    last: np.ndarray
    middle: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    children: np.ndarray
    order: np.ndarray | None = None  # of the points that were given

    @classmethod
    def of(cls, points: np.ndarray, leaf: int = LEAF, gathered: int = GATHERED) -> Tree:
        order, nodes, queue = np.arange(len(points)), [], []

        def node(first: int, last: int) -> None:
            """The middle stands first."""
            far = distances(points[order[first:last]], points[order[first : first + 1]])[:, 0]
            queue.append((len(nodes), far))
            nodes.append([first, last, first, float(np.sqrt(far.max())) * (1 + SLACK), 0, 0])

        if len(points):
            node(0, len(points))
        for i, far in queue:  # grows on the way
            first, last = nodes[i][:2]
            if last - first <= leaf or not far.any():
                continue
            width = 2.0 ** np.floor(np.log2(np.sqrt(far.max())))
            balls = _net(points[order[first:last]], far, width, (last - first) // gathered)
            while balls is not None and len(balls) == 1:
                width /= 2
                balls = _net(points[order[first:last]], far, width, (last - first) // gathered)
            if balls is None:
                continue
            order[first:last] = order[first:last][np.concatenate(balls)]
            nodes[i][4:] = len(nodes), len(balls)
            for ball in balls:
                node(first, first + len(ball))
                first += len(ball)
        held = list(zip(*nodes)) or [()] * 6
        whole = [np.array(x, np.int64) for x in (held[0], held[1], held[2], held[4], held[5])]
        return cls(points[order], whole[0], whole[1], whole[2], np.array(held[3], float), whole[3], whole[4], order)


def _net(points: np.ndarray, far: np.ndarray, width: float, most: int) -> list[np.ndarray] | None:
    """Balls of this width whose middles (their first points) are further apart than it; None if there are more than `most`."""
    left, balls = np.arange(len(points)), []
    while len(left):
        if len(balls) >= most:
            return None
        near = (far if not balls else distances(points[left], points[left[:1]])[:, 0]) <= width * width
        balls.append(left[near])
        left = left[~near]
    return balls


def assign(vectors: Tree, centroids: Tree) -> tuple[np.ndarray, int]:
    """The number of each vector's nearest centroid (as centroids.order numbers them; the smallest of equals), and how many distances were computed."""
    out, computed = np.zeros(len(vectors.points), np.int64), 0
    middles, number = centroids.points[centroids.middle], centroids.order
    stack = [(0, np.zeros(1, np.int64))] if len(vectors.first) and len(centroids.first) else []
    while stack:
        i, open_ = stack.pop()
        first, last, radius = vectors.first[i], vectors.last[i], vectors.radius[i]
        at = vectors.points[vectors.middle[i] : vectors.middle[i] + 1]
        while True:
            far = np.sqrt(distances(at, middles[open_])[0].astype(float))
            computed += len(open_)
            nearest = (far.min() + radius) * (1 + SLACK)
            open_ = open_[far * (1 - SLACK) - radius - centroids.radius[open_] <= nearest]
            wide = (centroids.children[open_] > 0) & (centroids.radius[open_] >= radius)
            if not wide.any():
                break
            below = [np.arange(c, c + n) for c, n in zip(centroids.child[open_[wide]], centroids.children[open_[wide]])]
            open_ = np.concatenate([open_[~wide], *below])
        if vectors.children[i] and len(open_) * vectors.children[i]:
            alone = len(open_) == 1 and centroids.last[open_[0]] - centroids.first[open_[0]] == 1
            if not alone:
                stack += [(c, open_) for c in range(vectors.child[i], vectors.child[i] + vectors.children[i])]
                continue
        held = np.sort(number[np.concatenate([np.arange(centroids.first[c], centroids.last[c]) for c in open_])])
        if len(held) == 1:
            out[first:last] = held[0]
            continue
        back = np.argsort(number, kind="stable")
        some = vectors.points[first : first + 1] if radius == 0 else vectors.points[first:last]
        out[first:last] = held[distances(some, centroids.points[back[held]]).argmin(1)]
        computed += len(some) * len(held)
    return out, computed


def _batches(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, vectors) of BLOCK rows or fewer."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            take = min(BLOCK - sum(b.num_rows for b in held), batch.num_rows)
            held.append(batch.slice(0, take))
            batch = batch.slice(take)
            if sum(b.num_rows for b in held) == BLOCK:
                yield _joined(held, dims)
                held = []
    if held:
        yield _joined(held, dims)


def _joined(held: list[pa.RecordBatch], dims: int) -> tuple[pa.Array, np.ndarray]:
    table = pa.Table.from_batches(held).combine_chunks()
    points = table.column(1).chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return table.column(0).chunk(0), points


def trees(vectors: DataFrame, dims: int, folder: str) -> DataFrame:
    """The cover trees of vectors (an id and an array of dims longs), written to folder: one row for each block."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points in _batches(batches, dims):
            if np.abs(points).max(initial=0) >= LARGEST:
                raise ValueError(f"components must be below {LARGEST}, or squared distances don't fit into a long")
            tree = Tree.of(points)
            row = {"ids": [ids.take(pa.array(tree.order)).to_pylist()], "points": [tree.points.astype("<i4").tobytes()]}
            row |= {name: [getattr(tree, name).tolist()] for name in ("first", "last", "middle", "radius", "child", "children")}
            yield pa.RecordBatch.from_pydict(row, _schema(_TREE))

    return storage.save(vectors.mapInArrow(storage.tidy(task), _TREE), folder)


def _schema(text: str) -> pa.Schema:
    kinds = {"array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split(" ") for field in text.split(", "))])


def _read(batch: pa.RecordBatch, i: int, dims: int) -> Tree:
    row = batch.slice(i, 1)
    points = np.frombuffer(row.column(1)[0].as_py(), "<i4").astype(np.int64).reshape(-1, dims)
    part = [row.column(k).flatten().to_numpy(zero_copy_only=False) for k in range(2, 8)]
    return Tree(points, *part)


def _sums(blocks: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """How many vectors each centroid has, and their sums."""
    k, dims = centroids.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree.of(centroids, 1)
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                block = _read(batch, i, dims)
                of, _ = assign(block, tree)
                order = np.argsort(of, kind="stable")
                there, first = np.unique(of[order], return_index=True)
                n[there] += np.diff(np.append(first, len(of)))
                total[there] += np.add.reduceat(block.points[order], first, 0)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"centroid": there, "n": n[there], "sums": total[there].tolist()}, _schema("centroid int, n long, sums array<long>"))

    parts = blocks.mapInArrow(storage.tidy(task), "centroid int, n long, sums array<long>")
    each = parts.select("centroid", "n", F.posexplode("sums").alias("at", "value")).groupBy("centroid", "at").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    n, total = np.zeros(k, np.int64), [[0] * dims for _ in range(k)]
    for row in each.collect():  # centroids x components rows at most
        n[row["centroid"]], total[row["centroid"]][row["at"]] = row["n"], int(row["value"])
    return n, total


def lloyd(blocks: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after some rounds: each the floor of its vectors' mean, component by component; one without vectors stays."""
    for _ in range(rounds if len(centroids) else 0):
        n, total = _sums(blocks, centroids)
        centroids = np.array([[s // int(m) for s in sums] if m else old.tolist() for m, sums, old in zip(n, total, centroids)], np.int64).reshape(centroids.shape)
    return centroids


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared) of every vector."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree.of(centroids, 1)
        for batch in batches:
            for i in range(batch.num_rows):
                block = _read(batch, i, centroids.shape[1])
                of, _ = assign(block, tree)
                far = ((block.points - centroids[of]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).flatten(), pa.array(of.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(storage.tidy(task), "vec_id long, cluster int, distance long")


def whole_vectors(table: DataFrame, dims: int, scale: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vector (array of longs: floor(scale * x)) of the rows whose vector has dims components, all of them finite."""
    x = F.col(vector)
    # A double is finite if it is not NaN and not an infinity; Spark holds NaN to be above all numbers.
    finite = F.forall("__x", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    kept = table.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("__x")).where((F.size("__x") == dims) & finite)
    return kept.select("vec_id", F.transform("__x", lambda c: F.floor(c.cast("double") * scale)).alias("vector"))


def cluster(vectors: DataFrame, seeds: DataFrame, rounds: int, dims: int) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector (vec_id, vector of dims longs).

    seeds holds the first centroids in its order; as many as there are take part. Defined results: null ids are kept as they are,
    repeated rows take part each; components of LARGEST or more raise an error; without vectors the result is empty. Ids are whole numbers.
    """
    spark = vectors.sparkSession
    centroids = np.array([r["vector"] for r in seeds.collect()], np.int64).reshape(-1, dims)
    folder = storage.scratch(spark, "centroids")
    blocks = trees(vectors, dims, f"{folder}/trees")
    centroids = lloyd(blocks, centroids, rounds)
    found = storage.save(assigned(blocks, centroids), f"{folder}/assigned")
    storage.remove(spark, f"{folder}/trees")
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row for each centroid
    whole = sum(sums.values())
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    each = spark.createDataFrame([(k, s, whole, names[k]) for k, s in sorted(sums.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
