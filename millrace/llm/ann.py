"""Approximate nearest neighbours by adaptive dimension scans of inverted lists.

Lists come from k-means on a bounded sample. A query probes its nearest lists; in each, vectors are
compared in a randomly rotated space, a block of columns at a time: a hypothesis test on the partial
distance abandons a candidate as soon as it is unlikely to come below the query's k-th best so far, and
what is left is measured exactly on the original vectors. The share of lists to probe is calibrated
on the sample for a target recall. Lists and their queries are dealt out in blocks of bounded size, so a
list that holds a third of all vectors is many tasks' work.

Defined results: vectors that are null, zero, of another length than most, or hold nulls or non-finite
numbers take no part, nor do rows without an id; a query isn't matched with rows of its own id; rows that
repeat an id are candidates of their own, and as queries are one (of the smallest vector); ties go to smaller ids; empty
tables give empty results; other columns are ignored. A query whose probed lists held fewer than k candidates goes through all
lists, so none is left with fewer than there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage

#: Vectors that lists are fitted on, and queries (of the same sample) that calibrate the probing.
SAMPLE, TRIALS = 16_384, 256
MAX_LISTS, ROUNDS = 1024, 8
TARGET_RECALL = 0.97
#: Columns compared at once, and how many standard deviations a partial distance must be off to be abandoned.
COLUMNS, SURE = 16, 2.4
#: Vectors and queries of a task's group at most, about.
LIST_BLOCK, QUERY_BLOCK = 8192, 1024


@dataclass
class Lists:
    centres: np.ndarray
    turn: np.ndarray  # an orthogonal matrix
    probes: int


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None, :], 0)


def fit(sample: np.ndarray, n: int, k: int, seed: int = 7) -> Lists:
    """Lists for n vectors like those of the sample, and the probes that found TARGET_RECALL of the sample's neighbours."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    lists = int(np.clip(round(n**0.5), 1, min(MAX_LISTS, len(sample))))
    centres = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(ROUNDS):
        own = _squares(sample, centres).argmin(1)
        count = np.bincount(own, minlength=lists)
        total = np.zeros((lists, dim))
        np.add.at(total, own, sample)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    own = _squares(sample, centres).argmin(1)
    trial = rng.choice(len(sample), min(TRIALS, len(sample)), replace=False)
    apart = _squares(sample[trial], sample)
    apart[np.arange(len(trial)), trial] = np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        probes = lists
    else:
        near = np.argpartition(apart, k - 1, 1)[:, :k]
        rank = _squares(sample[trial], centres).argsort(1).argsort(1)
        needed = np.sort(np.take_along_axis(rank, own[near], 1).ravel())
        probes = int(needed[min(len(needed) - 1, int(np.ceil(TARGET_RECALL * len(needed))))]) + 1
    return Lists(centres, np.linalg.qr(rng.normal(size=(dim, dim)))[0], probes)


def _valid(vector: Column) -> Column:
    number = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & number & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def scan(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's index, id, distance): each query's k nearest of the vectors, found by the adaptive scan."""
    dim = vectors.shape[1]
    q, x = queries @ turn, vectors @ turn
    best = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
    limit = np.full(len(q), np.inf)  # squared
    # Partial distances come from expanded squares and a rotation: rounding grows with the vectors' lengths.
    slack_q, slack_x = 1e-9 * (queries**2).sum(1), 1e-9 * (vectors**2).sum(1)
    step = 64
    at = 0
    while at < len(x):
        some = slice(at, min(at + step, len(x)))
        rows, cols = np.nonzero(query_ids[:, None] != ids[None, some])
        partial = np.zeros(len(rows))
        for c in range(0, dim, COLUMNS):
            to = min(c + COLUMNS, dim)
            if c == 0:
                partial = _squares(q[:, :to], x[some, :to])[rows, cols]
            else:
                partial = partial + ((q[rows, c:to] - x[some][cols, c:to]) ** 2).sum(1)
            if to < dim:
                go = partial * (dim / to) <= limit[rows] * (1 + SURE / to**0.5) ** 2 + slack_q[rows] + slack_x[some][cols]
                rows, cols, partial = rows[go], cols[go], partial[go]
        exact = np.sqrt(((queries[rows] - vectors[some][cols]) ** 2).sum(1))
        order = np.lexsort((ids[some][cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        cuts = np.searchsorted(rows, np.arange(len(q) + 1))
        for i in np.unique(rows).tolist():
            part = slice(cuts[i], min(cuts[i + 1], cuts[i] + k))
            d, v = np.concatenate([best[i][0], exact[part]]), np.concatenate([best[i][1], ids[some][cols[part]]])
            by = np.lexsort((v, d))[:k]
            best[i] = d[by], v[by]
            if len(by) == k:
                limit[i] = d[by[-1]] ** 2 * (1 + 1e-9)
        at, step = at + step, min(step * 4, 1024)
    n = [len(d) for d, _ in best]
    return np.repeat(np.arange(len(q)), n), np.concatenate([v for _, v in best]), np.concatenate([d for d, _ in best])


def nearest(rows: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every row for which `queries` holds; queries may use `vec_id` alone."""
    spark = rows.sparkSession
    folder = storage.scratch(spark, "ann")
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & _valid(F.col("v")))
    schema = "query_id long, rank int, vec_id long, score double"
    shape = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if shape is None:
        return spark.createDataFrame([], schema)
    dim, n = shape
    rows = rows.where(F.size("v") == dim)
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("v").toArrow()
    shared = spark.sparkContext.broadcast(fit(_matrix(sample["v"], dim), n, k))  # bounded by MAX_LISTS vectors
    probes = min(shared.value.probes, len(shared.value.centres))

    def assign(most: int, out: list[str]):
        def task(batches):
            for b in batches:
                near = np.argpartition(_squares(_matrix(b.column(1), dim), shared.value.centres), most - 1, 1)[:, :most] if b.num_rows else np.zeros((0, most), int)
                lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, most, dtype=np.int32), pa.array(near.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], out)

        return task

    def dealt(df: DataFrame, most: int, name: str) -> DataFrame:
        out = df.mapInArrow(assign(most, [name, "v", "lists"]), f"{name} long, v array<double>, lists array<int>")
        return out.select(name, F.col("v").alias(f"{name}_v"), F.explode("lists").alias("list"))

    vectors = storage.save(dealt(rows, 1, "vec"), f"{folder}/vectors")
    asked = rows.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = storage.save(asked.mapInArrow(assign(probes, ["query", "v", "lists"]), "query long, v array<double>, lists array<int>"), f"{folder}/queries")
    found = storage.save(_search(vectors, asked, shared, dim, k, f"{folder}/blocks"), f"{folder}/found")
    few = asked.join(found.where(F.col("rank") == k).select("query_id"), F.col("query") == F.col("query_id"), "left_anti")
    few = storage.save(few, f"{folder}/few")
    if probes < len(shared.value.centres) and not few.isEmpty():
        every = few.withColumn("lists", F.sequence(F.lit(0), F.lit(len(shared.value.centres) - 1)))
        again = _search(vectors, every, shared, dim, k, f"{folder}/blocks-again")
        found = found.join(few, F.col("query_id") == F.col("query"), "left_anti").unionAll(again)
    found = storage.save(found, f"{folder}-out")
    storage.remove(spark, folder)
    return found


def _search(vectors: DataFrame, asked: DataFrame, shared, dim: int, k: int, work: str) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of the vectors (vec, vec_v, list) in the lists of every query (query, v, lists)."""
    asked = asked.select("query", F.col("v").alias("query_v"), F.explode("lists").alias("list"))
    sizes = vectors.groupBy("list").agg(F.count("*").alias("n_vectors")).join(asked.groupBy("list").agg(F.count("*").alias("n_queries")), "list")
    blocks = sizes.select("list", F.ceil(F.col("n_vectors") / LIST_BLOCK).cast("int").alias("vs"), F.ceil(F.col("n_queries") / QUERY_BLOCK).cast("int").alias("qs"))
    blocks = F.broadcast(storage.save(blocks, work))  # MAX_LISTS rows at most
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    vectors = vectors.join(blocks, "list").withColumn("vb", F.pmod(F.xxhash64("vec"), F.col("vs")).cast("int")).withColumn("qb", every("qs"))
    asked = asked.join(blocks, "list").withColumn("qb", F.pmod(F.xxhash64("query"), F.col("qs")).cast("int")).withColumn("vb", every("vs"))
    keys = ["list", "vb", "qb"]

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not left.num_rows or not right.num_rows:
            return pa.table(empty)
        query_ids = left["query"].to_numpy()
        i, ids, d = scan(_matrix(left["query_v"], dim), query_ids, _matrix(right["vec_v"], dim), right["vec"].to_numpy(), shared.value.turn, k)
        return pa.table({"query_id": query_ids[i], "vec_id": ids, "score": d})

    left = asked.select(*keys, "query", "query_v").groupBy(*keys)
    right = vectors.select(*keys, "vec", "vec_v").groupBy(*keys)
    found = left.cogroup(right).applyInArrow(group, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
