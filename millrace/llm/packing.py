"""Best-fit packing of token sequences by a configuration linear program.

Neighbouring lengths are grouped into CLASSES classes at most, each counted with its longest length, so that
rounding up costs least. A configuration is a multiset of classes that fits one sequence. The program over the
histogram of classes covers every class's count with as few configurations as possible. It is solved by
multiplicative weights: a class's price falls as it is covered, and each step uses a configuration whose worth at
these prices is within a share of the most, as a bounded knapsack (dynamic programming) tells; the prices give
a number of sequences that no solution is below. Passes with smaller steps follow until the best solution over
the configurations met (by pivoting, so that it has no more configurations than classes) is within GAP of
that number, or PASSES are done. Its numbers are then rounded down. Each configuration is filled with real pieces, the longest
of every class first, and then with the longest that fit into the room that is left. What the rounding leaves is
filled best-fit by length, as are sequences of the program's that real pieces don't fill well where that takes fewer
sequences in all, so the result is never above best-fit alone. Only histogram and plan pass through the driver; their size is bounded by the
capacity, not by the number of documents.

Pieces get their places without a shuffle of ids: a task numbers its pieces within each length, counts by
task and length give each task its first number, and numbers fall into the plan's ranges.

Defined results: a null or empty text has its end id alone; rows without an id, and rows that repeat
one, are documents of their own; only documents of more than `capacity` ids are cut; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage, words
from .tokens import encoder

CAPACITY = 4096
#: Classes of lengths in the program, and the share by which its solution may exceed the least one.
CLASSES, GAP = 96, 0.01
#: Shares by which a step's configuration may fall short of the worthiest, pass by pass, and steps of a pass.
PASSES, STEPS = (0.25, 0.12, 0.06, 0.03), 3000
#: Room (ids) that a sequence of the program's may be left with; of the rows tried the first with fewest sequences stands, with none
#: of the program's as the last resort.
WASTES = (4096, 64, 16, 4, 1, 0, -1)


def classes(lengths: np.ndarray, counts: np.ndarray, most: int = CLASSES) -> np.ndarray:
    """Indexes of the longest length of each class (ascending): neighbours are merged while there are too many, where rounding up costs least."""
    top, n = np.arange(len(lengths)), counts.astype(float)
    while len(top) > most:
        i = int((n[:-1] * np.diff(lengths[top])).argmin())
        n[i + 1] += n[i]
        top, n = np.delete(top, i), np.delete(n, i)
    return top


def price(lengths: np.ndarray, counts: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """How many of each length the worthiest configuration holds, no more than its count, and what it is worth: a bounded knapsack."""
    parts = []  # (index, copies): powers of two and a rest
    for i in np.flatnonzero(worth > 0).tolist():
        n, step = min(int(counts[i]), capacity // int(lengths[i])), 1
        while n > 0:
            parts.append((i, min(step, n)))
            n, step = n - step, step * 2
    best, taken = np.zeros(capacity + 1), np.zeros((len(parts), capacity + 1), bool)
    for k, (i, copies) in enumerate(parts):
        size = copies * int(lengths[i])
        value = best[: capacity + 1 - size] + copies * worth[i]
        np.greater(value, best[size:] + 1e-12, out=taken[k, size:])
        np.maximum(best[size:], value, out=best[size:])
    made, room = np.zeros(len(lengths), np.int64), capacity
    for k in range(len(parts) - 1, -1, -1):
        if taken[k, room]:
            i, copies = parts[k]
            made[i] += copies
            room -= copies * int(lengths[i])
    return made, float(best[capacity])


def weigh(lengths: np.ndarray, counts: np.ndarray, capacity: int, pool: list[np.ndarray], short: float, bound: float) -> float:
    """One pass of multiplicative weights: adds the configurations it uses to pool; the best number of sequences that no solution is below."""
    prices, covered = 1.0 / counts, np.zeros(len(lengths))
    held = np.zeros((len(pool) + STEPS, len(lengths)))
    n = len(pool)
    if n:
        held[:n] = pool
    worth, most = held[:n] @ prices, np.inf
    for step in range(STEPS):
        # Prices only fall, so `most`, the worth of the worthiest when last asked for, is never too small.
        if not n or worth.max() < (1 - short) * most:
            made, most = price(lengths, counts, prices, capacity)
            bound = max(bound, float(prices @ counts) / most)
            if not n or worth.max() < most * (1 - 1e-9):
                pool.append(made)
                held[n] = made
                n += 1
                worth = held[:n] @ prices
        used = held[int(worth.argmax())]
        at = np.flatnonzero(used)
        part = used[at] / counts[at]
        part /= part.max()
        covered[at] += part
        fallen = prices[at] * (1 - short) ** part
        worth += held[:n, at] @ (fallen - prices[at])
        prices[at] = fallen
        if step % 100 == 99:
            worth = held[:n] @ prices
            if covered.min() >= np.log(len(lengths) + 1) / short**2:
                break
    return bound


def cover(lengths: np.ndarray, counts: np.ndarray, capacity: int, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best way to cover all counts with configurations of the pool (or of one class): these, how often each, and the prices that prove it."""
    n, columns = len(lengths), pool.T.astype(float)
    basis = np.diag(np.minimum(counts, capacity // lengths).astype(float))
    # Slightly uneven counts leave no ties, so every step makes progress and no basis comes twice.
    need = counts * (1 + 1e-4 * np.random.default_rng(0).random(n))
    inverse = np.linalg.inv(basis)
    used, pivots = inverse @ need, 0
    while True:
        worth = inverse.sum(0) @ columns
        j = int(worth.argmax())
        if worth[j] <= 1 + 1e-7:
            break
        step = inverse @ columns[:, j]
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        out, pivots = int(ratio.argmin()), pivots + 1
        basis[:, out] = columns[:, j]
        if pivots % 50:
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
        else:
            inverse = np.linalg.inv(basis)
        used = inverse @ need
    inverse = np.linalg.inv(basis)
    times = np.maximum(inverse @ counts, 0)
    times /= min(1.0, float((basis @ times / counts).min()))
    return basis.T.astype(np.int64), times, np.maximum(inverse.sum(0), 0)


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = GAP) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Configurations and how often to use each (fractions), together covering all counts, and a number of sequences that no solution is below."""
    pool: list[np.ndarray] = []
    bound = 0.0
    for short in PASSES:
        bound = weigh(lengths, counts, capacity, pool, short, bound)
        made, times, prices = cover(lengths, counts, capacity, np.stack(pool))
        bound = max(bound, float(prices @ counts) / max(price(lengths, counts, prices, capacity)[1], 1e-9))
        if times.sum() <= max(bound * (1 + gap), bound + 0.5):
            break
    return [(c, float(x)) for c, x in zip(made, times) if x > 0], bound


class Stock:
    """Pieces by length (ascending), from which sequences are filled."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int):
        self.lengths, self.left, self.capacity = lengths.tolist(), counts.tolist(), capacity
        self.up = list(range(len(lengths) + 1))  # by index + 1: where to look on for lengths of which some are left
        self.fits = (np.searchsorted(lengths, np.arange(capacity + 1), "right") - 1).tolist()

    def longest(self, at: int) -> int:
        """The longest length not above that at `at` of which some are left, or -1."""
        i, up = at + 1, self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i - 1

    def take(self, at: int, n: int) -> None:
        self.left[at] -= n
        if not self.left[at]:
            self.up[at + 1] = at

    def fill(self, slots: list[int], times: float, waste: float = float("inf")) -> list[tuple[dict[int, int], int]]:
        """`times` sequences at most, each with a piece for every slot, no longer than the slot's length but for the last, and then
        best-fit; none that would be left with more than `waste` of room. Equal ones are made together."""
        out = []
        while times > 0:
            held, room = {}, self.capacity
            for k, slot in enumerate([*slots, None]):
                while room > 0:
                    at = self.longest(min(slot, self.fits[room]) if slot is not None and k + 1 < len(slots) else self.fits[room])
                    while at >= 0 and self.left[at] == held.get(at, 0):
                        at = self.longest(at - 1)
                    if at < 0:
                        break
                    n = 1 if slot is not None else min(self.left[at] - held.get(at, 0), room // self.lengths[at])
                    held[at] = held.get(at, 0) + n
                    room -= n * self.lengths[at]
                    if slot is not None:
                        break
            if not held or room > waste:
                break
            n = min(times, *(self.left[at] // k for at, k in held.items()))
            for at, k in held.items():
                self.take(at, k * n)
            out.append((held, n))
            times -= n
        return out


def best_fit(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Sequences filled with the longest piece that fits, again and again."""
    return Stock(lengths, counts, capacity).fill([], float("inf"))


@dataclass
class Plan:
    """Ranges of pieces of a length: (length, first number) ascending, and each range's configuration."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray  # pieces of the length in one sequence
    sequence: np.ndarray  # the first sequence of the configuration
    offset: np.ndarray  # where the length begins in a sequence
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the piece with each number (from 0) within its length."""
        key = lambda a, b: a.astype(np.int64) * (1 << 44) + b
        at = np.searchsorted(key(self.length, self.first), key(length, number), "right") - 1
        inside = number - self.first[at]
        return self.sequence[at] + inside // self.each[at], self.offset[at] + inside % self.each[at] * length


def choose(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Real configurations with their numbers of sequences, together all pieces, and how many of the list come from the program."""
    if not len(lengths):
        return [], 0
    top = classes(lengths, counts)
    found = solve(lengths[top], np.diff(np.cumsum(counts)[top], prepend=0), capacity)[0]
    found.sort(key=lambda c: (-int(np.flatnonzero(c[0]).max()), -c[1]))
    least, best = -(-int((lengths * counts).sum()) // capacity), None
    for waste in WASTES:
        stock, chosen = Stock(lengths, counts, capacity), []
        for made, x in found:
            chosen += stock.fill([int(top[c]) for c in np.flatnonzero(made)[::-1].tolist() for _ in range(int(made[c]))], int(x + 1e-6), waste)
        by_program = len(chosen)
        chosen += stock.fill([], float("inf"))
        total = sum(times for _, times in chosen)
        if best is None or total < best[0]:
            best = total, chosen, by_program
        if best[0] == least:
            break
    return best[1:]


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """histogram: number of pieces by length (1 to capacity)."""
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    rows, given, sequence = [], [0] * len(lengths), 0
    for made, times in choose(lengths, counts, capacity)[0]:
        offset = 0
        for i in sorted(made, reverse=True):
            rows.append((int(lengths[i]), given[i], made[i], sequence, offset))
            given[i] += made[i] * times
            offset += made[i] * int(lengths[i])
        sequence += int(times)
    if given != counts.tolist():
        raise ValueError("the plan doesn't hold every piece once")
    rows.sort()
    return Plan(*(np.array([r[k] for r in rows], np.int64) for k in range(5)), sequence)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (32 bits, little-endian), task and number (within the task and length) of every piece."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, me = encoder(tokenizer), TaskContext.get().partitionId()
        given = np.zeros(capacity + 1, np.int64)
        try:
            for batch in batches:
                for row, stop, data, ends in words.chunks(batch.column(1)):
                    ids, at = enc.encode(data, ends)
                    ids = np.insert(ids, at[1:], end_id).astype("<u4")
                    n = np.diff(at) + 1
                    many = -(-n // capacity)
                    doc = np.repeat(np.arange(len(n)), many)
                    piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                    length = np.minimum(n[doc] - piece * capacity, capacity)
                    order = np.argsort(length, kind="stable")
                    count = np.bincount(length, minlength=capacity + 1)
                    number = np.empty(len(doc), np.int64)
                    number[order] = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + given[length[order]]
                    given += count
                    held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(length)]) * 4), pa.py_buffer(ids)])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(row, stop - row).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), held.cast(pa.binary()), pa.array(np.full(len(doc), me, np.int32)), pa.array(number)],
                        ["doc_id", "piece", "start", "length", "ids", "task", "number"],
                    )
        finally:
            enc.forget()

    storage.small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long"), F.col(text))
    return rows.mapInArrow(storage.tidy(task), "doc_id long, piece int, start long, length long, ids binary, task int, number long")


def pack(rows: DataFrame, capacity: int = CAPACITY, folder: str | None = None) -> DataFrame:
    """Give every row (task, length, number, as `pieces` numbers them in a table already written) its sequence_id and offset.

    Sequences have consecutive ids, and pieces follow one another in them without a gap.
    """
    spark = rows.sparkSession
    counts = rows.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = storage.save(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), f"{folder or storage.scratch(spark, 'packing')}/counts")
    # At most `capacity` rows.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(plan(histogram, capacity))
    rows = rows.join(counts.drop("n"), ["task", "length"])
    kept = [c for c in rows.columns if c not in ("task", "number", "base")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(kept).schema.fields)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            b = {c: b.column(i) for i, c in enumerate([*kept, "at"])}
            sequence, offset = p.place(b["length"].to_numpy(), b["at"].to_numpy()) if len(b["at"]) else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    rows = rows.select(*kept, (F.col("base") + F.col("number")).alias("at"))
    return rows.mapInArrow(task, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(placed, held): doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece, and the written pieces with their ids.

    Both read from folder (a new one, unless given).
    """
    folder = folder or storage.scratch(docs.sparkSession, "packing")
    held = storage.save(pieces(docs, tokenizer, end_id, capacity, doc_id, text).withColumn("ids_crc32", F.crc32("ids")), f"{folder}/pieces")
    return pack(held.select("doc_id", "piece", "start", "length", "ids_crc32", "task", "number"), capacity, folder), held
