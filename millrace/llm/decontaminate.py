"""Benchmark decontamination by SimHash over item-sized windows.

A document's windows have as many words as a benchmark item. A window that shares no word shingle with
any item of that size has similarity 0, so only windows around shared shingles, heavy enough to reach
the threshold at all, are fingerprinted. Fingerprints (64 bits) meet the items' by a multi-index: they are cut into
BLOCKS blocks, and an item stands under every value within FLIPS bits of its own in each block, which
guarantees all pairs within RADIUS = BLOCKS * (FLIPS + 1) - 1 bits. Each candidate is then verified by the
exact similarity of weighted shingles: the sum of smaller weights over the sum of larger ones, a
shingle weighing its count times its inverse frequency among the items.

Words are runs of letters and digits, lower-cased, so that spacing and punctuation don't matter.
Defined results: null and empty texts and items match nothing; an item with fewer words than a shingle is
one shingle; rows that repeat an id (of documents or items) give one row with the best window; ties of
windows go to the first; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage, words

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, FLIPS = 5, 3
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Items, and shingles of items, that are compared with all documents at a time; larger benchmarks take several passes. Weights are
#: those of the whole benchmark, so that passes change no result.
ITEMS_AT_ONCE, SHINGLES_AT_ONCE = 20_000, 4_000_000
#: Up to so many index keys are broadcast.
BROADCAST_KEYS = 2_000_000
_WIDTHS = [13, 13, 13, 13, 12]
_FOUND = "doc_id long, item_id long, similarity double, start_word long, n_words int"


def _shingles(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, shingles, each text's offsets among them, each text's number of words)."""
    for row, stop, data, ends in words.chunks(texts):
        hashes, _, _, at = words.word_hashes(data, ends, words.ALNUM)
        grams, _, to = words.shingles(hashes, at, size)
        yield row, stop, grams, to, np.diff(at)


@dataclass
class Items:
    """The benchmark: its shingles by item, their weights, and where each shingle occurs."""

    ids: list[int]
    n_words: np.ndarray
    bags: list[Counter]
    grams: np.ndarray  # distinct shingles of all items, ascending
    weight: np.ndarray  # of grams
    other: float  # weight of any other shingle
    posting: np.ndarray  # items by gram
    posting_at: np.ndarray
    total: np.ndarray  # weight of each item

    @classmethod
    def of(cls, ids: list[int], n_words: list[int], bags: list[Counter], grams: np.ndarray, times: np.ndarray, all_items: int) -> Items:
        """grams (all those of bags, ascending) occur in so many of all_items items of the whole benchmark."""
        held = sorted((g, i) for i, bag in enumerate(bags) for g in bag)
        at = np.searchsorted(np.array([g for g, _ in held], np.uint64), grams)
        weight = 1 + np.log(all_items / times)
        known = dict(zip(grams.tolist(), weight.tolist()))
        total = np.array([sum(n * known[g] for g, n in bag.items()) for bag in bags])
        return cls(ids, np.array(n_words, np.int64), bags, grams, weight, 1 + float(np.log(max(1, all_items))), np.array([i for _, i in held], np.int64), np.append(at, len(held)), total)

    def look(self, grams: np.ndarray) -> np.ndarray:
        """Index of each shingle among self.grams, or -1."""
        if not len(self.grams):
            return np.full(len(grams), -1)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, at, -1)

    def weigh(self, grams: np.ndarray) -> np.ndarray:
        at = self.look(grams)
        return np.where(at >= 0, self.weight[at], self.other) if len(self.grams) else np.full(len(grams), self.other)

    def similarity(self, item: int, window: list[int]) -> float:
        a, b = self.bags[item], Counter(window)
        names = sorted(a.keys() | b.keys())
        w = self.weigh(np.array(names, np.uint64))
        x, y = (np.array([bag[g] for g in names], float) * w for bag in (a, b))
        return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def simhash(grams: np.ndarray, weight: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of runs of n shingles from each of `at`."""
    bits = np.unpackbits(words.mix(grams).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.concatenate([np.zeros((1, 64)), np.cumsum((bits * 2.0 - 1) * weight[:, None], 0)])
    return np.packbits(total[at + n] - total[at] > 1e-9, axis=1, bitorder="little").view(np.uint64).ravel()


def blocks_of(prints: np.ndarray) -> np.ndarray:
    """The BLOCKS block values of each fingerprint."""
    shifts = np.cumsum([0, *_WIDTHS[:-1]])
    return np.stack([(prints >> np.uint64(s)) & np.uint64((1 << w) - 1) for s, w in zip(shifts, _WIDTHS)], 1).astype(np.int64)


def index_of(spark, items: Items) -> DataFrame:
    """n_words, block, value and item for every value within FLIPS bits of an item's; the driver makes the items' own values alone."""
    prints = np.zeros(len(items.ids), np.uint64)
    for i, bag in enumerate(items.bags):
        grams = np.array(list(bag.elements()), np.uint64)
        prints[i] = simhash(grams, items.weigh(grams), np.array([0]), np.array([len(grams)]))[0]
    own = pa.table({"n_words": pa.array(items.n_words.astype(np.int32)), "item": pa.array(np.arange(len(prints))), **{f"b{k}": pa.array(v) for k, v in enumerate(blocks_of(prints).T)}})
    own = spark.createDataFrame(own)
    near = []
    for block, width in enumerate(_WIDTHS):
        flips = [sum(1 << b for b in c) for n in range(FLIPS + 1) for c in combinations(range(width), n)]
        near.append(own.select("n_words", F.lit(block).cast("long").alias("block"), F.explode(F.lit(flips)).alias("flip"), "item", F.col(f"b{block}").alias("own")).select("n_words", "block", F.col("own").bitwiseXOR(F.col("flip").cast("long")).alias("value"), "item"))
    out = near[0]
    for one in near[1:]:
        out = out.unionAll(one)
    return out


def windows_of(grams: np.ndarray, items: Items, size: int, similarity: float) -> list[tuple[int, int]]:
    """(start, words) of a document's windows whose known shingles weigh enough for an item of that size."""
    look = items.look(grams)
    hits = np.flatnonzero(look >= 0)
    if not len(hits):
        return []
    at = look[hits]
    many = items.posting_at[at + 1] - items.posting_at[at]
    place = np.repeat(hits, many)
    item = items.posting[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(items.posting_at[at], many)]
    out = set()
    order = np.argsort(item, kind="stable")
    item, place = item[order], place[order]
    cuts = np.flatnonzero(np.diff(item)) + 1
    for i, where in zip(item[np.concatenate([[0], cuts])].tolist(), np.split(place, cuts)):
        n = int(items.n_words[i])
        run = max(1, n - size + 1)
        weight = np.concatenate([[0], np.cumsum(items.weight[look[where]])])
        starts = np.unique((where[:, None] - np.arange(run)[None, :]).ravel())
        starts = starts[(starts >= 0) & (starts + run <= len(grams))] if len(grams) >= run else np.zeros(0, int)
        held = weight[np.searchsorted(where, starts + run)] - weight[np.searchsorted(where, starts)]
        out.update((s, n) for s in starts[held >= similarity * items.total[i] - 1e-9].tolist())
    return sorted(out)


def shingled(benchmark: DataFrame, size: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """(items, shingles), written to folder: item, n_words, part (words of a shingle: an item with fewer than size is one of its own), grams;
    and in how many items of a part each shingle (part, gram) occurs. Items without a word or an id are left out."""
    schema = pa.schema([("item", pa.int64()), ("n_words", pa.int64()), ("part", pa.int32()), ("grams", pa.list_(pa.int64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, _, grams, to, n in _shingles(batch.column(1), size):
                bags = [grams[a:b].view(np.int64) for a, b in zip(to[:-1], to[1:])]
                kept = [k for k in range(len(n)) if n[k] and ids[row + k] is not None]
                yield pa.RecordBatch.from_pydict({"item": [ids[row + k] for k in kept], "n_words": [int(n[k]) for k in kept], "part": [min(int(n[k]), size) for k in kept], "grams": [bags[k] for k in kept]}, schema)

    items = storage.save(benchmark.mapInArrow(storage.tidy(task), "item long, n_words long, part int, grams array<long>"), f"{folder}/items")
    each = items.select("part", F.explode(F.array_distinct("grams")).alias("gram"))
    return items, storage.save(each.groupBy("part", "gram").agg(F.count("*").alias("times")), f"{folder}/shingles")


def _items(items: DataFrame, shingles: DataFrame, counts: dict[int, int]) -> dict[int, Items]:
    """Some items, by part, with their shingles' weights: as many as a pass holds."""
    rows = items.toArrow().to_pylist()
    known = shingles.join(items.select("part", F.explode("grams").alias("gram")).distinct(), ["part", "gram"], "left_semi").toArrow()
    part, gram, times = (known[c].to_numpy() for c in ("part", "gram", "times"))
    gram = gram.astype(np.int64).view(np.uint64)
    out = {}
    for p in sorted({r["part"] for r in rows}):
        own = [r for r in rows if r["part"] == p]
        order = np.flatnonzero(part == p)
        order = order[np.argsort(gram[order], kind="stable")]
        bags = [Counter(np.array(r["grams"], np.int64).view(np.uint64).tolist()) for r in own]
        out[p] = Items.of([r["item"] for r in own], [r["n_words"] for r in own], bags, gram[order], times[order], counts[p])
    return out


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, start_word and n_words: each document's best window for every item it leaks. Ids are whole numbers."""
    spark = docs.sparkSession
    storage.small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("__doc"), F.col(text).alias("__text"))
    folder = storage.scratch(spark, "benchmark")
    items, shingles = shingled(benchmark.select(F.col(item_id).cast("long").alias("__item"), F.col(item_text).alias("__text")), size, folder)
    sizes = items.groupBy("part").agg(F.count("*").alias("items"), F.sum(F.size("grams")).alias("grams")).collect()  # a row for each part
    counts = {r["part"]: r["items"] for r in sizes}
    passes = max(1, -(-sum(counts.values()) // ITEMS_AT_ONCE), -(-sum(r["grams"] for r in sizes) // SHINGLES_AT_ONCE))
    found = []
    for k in range(passes):  # one, unless the benchmark is very large
        some = items.where(F.pmod(F.xxhash64("item", "grams"), F.lit(passes)) == k)
        found.append(_pass(spark, rows, _items(some, shingles, counts), size, similarity))
    storage.remove(spark, folder)
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("start"), "n_words")).alias("best")
    best = reduce(DataFrame.unionAll, found).groupBy("doc_id", "item_id").agg(best)
    return best.select("doc_id", "item_id", "best.similarity", (-F.col("best.start")).alias("start_word"), "best.n_words")


def _pass(spark, rows: DataFrame, items: dict[int, Items], size: int, similarity: float) -> DataFrame:
    """What some items (by the words of their shingles) have in common with all documents, which are read once."""
    shared = spark.sparkContext.broadcast(items)  # ITEMS_AT_ONCE items and SHINGLES_AT_ONCE shingles at most, or one item

    schema = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int32()), ("fingerprint", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows: dict[int, np.ndarray] = {}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for part, it in shared.value.items():
                low = lows.get(part)
                if low is None:
                    lows[part] = low = np.zeros(1 << 16, bool)  # most shingles end here
                    low[(it.grams & np.uint64(0xFFFF)).astype(int)] = True
                for row, _, grams, to, _ in _shingles(batch.column(1), part):
                    maybe = np.flatnonzero(low[(grams & np.uint64(0xFFFF)).astype(int)])
                    maybe = maybe[it.look(grams[maybe]) >= 0]
                    out = {k: [] for k in ("doc_id", "start_word", "n_words", "fingerprint", "grams")}
                    for d in np.unique(np.searchsorted(to, maybe, "right") - 1).tolist():
                        own = grams[to[d] : to[d + 1]]
                        found = windows_of(own, it, part, similarity)
                        if not found or ids[row + d] is None:
                            continue
                        at, n = np.array([s for s, _ in found]), np.array([max(1, w - part + 1) for _, w in found])
                        out["fingerprint"] += simhash(own, it.weigh(own), at, n).view(np.int64).tolist()
                        out["grams"] += [own[s : s + m].view(np.int64).tolist() for s, m in zip(at, n)]
                        out["doc_id"] += [ids[row + d]] * len(found)
                        out["start_word"] += at.tolist()
                        out["n_words"] += [w for _, w in found]
                    yield pa.RecordBatch.from_pydict(out, schema)

    windows = rows.mapInArrow(storage.tidy(fingerprint), "doc_id long, start_word long, n_words int, fingerprint long, grams array<long>")
    shift, cut = 0, []
    for block, width in enumerate(_WIDTHS):
        value = F.shiftrightunsigned("fingerprint", shift).bitwiseAND(F.lit((1 << width) - 1))
        cut.append(F.struct(F.lit(block).cast("long").alias("block"), value.cast("long").alias("value")))
        shift += width
    windows = windows.withColumn("__cut", F.explode(F.array(*cut))).select("*", "__cut.block", "__cut.value").drop("__cut")
    index = reduce(DataFrame.unionAll, [index_of(spark, it) for it in items.values()]) if items else spark.createDataFrame([], "n_words int, block long, value long, item long")
    keys = sum(len(it.ids) for it in items.values()) * sum(len(list(combinations(range(w), n))) for w in _WIDTHS for n in range(FLIPS + 1))
    if keys <= BROADCAST_KEYS:
        index = F.broadcast(index)
    near = windows.join(index, ["n_words", "block", "value"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints: dict = {}
        for batch in batches:
            out, seen = [], set()
            for doc, start, n, item, grams in zip(*(batch.column(i).to_pylist() for i in range(5))):
                it = shared.value[min(n, size)]
                if (doc, start, n, item) in seen:  # another block of the same candidate
                    continue
                seen.add((doc, start, n, item))
                window = np.array(grams, np.int64).view(np.uint64).tolist()
                if not prints.setdefault((min(n, size), item), it.bags[item].keys()) & set(window):
                    continue
                s = it.similarity(item, window)
                if s >= similarity - 1e-12:
                    out.append((doc, it.ids[item], s, start, n))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int32())], ["doc_id", "item_id", "similarity", "start_word", "n_words"])

    return near.select("doc_id", "start_word", "n_words", "item", "grams").mapInArrow(verify, _FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the documents that leak an item; rows without an id stay, and so do other texts under a leaking one's id."""
    key = F.when(F.col(doc_id).isNotNull(), F.xxhash64(doc_id, text))
    leaks = find(docs.select(key.alias("__key"), text), benchmark, doc_id="__key", text=text, **options).select(F.col("doc_id").alias("__leak")).distinct()
    # Written first, so that Spark knows whether it is small enough to broadcast and texts can stay where they are.
    leaks = storage.save(leaks, storage.scratch(docs.sparkSession, "leaks"))
    return docs.join(leaks, key == F.col("__leak"), "left_anti")
