"""N-gram Jaccard join by vertical partitioning.

All word n-grams stand in one global order, that of their hashes. Cutting the order into fragments cuts
every document's set into segments.

1. Documents with equal sets are one class; the work below is on classes.
2. Candidates. Two sets that are similar enough differ in at most D n-grams, D following from their
   sizes. With k > D fragments at least k - D segments are therefore equal in both, so an equi-join on
   segment hashes finds every such pair, whatever n-grams are frequent. Sizes fall into bands; a set
   is cut for its own band, and for each band below in which a set can be similar to it. k is large
   enough for a set of the band's smallest size to fill more than D segments as a rule, so that empty
   segments (equal in any two sets) need not be joined; a set that fills fewer is also cut by further
   orders, until one suits it, and if none of ORDERS does, its empty segments under the first are joined.
   Where a set fills more segments than it can differ in, only so many and one are joined: those that hold the
   most n-grams (ties by hash). Of two similar sets each lacks at most D of the other's segments, so in any common order of
   segments the first one that both hold is among the first D + 1 of each; full ones are seldom shared by unlike sets.
3. In each run of equal segments, sets are compared with the run's first and with their neighbour, in an
   order of each run's own, so that a set meets others in each of its runs. A parity sketch, whose Hamming
   distance never exceeds the number of differing n-grams, drops most candidates. A sketch of fixed length can't tell
   large sets apart, so these have another one that grows with their size (2 to 4 bits an n-gram), which pairs
   that are left must pass, too, before any n-grams move; for the others partial overlaps are counted fragment by fragment and summed per pair: first for each set's nearest by sketch, and
   then for those that the links of the first leave in different components.
4. Components of these links are contracted. Runs that hold several components are joined once more,
   for pairs of different components alone whose sketches are near, and verified likewise, so that no link is lost
   that could join two components, and no group's pairs are all enumerated. What is compared here (not put out) grows with the square of the members of
   one run that nothing has linked yet.

Defined results: null texts and texts without words have no n-gram and link with nothing, nor do rows
without an id; rows that repeat an id are separate documents; a text shorter than n words is one n-gram;
empty tables give empty results; other columns are ignored. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage, words
from .components import components

#: Fragments in which overlaps are counted.
PARTS = 8
#: 64-bit words of a parity sketch.
SKETCH = 8
#: Sets of more n-grams than half a parity sketch's bits have a long sketch, too, of LONG_BITS at most.
LONG_BITS = 1 << 18
#: Up to this many ids (16 MB) the documents to verify are picked by a broadcast; beyond it by a shuffle.
BROADCAST_IDS = 2_000_000
#: A size band reaches from L to L / BAND.
BAND = 0.6
#: Orders by which a set is cut at most, before its empty segments are joined.
ORDERS = 12
#: Sets that a task remembers, so as to emit equal ones once.
REMEMBER = 500_000
_SKETCHES = [f"p{i}" for i in range(SKETCH)]


class Bands:
    """Size bands for similarity num / den, and the fragments k and tolerated differences d of each."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(int(self.low[-1] / BAND) + 1)
        self.low = np.array(self.low, np.int64)
        top = np.append(self.low[1:] - 1, self.low[-1])
        self.reach = den * top // num  # the largest set similar to one of the band
        self.d = (top + self.reach) * (den - num) // (num + den)
        self.k = np.array([self._fragments(int(size), int(d)) for size, d in zip(self.low, self.d)], np.int64)

    @staticmethod
    def _fragments(size: int, d: int) -> int:
        """The fewest fragments (nearly) of which `size` n-grams fill more than d, two standard deviations aside."""
        k = d + 1
        while d and k < 4 * (d + 1):
            empty = np.exp(-size / k)
            spread = np.sqrt(max(k * empty * (1 - empty * (1 + size / k)), 0.0))
            if k * (1 - empty) - 2 * spread >= d + 1:
                break
            k += max(1, k // 50)
        return k

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, "right") - 1

    def differ(self, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
        """The most n-grams in which sets of these sizes differ from similar ones that are cut for the band, too.

        Those of a higher band meet only the band's own sets there; the others also larger ones.
        """
        own = self.of(sizes) == band
        most = np.where(own, self.den * sizes // self.num, self.low[np.minimum(band + 1, len(self.low) - 1)] - 1)
        return (sizes + most) * (self.den - self.num) // (self.num + self.den)


def _sets(texts: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, n-grams, offsets): every text's distinct n-grams in the global order."""
    for row, stop, data, ends in words.chunks(texts):
        hashes, _, _, at = words.word_hashes(data, ends)
        grams, _, to = words.shingles(hashes, at, n)
        yield row, stop, *words.distinct_sorted(grams, to)


def _sums(values: np.ndarray, to: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[to[1:]] - total[to[:-1]]


def _set_ids(grams: np.ndarray, to: np.ndarray) -> np.ndarray:
    return words.mix(_sums(words.mix(grams + np.uint64(0x5851F42D4C957F2D)), to) + np.diff(to).astype(np.uint64)).view(np.int64)


def _parity(grams: np.ndarray, to: np.ndarray) -> list[np.ndarray]:
    """SKETCH words for each text: every n-gram flips one bit."""
    bit = words.mix(grams ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * SKETCH)
    flip = np.uint64(1) << (bit % np.uint64(64))
    some = to[:-1] < to[1:]
    out = []
    for i in range(SKETCH):
        word = np.zeros(len(to) - 1, np.uint64)
        if len(grams):
            word[some] = np.bitwise_xor.reduceat(np.where(bit // np.uint64(64) == i, flip, np.uint64(0)), to[:-1][some])
        out.append(word.view(np.int64))
    return out


def _long_sketches(grams: np.ndarray, to: np.ndarray) -> pa.Array:
    """A parity sketch of 2 to 4 bits an n-gram (a power of two, LONG_BITS at most) for each larger set, nothing for the others."""
    sizes = np.diff(to)
    bits = np.minimum(2 ** np.ceil(np.log2(2 * np.maximum(sizes, 1))).astype(np.int64), LONG_BITS)
    bits[2 * sizes <= 64 * SKETCH] = 0
    at = np.concatenate([[0], np.cumsum(bits)])
    own, long = np.repeat(bits, sizes), np.repeat(bits > 0, sizes)
    bit = words.mix(grams[long] ^ np.uint64(0x9FB21C651E98DF25)) & (own[long] - 1).astype(np.uint64)
    odd = np.bincount(np.repeat(at[:-1], sizes)[long] + bit.astype(np.int64), minlength=at[-1]) & 1
    held = np.packbits(odd.astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((at // 8).astype(np.int32)), pa.py_buffer(held)])


def _long_apart(a: bytes, b: bytes) -> int:
    """Hamming distance of two long sketches; the longer one is folded, which leaves the shorter one's bits."""
    x, y = (np.frombuffer(z, np.uint64) for z in (a, b))
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, n), 0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def classes(docs: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """doc, row (a hash of the text), set_id, size, p0, p1, ..., sketch of every row; rows with equal sets share a set_id."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, grams, to in _sets(batch.column(2), n):
                ids, texts = (batch.column(i).slice(row, stop - row) for i in range(2))
                yield pa.RecordBatch.from_arrays([ids, texts, pa.array(_set_ids(grams, to)), pa.array(np.diff(to)), *map(pa.array, _parity(grams, to)), _long_sketches(grams, to)],
                                                     ["doc", "row", "set_id", "size", *_SKETCHES, "sketch"])

    schema = "doc long, row long, set_id long, size long, " + ", ".join(f"{p} long" for p in _SKETCHES) + ", sketch binary"
    return docs.select(F.col(doc_id).cast("long"), F.xxhash64(text), text).mapInArrow(storage.tidy(task), schema)


def _segments(grams: np.ndarray, to: np.ndarray, k: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each non-empty segment: its set's index, its fragment, the hash of what it holds, and how many n-grams that are."""
    owner = np.repeat(np.arange(len(to) - 1), np.diff(to))
    place = grams if order == 0 else words.mix(grams ^ np.uint64((0x9E3779B97F4A7C15 * (2 * order + 1)) % 2**64))
    fragment = ((place >> np.uint64(32)) * k[owner].astype(np.uint64)) >> np.uint64(32)
    if order:
        by = np.lexsort((fragment, owner))
        owner, fragment, grams = owner[by], fragment[by], grams[by]
    head = np.ones(len(grams), bool)
    head[1:] = (owner[1:] != owner[:-1]) | (fragment[1:] != fragment[:-1])
    at = np.flatnonzero(head)
    held = np.add.reduceat(words.mix(grams + np.uint64(0x14057B7EF767814F)), at) if len(at) else np.zeros(0, np.uint64)
    return owner[at], fragment[at].astype(np.int64), held, np.diff(np.append(at, len(grams)))


def _fullest(owner: np.ndarray, held: np.ndarray, many: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which segments are among the most[owner] ones of their set that hold the most n-grams, ties by hash; owner ascends."""
    by = np.lexsort((held, -many, owner))
    begin = np.searchsorted(owner, np.arange(len(most)))
    out = np.zeros(len(owner), bool)
    out[by] = np.arange(len(owner)) - begin[owner] < most[owner]
    return out


def _empty_segments(grams: np.ndarray, to: np.ndarray, index: np.ndarray, k: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set's index, key) of the fragments of the first order in which the sets have nothing.

    Two similar sets that no order suits have an equal segment there; if it isn't empty they meet by it anyhow.
    """
    owners, keys = [], []
    for i, n, b in zip(index.tolist(), k.tolist(), band.tolist()):
        own = grams[to[i] : to[i + 1]]
        fragment = np.setdiff1d(np.arange(n), ((own >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32))
        keys.append(words.mix(np.uint64(0x8CB92BA72F3D8DD7) ^ words.mix(np.uint64([b]) * np.uint64(0xA24BAED4963EE407) + fragment.astype(np.uint64))))
        owners.append(np.full(len(fragment), i))
    return np.concatenate(owners), np.concatenate(keys)


def segment_keys(grams: np.ndarray, to: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(set's index, key) of all segments by which the sets can meet similar ones."""
    sizes = np.diff(to)
    own = bands.of(sizes)
    found = []
    for below in range(int(own.max(initial=0)) + 1):
        band = own - below
        here = (sizes > 0) & (band >= 0)
        here[here] &= (below == 0) | (sizes[here] <= bands.reach[band[here]])
        if below and not here.any():
            break
        order = 0
        while here.any():
            index = np.flatnonzero(here)
            spans = [slice(to[i], to[i + 1]) for i in index]
            some = grams if len(index) == len(sizes) else np.concatenate([grams[s] for s in spans])
            offsets = np.concatenate([[0], np.cumsum(sizes[index])])
            k, d = bands.k[band[index]], bands.differ(sizes[index], band[index])
            owner, fragment, held, many = _segments(some, offsets, k, order)
            full = np.bincount(owner, minlength=len(index))
            kept = _fullest(owner, held, many, d + 1)
            owner, fragment, held = owner[kept], fragment[kept], held[kept]
            tag = words.mix(band[index][owner].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(order))
            found.append((index[owner], words.mix(held ^ words.mix(tag + fragment.astype(np.uint64)))))
            here = np.zeros(len(sizes), bool)
            here[index[full <= d]] = True  # k - full empty segments: as many as may be equal in two similar sets
            order += 1
            if order == ORDERS and here.any():
                found.append(_empty_segments(grams, to, np.flatnonzero(here), bands.k[band[here]], band[here]))
                break
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]).view(np.int64)


def _keys(docs: DataFrame, n: int, text: str, bands: Bands) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, grams, to in _sets(batch.column(0), n):
                ids = _set_ids(grams, to)
                if len(seen) > REMEMBER:
                    seen.clear()
                fresh = np.array([i not in seen and not seen.add(i) for i in ids.tolist()], bool) if len(ids) else np.zeros(0, bool)
                if not fresh.all():
                    grams = grams[np.repeat(fresh, np.diff(to))]
                    ids, to = ids[fresh], np.concatenate([[0], np.cumsum(np.diff(to)[fresh])])
                index, keys = segment_keys(grams, to, bands)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids[index])], ["key", "set_id"])

    return docs.select(text).mapInArrow(storage.tidy(task), "key long, set_id long")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, set_id) in order: pairs (a, b) to compare, and (key, a) of all runs of three sets or more.

    Runs may be of any length: only the first and the last set of the run at hand are kept.
    """
    key = first = last = None
    n = 0
    for batch in batches:
        keys, sets = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        if not len(keys):
            continue
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])
        fresh[0] = keys[0] != key or sets[0] != last
        keys, sets = keys[fresh], sets[fresh]
        if not len(keys):
            continue
        begins = np.ones(len(keys), bool)
        begins[1:] = keys[1:] != keys[:-1]
        begins[0] = keys[0] != key
        at = np.maximum.accumulate(np.where(begins, np.arange(len(keys)), -1))
        heads = np.where(at >= 0, sets[at], first if first is not None else 0)
        ordinal = np.arange(len(keys)) - at + np.where(at >= 0, 0, n - 1)
        before = np.concatenate([[last if last is not None else 0], sets[:-1]])
        star, third, more = ordinal >= 1, ordinal == 2, ordinal >= 2
        pairs = np.unique(np.stack([np.concatenate([heads[star], before[more]]), np.concatenate([sets[star], sets[more]])], 1), axis=0)
        runs = np.concatenate([keys[more], keys[third], keys[third]])
        members = np.concatenate([sets[more], before[third], heads[third]])
        none = pa.nulls(len(runs), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], ["a", "b", "key"])
        yield pa.RecordBatch.from_arrays([pa.array(members), none, pa.array(runs)], ["a", "b", "key"])
        key, first, last, n = keys[-1], heads[-1], sets[-1], int(ordinal[-1]) + 1


def _apart():
    """Hamming distance of the sketches of sets a and b."""
    return sum((F.bit_count(F.col(f"a_{p}").bitwiseXOR(F.col(f"b_{p}"))) for p in _SKETCHES), F.lit(0))


def _near(num: int, den: int):
    """Whether sizes and sketches allow sets a and b to be similar."""
    fits = F.greatest("a_size", "b_size") * num <= F.least("a_size", "b_size") * den
    return fits & (_apart() <= F.floor((F.col("a_size") + F.col("b_size")) * (den - num) / F.lit(num + den)))


def _close(pairs: DataFrame, rows: DataFrame, num: int, den: int, work: str) -> DataFrame:
    """The pairs (a, b, a_size, b_size, apart) whose long sketches, too, allow them to be similar; apart is their distance, where there are any."""
    wanted = pairs.select(F.col("a").alias("set_id")).unionAll(pairs.select(F.col("b").alias("set_id"))).distinct()
    long = rows.where(F.length("sketch") > 0).join(wanted, "set_id", "left_semi")
    long = storage.save(long.groupBy("set_id").agg(F.first("sketch").alias("sketch")), f"{work}-long")
    for side in "ab":
        pairs = pairs.join(long.select(F.col("set_id").alias(side), F.col("sketch").alias(f"of_{side}")), side, "left")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, apart = (batch.column(i).to_numpy().copy() for i in (2, 3))
            for i, (a, b) in enumerate(zip(batch.column(4), batch.column(5))):
                if a.is_valid and b.is_valid:
                    apart[i] = _long_apart(a.as_py(), b.as_py())
            near = apart * (num + den) <= (sizes + batch.column(6).to_numpy()) * (den - num)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(6), pa.array(apart)], ["a", "b", "a_size", "b_size", "apart"]).filter(pa.array(near))

    pairs = pairs.select("a", "b", "a_size", F.col("apart").cast("long"), "of_a", "of_b", "b_size")
    return storage.save(pairs.mapInArrow(storage.tidy(task), "a long, b long, a_size long, b_size long, apart long"), f"{work}-close")


def _between(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """The pairs of sets in different components."""
    for side in "ab":
        pairs = pairs.join(joined.select(F.col("node").alias(side), F.col("component").alias(f"__{side}")), side, "left")
    return pairs.where(F.coalesce("__a", "a") != F.coalesce("__b", "b")).drop("__a", "__b")


def _joined(joined: DataFrame, links: DataFrame) -> DataFrame:
    return components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(links))


def _side(known: DataFrame, name: str) -> DataFrame:
    return known.select(F.col("set_id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("size", *_SKETCHES)])


def _verified(pairs: DataFrame, docs: DataFrame, known: DataFrame, n: int, num: int, den: int, doc_id: str, text: str, work: str) -> DataFrame:
    """The pairs (a, b, a_size, b_size) that are similar enough: overlaps counted by fragment, summed by pair."""
    spark = docs.sparkSession
    wanted = pairs.select(F.col("a").alias("set_id")).unionAll(pairs.select(F.col("b").alias("set_id"))).distinct()
    wanted = storage.save(wanted.join(known, "set_id").select(F.col("doc").alias("__wanted"), F.col("set_id").alias("__set")), f"{work}-ids")
    few = wanted.count() <= BROADCAST_IDS
    docs = docs.select(F.col(doc_id).cast("long").alias("__doc"), F.col(text).alias("__text"))
    docs = docs.join(F.broadcast(wanted) if few else wanted, F.col("__doc") == F.col("__wanted"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, grams, to in _sets(batch.column(0), n):
                ids = _set_ids(grams, to)
                meant = ids == batch.column(1).slice(row, stop - row).to_numpy()  # rows may share an id
                if not meant.all():
                    grams, ids = grams[np.repeat(meant, np.diff(to))], ids[meant]
                    to = np.concatenate([[0], np.cumsum(np.diff(to)[meant])])
                owner, part, *_ = _segments(grams, to, np.full(len(to) - 1, PARTS), 0)
                every = np.repeat(np.arange(len(to) - 1), np.diff(to)) * PARTS + (((grams >> np.uint64(32)) * np.uint64(PARTS)) >> np.uint64(32)).astype(np.int64)
                cuts = np.append(np.searchsorted(every, owner * PARTS + part), len(grams)).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(cuts), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(part.astype(np.int32)), held], ["set_id", "part", "grams"])

    segments = docs.select("__text", "__set").mapInArrow(storage.tidy(task), "set_id long, part int, grams array<long>")
    segments = storage.save(segments.withColumn("at", F.xxhash64("set_id", "part")), f"{work}-segments").hint("merge")
    asked = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    asked = asked.withColumns({"at_a": F.xxhash64("a", "part"), "at_b": F.xxhash64("b", "part")})
    # Segments are dealt out by one key for both joins, so that they move once.
    held = segments.select("at", "grams")
    met = asked.join(held, F.col("at_a") == F.col("at")).drop("at").withColumnRenamed("grams", "of_a")
    met = met.join(held, F.col("at_b") == F.col("at"))
    part = met.select("a", "b", "a_size", "b_size", "part", F.size(F.array_intersect("of_a", "grams")).alias("common"))
    # Rows that are repeated whole give a segment, and so its overlap, more than once.
    part = part.groupBy("a", "b", "a_size", "b_size", "part").agg(F.max("common").alias("common"))
    both = part.groupBy("a", "b", "a_size", "b_size").agg(F.sum("common").alias("common"))
    return both.where(F.col("common") * (num + den) >= (F.col("a_size") + F.col("b_size")) * num).select("a", "b")


def similar_groups(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (4, 5), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest id reachable over links, its own included.

    similarity: numerator and denominator of the least Jaccard similarity of two linked documents' n-gram sets.
    """
    return _groups(docs, n, similarity, doc_id, text).select(F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), F.coalesce("least.doc", "doc").alias("component_id"))


def _groups(docs: DataFrame, n: int, similarity: tuple[int, int], doc_id: str, text: str) -> DataFrame:
    """doc, row, size of every row, and least: the smallest (doc, row) of its group, null for a row that is alone for want of an id or n-gram."""
    num, den = similarity
    spark, bands = docs.sparkSession, Bands(num, den)
    storage.small_batches(spark)
    folder = storage.scratch(spark, "ngrams")
    rows = storage.save(classes(docs, n, doc_id, text), f"{folder}/classes")
    present = rows.where("doc is not null and size > 0")
    known = present.groupBy("set_id").agg(F.min("doc").alias("doc"), *[F.first(c).alias(c) for c in ("size", *_SKETCHES)])
    known = storage.save(known, f"{folder}/known")

    with_id = docs.where(F.col(doc_id).isNotNull())
    keys = _keys(with_id, n, text, bands).repartition("key").sortWithinPartitions("key", F.xxhash64("key", "set_id"), "set_id")
    met = storage.save(keys.mapInArrow(_meetings, "a long, b long, key long"), f"{folder}/met")

    pairs = met.where("key is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.join(_side(known, "a"), "a").join(_side(known, "b"), "b").where(_near(num, den))
    seen = storage.save(pairs.select("a", "b", "a_size", "b_size", _apart().alias("apart")), f"{folder}/pairs")
    pairs = _close(seen, rows, num, den, f"{folder}/pairs")
    check = lambda some, name: storage.save(_verified(some, with_id, known, n, num, den, doc_id, text, f"{folder}/{name}"), f"{folder}/{name}-links")
    ways = pairs.select("a", "b", "apart").unionAll(pairs.select(F.col("b"), F.col("a"), "apart"))
    nearest = ways.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("n")).select(F.least("a", "n.b").alias("a"), F.greatest("a", "n.b").alias("b"))
    pairs = pairs.drop("apart")
    first = storage.save(pairs.join(nearest.distinct(), ["a", "b"]), f"{folder}/first")
    joined = storage.save(components(check(first, "verify1")), f"{folder}/joined1")
    second = storage.save(_between(pairs, joined).join(first, ["a", "b"], "left_anti"), f"{folder}/second")
    if not second.isEmpty():
        joined = storage.save(_joined(joined, check(second, "verify2")), f"{folder}/joined2")

    runs = met.where("key is not null").select("key", F.col("a").alias("set_id"))
    labelled = runs.join(joined.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("group", F.coalesce("component", "set_id"))
    mixed = labelled.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("key")
    held = labelled.join(mixed, "key", "left_semi").select("key", "set_id", "group").join(known.drop("doc"), "set_id")
    held = storage.save(held, f"{folder}/mixed")
    if not held.isEmpty():
        one, two = (held.select(*[F.col(c).alias(f"{side}_{c}") for c in held.columns]) for side in "ab")
        apart = (F.col("a_set_id") < F.col("b_set_id")) & (F.col("a_group") != F.col("b_group")) & _near(num, den)
        across = one.join(two, (F.col("a_key") == F.col("b_key")) & apart)
        across = across.select(F.col("a_set_id").alias("a"), F.col("b_set_id").alias("b"), "a_size", "b_size", _apart().alias("apart")).distinct()
        across = storage.save(across.join(seen, ["a", "b"], "left_anti"), f"{folder}/across")
        across = _close(across, rows, num, den, f"{folder}/across").drop("apart")
        if not across.isEmpty():
            joined = storage.save(_joined(joined, check(across, "verify3")), f"{folder}/joined3")

    grouped = rows.select("doc", "row", "set_id", "size").join(joined.withColumnRenamed("node", "set_id"), "set_id", "left")
    # Rows without an id or n-gram stay on their own; their key is any that differs from others'.
    alone = F.col("doc").isNull() | (F.col("size") == 0)
    grouped = grouped.select("doc", "row", "size", F.when(~alone, F.coalesce("component", "set_id")).alias("group"))
    least = grouped.where("group is not null").groupBy("group").agg(F.min(F.struct("doc", "row")).alias("least"))
    out = storage.save(grouped.join(least, "group", "left").select("doc", "row", "size", "least"), f"{folder}-out")
    storage.remove(spark, folder)
    return out


def keep_one(docs: DataFrame, n: int = 5, similarity: tuple[int, int] = (4, 5), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group, that with the smallest id (and text's hash); only rows that repeat both id and text stay or go together."""
    groups = _groups(docs, n, similarity, doc_id, text)
    lost = groups.where(F.struct("doc", "row") != F.col("least")).select(F.col("doc").alias("__lost"), F.col("row").alias("__lost_row")).distinct()
    # Written first, so that Spark knows whether it is small enough to broadcast and texts can stay where they are.
    lost = storage.save(lost, storage.scratch(docs.sparkSession, "lost"))
    return docs.join(lost, (F.col(doc_id).cast("long") == F.col("__lost")) & (F.xxhash64(text) == F.col("__lost_row")), "left_anti")
