"""Token ids of documents in binary shards, with a minimal perfect hash index over their keys.

A shard file is a header (8 bytes of magic, one byte: bytes per id) and raw little-endian ids, documents
in ascending order of doc_id. Index files hold, for a share of all keys each, a minimal perfect hash: levels of
bits in which a key owns the position that no other key left at that level hashes to; the number of bits
before it is the key's slot, and the slot keeps a fingerprint, shard, offset and length. A lookup takes a
bounded number of probes and one read, whatever the number of documents. Files of lost attempts are in
no manifest and never read.

Defined results: a null or empty text has its end id alone; rows without an id come first; rows that
repeat an id are kept in order of their texts and addressed by (doc_id, ordinal), ordinal from 0; an
empty table gives no shard and no rows; other columns are ignored.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage, words
from .tokens import encoder

MAGIC = b"MRTOKEN1"
HEADER = len(MAGIC) + 1
#: Keys of an index file, about.
KEYS_PER_INDEX = 1 << 16
#: Bits of a level for each key that is left, and levels.
SPARE, LEVELS = 2, 40
_BATCH_BYTES = 2 << 20
_PLACE = "doc_id long, ordinal int, key long, shard int, offset long, n long, path string, width int"


def key_hash(doc_id: np.ndarray, missing: np.ndarray, ordinal: np.ndarray) -> np.ndarray:
    """64-bit keys; for ordinal 0 no two ids share one."""
    h = words.mix(np.where(missing, 0, doc_id).astype(np.int64).view(np.uint64))
    h = np.where(missing, words.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), h)
    return np.where(ordinal == 0, h, words.mix(h + ordinal.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


class PerfectHash:
    """Slots 0..n-1 for n distinct 64-bit keys."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.ranks, self.rest = sizes, bits, ranks, rest
        self.begins = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (words.mix(keys + np.uint64((0xC2B2AE3D27D4EB4F * (2 * level + 1)) % 2**64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        for level in range(LEVELS):
            if not len(keys):
                break
            size = -(-SPARE * len(keys) // 64) * 64
            at = cls._at(keys, level, size)
            count = np.bincount(at, minlength=size)
            sizes.append(size)
            levels.append(count == 1)
            keys = keys[count[at] != 1]
        bits = np.concatenate([*levels, np.zeros(0, bool)])
        ranks = np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(1))]).astype(np.int64)
        return cls(np.array(sizes, np.int64), np.packbits(bits), ranks, np.sort(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key it was built of; any slot, or -1, for other keys."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            at = self.begins[level] + self._at(keys[left], level, size)
            hit = (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            at = at[hit]
            block = self.bits.reshape(-1, 8)[at >> 6]
            within = np.unpackbits(block, axis=1) & (np.arange(64)[None, :] < (at & 63)[:, None])
            out[left[hit]] = self.ranks[at >> 6] + within.sum(1)
            left = left[~hit]
        if len(self.rest) and len(left):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            same = self.rest[at] == keys[left]
            out[left[same]] = self.ranks[-1] + at[same]
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (words.mix(keys ^ np.uint64(0x27D4EB2F165667C5)) >> np.uint64(32)).astype(np.uint32)


def encode_index(keys: np.ndarray, shard: np.ndarray, offset: np.ndarray, n: np.ndarray) -> bytes:
    table = PerfectHash.build(keys)
    slot = table.slots(keys)
    if len(np.unique(slot)) != len(keys):
        raise ValueError("two keys of the index are equal: rows that share an id and an ordinal, or ids whose keys collide")
    at = np.empty(len(keys), np.int64)
    at[slot] = np.arange(len(keys))
    out = io.BytesIO()
    for x in (table.sizes, table.bits, table.ranks, table.rest, _fingerprint(keys)[at], shard[at].astype(np.int32), offset[at], n[at]):
        np.save(out, x)
    return out.getvalue()


class Index:
    def __init__(self, data: bytes):
        held = io.BytesIO(data)
        x = [np.load(held) for _ in range(8)]
        self.table, self.prints, self.shard, self.offset, self.n = PerfectHash(*x[:4]), *x[4:]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is there, and its shard, offset and number of ids."""
        slot = self.table.slots(keys)
        there = slot >= 0
        safe = np.where(there, slot, 0)
        if not len(self.prints):
            return np.zeros(len(keys), bool), safe, safe, safe
        there &= self.prints[safe] == _fingerprint(keys)
        return there, self.shard[safe], self.offset[safe], self.n[safe]


@dataclass
class Store:
    """Manifests: shards (shard, path, width, total, base: ids before it) and indexes (part, path)."""

    shards: DataFrame
    indexes: DataFrame
    parts: int


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> Store:
    """Write shards and index below folder (a URI all executors can write)."""
    spark = docs.sparkSession
    storage.make_dir(spark, folder)
    storage.small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("__doc"), F.col(text).alias("__text"))
    rows = rows.repartitionByRange("__doc").sortWithinPartitions(F.asc_nulls_first("__doc"), F.asc_nulls_first("__text"))

    def shard_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        fs, root = storage.file_system(folder)
        name, out, at = f"shard-{shard:06d}-{uuid.uuid4().hex}.ids", None, 0
        last, ordinal = (None, None), 0
        try:
            for batch in batches:
                for row, stop, data, ends in words.chunks(batch.column(1)):
                    if out is None:
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                        out.write(MAGIC + bytes([enc.dtype.itemsize]))
                    part = batch.column(0).slice(row, stop - row)
                    ids, cuts = enc.encode(data, ends)
                    out.write(np.insert(ids, cuts[1:], end_id).tobytes())
                    n = np.diff(cuts) + 1
                    ordinals = []
                    for i in part.to_pylist():
                        ordinal = ordinal + 1 if last == (True, i) else 0
                        last = (True, i)
                        ordinals.append(ordinal)
                    missing = part.is_null().to_numpy(zero_copy_only=False)
                    keys = key_hash(part.fill_null(0).to_numpy(), missing, np.array(ordinals, np.int64))
                    begin = at + np.cumsum(n) - n
                    at += int(n.sum())
                    same = lambda x, t: pa.array([x] * len(n), t)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [part, pa.array(ordinals, pa.int32()), pa.array(keys.view(np.int64)), same(shard, pa.int32()), pa.array(begin), pa.array(n), same(f"{folder}/{name}", pa.string()), same(enc.dtype.itemsize, pa.int32())],
                        ["doc_id", "ordinal", "key", "shard", "offset", "n", "path", "width"],
                    )
        finally:
            enc.forget()
        if out is not None:
            out.close()

    places = storage.save(rows.mapInArrow(storage.tidy(shard_task), _PLACE), f"{folder}/places")
    shards = places.groupBy("shard", "path", "width").agg(F.sum("n").alias("total"), F.count("*").alias("docs"))
    # A row for each shard, so one task can order them.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = storage.save(shards.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0))), f"{folder}/shards")
    parts = max(1, -(-(shards.agg(F.sum("docs")).first()[0] or 0) // KEYS_PER_INDEX))
    keyed = places.select(_part(parts), "key", "shard", "offset", "n")

    def index_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = storage.file_system(folder)

        def flush(part: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            name = f"index-{part:06d}-{uuid.uuid4().hex}.mph"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(encode_index(t["key"].to_numpy().view(np.uint64), *(t[c].to_numpy() for c in ("shard", "offset", "n"))))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "index_path": [f"{folder}/{name}"]})

        now, held = None, []
        for batch in batches:
            part = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b > a:
                    if held and part[a] != now:
                        yield flush(now, held)
                        held = []
                    now = int(part[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield flush(now, held)

    indexes = keyed.repartition("part").sortWithinPartitions("part").mapInArrow(index_task, "part long, index_path string")
    return Store(shards, storage.save(indexes, f"{folder}/indexes"), parts)


def _part(parts: int):
    return F.pmod(F.shiftrightunsigned("key", 7), F.lit(parts)).cast("long").alias("part")


def read(spark: SparkSession, store: Store, keys: DataFrame) -> DataFrame:
    """doc_id, ordinal, start (ids of all documents before), ids (little-endian, 32 bits each) of the wanted keys (doc_id, ordinal) that are there."""
    def hash_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            missing = b.column(0).is_null().to_numpy(zero_copy_only=False)
            key = key_hash(b.column(0).fill_null(0).to_numpy(), missing, b.column(1).to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key.view(np.int64))], ["doc_id", "ordinal", "key"])

    keys = keys.select(F.col("doc_id").cast("long"), F.col("ordinal").cast("int"))
    asked = keys.mapInArrow(hash_task, "doc_id long, ordinal int, key long").select("doc_id", "ordinal", "key", _part(store.parts))
    asked = asked.join(store.indexes, "part").select("doc_id", "ordinal", "key", "index_path")
    asked = asked.repartition("index_path").sortWithinPartitions("index_path")

    def find_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, index = None, None
        for batch in batches:
            paths = batch.column(3).to_pylist()
            a = 0
            while a < len(paths):
                b = a + 1
                while b < len(paths) and paths[b] == paths[a]:
                    b += 1
                if paths[a] != path:
                    path = paths[a]
                    fs, name = storage.file_system(path)
                    with fs.open_input_file(name) as f:
                        index = Index(f.read())
                part = batch.slice(a, b - a)
                there, shard, offset, n = index.find(part.column(2).to_numpy().view(np.uint64))
                found = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shard.astype(np.int32)), pa.array(offset.astype(np.int64)), pa.array(n.astype(np.int64))], ["doc_id", "ordinal", "shard", "offset", "n"])
                yield found.filter(pa.array(there))
                a = b

    found = asked.mapInArrow(find_task, "doc_id long, ordinal int, shard int, offset long, n long")
    found = found.join(store.shards.select("shard", "path", "width", "base"), "shard")
    found = found.select("doc_id", "ordinal", "path", "offset", "n", "width", (F.col("base") + F.col("offset")).alias("start"))
    found = found.repartition("path", F.floor(F.col("offset") / (1 << 22))).sortWithinPartitions("path", "offset")

    def read_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None

        def rows(part: list, ids: list) -> pa.RecordBatch:
            cols = list(zip(*part))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ordinal", "start", "ids"])

        for batch in batches:
            part, ids, held = [], [], 0
            for doc, ordinal, name, offset, n, width, start in zip(*(c.to_pylist() for c in batch.columns)):
                if name != path:
                    if f is not None:
                        f.close()
                    fs, local = storage.file_system(name)
                    path, f = name, fs.open_input_file(local)
                    if f.read_at(HEADER, 0) != MAGIC + bytes([width]):
                        raise ValueError(f"{name} is no shard of {width}-byte ids")
                raw = f.read_at(n * width, HEADER + offset * width)
                part.append((doc, ordinal, start))
                ids.append(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())
                held += len(ids[-1])
                if held > _BATCH_BYTES:
                    yield rows(part, ids)
                    part, ids, held = [], [], 0
            if part:
                yield rows(part, ids)

    return found.mapInArrow(read_task, "doc_id long, ordinal int, start long, ids binary")


def keys_of(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ordinal) of every row."""
    n = docs.groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.count("*").cast("int").alias("n"))
    return n.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ordinal"))


def with_crc(rows: DataFrame) -> DataFrame:
    """ids_crc32 (unsigned) and n_tokens in place of ids."""
    return rows.withColumns({"n_tokens": (F.octet_length("ids") / 4).cast("long"), "ids_crc32": F.crc32("ids")}).drop("ids")
