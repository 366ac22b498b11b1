"""Periodic runs of words: stretches that repeat themselves, found by counting matches at each lag.

A run with period q has words that equal those q words later, so lag q has q matches at least (and 12 - q, as no run is
shorter than SHORTEST words) whose first words lie within q words. Matches are counted by lag and block of first words: pairs
of equal words are counted one by one for rare words, and by FFT for words that are frequent in a block (exactly, as counts are
whole numbers). Only lags for which two neighbouring blocks hold matches enough are scanned for islands of matches in a row.
An island at lag q is a run if its first q words are no repetition of a shorter piece; each run is exactly one island.

Words are `[^\\x20\\x09-\\x0D]+` of the whole text, compared as they are. Defined results: null and empty texts have no run
and an empty collapsed text; rows are judged each on their own, so repeated rows and ids and null ids are kept; other
columns are dropped; an empty table gives an empty result. A task holds one text's words at a time beside a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage, words

SHORTEST = 12
#: Texts of up to so many words are counted together, as one block each; longer ones block by block.
ALONE = 4096
#: A word is frequent if it occurs oftener in two neighbouring blocks than this or the FFT's own cost.
FREQUENT = 64
#: Pairs of rare words that are held before they are counted.
PAIRS_AT_ONCE = 1 << 22
_BLANKS = "[ \\t-\\r]+"


def need_of(lag: np.ndarray) -> np.ndarray:
    """How many matches in a row a run with this period has at least."""
    return np.maximum(SHORTEST - lag, lag)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = out = len(self)
        return out


def _frequent(size: int) -> float:
    return max(FREQUENT, (size * np.log2(size + 1)) ** 0.5)


def _by_fft(ids: np.ndarray, frequent: np.ndarray, start: int, block: int) -> np.ndarray:
    """How many words of the block that begins at start equal the one so many words later, for the lags up to block."""
    n = 1 << int(2 * block - 1).bit_length()
    total = np.zeros(n // 2 + 1, complex)
    near, own = ids[start : start + 2 * block], ids[start : start + block]
    for word in frequent.tolist():
        total += np.conj(np.fft.rfft(own == word, n)) * np.fft.rfft(near == word, n)
    return np.rint(np.fft.irfft(total, n)[: block + 1]).astype(np.int64)


def _rare_pairs(group: np.ndarray, place: np.ndarray, alive: np.ndarray, high: np.ndarray | int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first places, lags) of all pairs of equal words; group and place are sorted, alive says from where pairs are counted."""
    step = 0
    while len(alive):
        step += 1
        alive = alive[alive + step < len(group)]
        lag = place[alive + step] - place[alive]
        on = (group[alive + step] == group[alive]) & (lag <= (high[alive] if isinstance(high, np.ndarray) else high))
        alive, lag = alive[on], lag[on]
        yield alive, lag


def _short_lags(ids: np.ndarray, at: np.ndarray, docs: np.ndarray) -> Iterator[tuple[int, int]]:
    """(text, lag) of texts that are one block each, where the lag has enough matches."""
    size = np.diff(at)[docs]
    if not size.sum():
        return
    take = np.concatenate([np.arange(at[d], at[d + 1]) for d in docs.tolist()])
    owner, to = np.repeat(np.arange(len(docs)), size), np.concatenate([[0], np.cumsum(size)])
    word = ids[take]
    group = owner * (int(word.max()) + 1) + word
    order = np.argsort(group, kind="stable")
    group, place = group[order], order - to[owner[order]]
    fresh = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    times = np.diff(np.append(fresh, len(group)))
    often = times > FREQUENT
    slot, high = to[owner[order]], size[owner[order]] // 2
    counts, held, n = np.zeros(to[-1], np.int64), [], 0
    for first, lag in _rare_pairs(group, place, np.flatnonzero(~np.repeat(often, times)), high):
        held.append(slot[first] + lag)
        n += len(lag)
        if n > PAIRS_AT_ONCE:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
            held, n = [], 0
    if n:
        counts += np.bincount(np.concatenate(held), minlength=len(counts))
    heavy = fresh[often]
    of = owner[order[heavy]]
    for d in np.unique(of).tolist():
        own = word[to[d] : to[d + 1]]
        found = _by_fft(own, word[order[heavy[of == d]]], 0, len(own))
        counts[to[d] : to[d + 1]] += found[: len(own)]
    lag = np.arange(to[-1]) - to[owner]
    for i in np.flatnonzero((lag > 0) & (lag <= size[owner] // 2) & (counts >= need_of(lag))).tolist():
        yield int(docs[owner[i]]), int(lag[i])


def _long_lags(ids: np.ndarray) -> Iterator[int]:
    """Lags with enough matches of one long text: lags up to the block's size, each range of lags with blocks of its own."""
    order = np.argsort(ids, kind="stable")
    group, low, high = ids[order], 1, ALONE // 2
    n_words = int(ids.max()) + 1
    while low <= len(ids) // 2:
        blocks, span = -(-len(ids) // high), high - low + 1
        cell, times = np.unique(np.arange(len(ids)) // high * n_words + ids, return_counts=True)
        after = np.searchsorted(cell, cell + n_words)  # the same word in the next block
        after[after == len(cell)] = 0
        both = times + np.where(cell[after] == cell + n_words, times[after], 0)
        often = cell[both > _frequent(high)]
        rare = ~np.isin(order // high * n_words + group, often) if len(often) else np.ones(len(ids), bool)
        counts, held, n = np.zeros(blocks * span, np.int64), [], 0
        for first, lag in _rare_pairs(group, order, np.flatnonzero(rare), high):
            far = lag >= low
            held.append(order[first[far]] // high * span + lag[far] - low)
            n += len(held[-1])
            if n > PAIRS_AT_ONCE:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
                held, n = [], 0
        if n:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
        counts = counts.reshape(blocks, span)
        for b in np.unique(often // n_words).tolist():
            counts[b] += _by_fft(ids, often[often // n_words == b] % n_words, b * high, high)[low:]
        counts[:-1] += counts[1:]
        lags = np.arange(low, high + 1)
        yield from lags[(counts.max(0) >= need_of(lags)) & (lags <= len(ids) // 2)].tolist()
        low, high = high + 1, high * 2


def _islands(ids: np.ndarray, lag: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs with this period."""
    miss = np.flatnonzero(ids[lag:] != ids[:-lag])
    edge = np.concatenate([[-1], miss, [len(ids) - lag]])
    for i in np.flatnonzero(np.diff(edge) > need_of(lag)).tolist():
        start = int(edge[i]) + 1
        root = ids[start : start + lag]
        # With twice its period of words, a run's other periods divide it.
        if not any(lag % p == 0 and np.array_equal(root[lag // p :], root[: -(lag // p)]) for p in _primes(lag)):
            yield start, int(edge[i + 1]) - start + lag, lag


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] if n > 1 else out


def runs_of(ids: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Each text's runs as (start, length, period), by start and period; ids are its words' numbers between the offsets at."""
    size = np.diff(at)
    out: list[list] = [[] for _ in size]
    for d, lag in _short_lags(ids, at, np.flatnonzero((size >= SHORTEST) & (size <= ALONE))):
        out[d] += _islands(ids[at[d] : at[d + 1]], lag)
    for d in np.flatnonzero(size > ALONE).tolist():
        own = ids[at[d] : at[d + 1]]
        own = np.unique(own, return_inverse=True)[1]
        for lag in _long_lags(own):
            out[d] += _islands(own, lag)
    return [sorted(runs) for runs in out]


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, runs (array of start, length, period) and collapsed: its words, without those after a run's first period."""
    storage.small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    run = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
    schema = pa.schema([("doc_id", pa.int64()), ("runs", run), ("collapsed", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, ends in words.chunks(batch.column(1)):
                raw, known = data.tobytes(), _Ids()
                split = [raw[a:b].split() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                at = np.concatenate([[0], np.cumsum([len(w) for w in split])])
                ids = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, at[-1])
                found, collapsed = runs_of(ids, at), []
                for own, runs in zip(split, found):
                    if runs:
                        keep = np.ones(len(own), bool)
                        for start, length, period in runs:
                            keep[start + period : start + length] = False
                        own = [own[i] for i in np.flatnonzero(keep).tolist()]
                    collapsed.append(b" ".join(own).decode())
                flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
                offsets = np.concatenate([[0], np.cumsum([len(runs) for runs in found])]).astype(np.int32)
                held = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row), pa.ListArray.from_arrays(pa.array(offsets), held), pa.array(collapsed, pa.string())], schema=schema)

    return rows.mapInArrow(storage.tidy(task), "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: the first, then the smallest period) and the hashes of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("__best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("__best.start")).alias("start"), F.col("__best.length").alias("length"), (-F.col("__best.period")).alias("period"),
        F.expr("1000 * __best.length div -__best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text, where each text whose id hashes to a multiple of ten repeats a stretch of itself up to its end.

    Of h = crc32(id) and g = h div 10: with n words, a = g % n words stay, and the p = 1 + (n - a) div (3 + g % 8) words from
    there on are repeated for as long as the text was. Built of arrays alone, without a step for each word.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.floor(h / 10).alias("g"), (h % 10 == 0).alias("hit"))
    rows = rows.withColumn("w", F.when(F.col("hit"), F.filter(F.split("text", _BLANKS), lambda x: x != "")))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)")))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    made = F.expr("array_join(slice(concat(slice(w, 1, a), flatten(array_repeat(slice(w, a + 1, p), cast(1 + (n - a) div p as int)))), 1, n), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))
