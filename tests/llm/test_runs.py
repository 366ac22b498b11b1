"""Periodic runs against every stretch of every period."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from millrace.llm import entry, periodic

DATA = "/root/testdata/sf0.001"
BLANK = re.compile("[^\\x20\\x09-\\x0D]+")


def runs_by_hand(w):
    out = set()
    for q in range(1, len(w) // 2 + 1):
        start = 0
        while start + q < len(w):
            stop = start
            while stop + q < len(w) and w[stop] == w[stop + q]:
                stop += 1
            length = stop - start + q
            if stop > start and length >= max(12, 2 * q) and not any(all(w[i] == w[i + p] for i in range(start, start + length - p)) for p in range(1, q)):
                out.add((start, length, q))
            start = stop + 1
    return sorted(out)


def planted(doc, words):
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digests_by_hand(doc, words):
    runs = runs_by_hand(words)
    keep = [True] * len(words)
    for start, length, period in runs:
        keep[start + period : start + length] = [False] * (length - period)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc, len(runs), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for w, k in zip(words, keep) if k)))


def _texts(rng, size):
    """Words of a small alphabet, with repeated stretches and words that are most of a text."""
    for kind in range(40):
        n = int(rng.integers(0, size))
        w = rng.integers(0, [2, 3, 50, 1000][kind % 4], n)
        for _ in range(int(rng.integers(0, 4))):
            if n > 20:
                a, p = int(rng.integers(0, n - 12)), int(rng.integers(1, n // 3))
                length = min(n - a, int(p * rng.uniform(1.5, 5)))
                w[a : a + length] = np.resize(w[a : a + p], length)
        yield w


@pytest.mark.parametrize("alone", [0, 8, 64, 4096])
def test_runs_of_random_texts(monkeypatch, alone):
    monkeypatch.setattr(periodic, "ALONE", max(16, alone))
    monkeypatch.setattr(periodic, "FREQUENT", 4)
    monkeypatch.setattr(periodic, "PAIRS_AT_ONCE", 100)
    monkeypatch.setattr(periodic, "_frequent", lambda size: 4)
    texts = list(_texts(np.random.default_rng(alone), 260))
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = periodic.runs_of(np.concatenate(texts).astype(np.int64), at)
    assert any(found)
    for text, runs in zip(texts, found):
        assert runs == runs_by_hand(text.tolist())


def test_a_very_long_text():
    """No quadratic step: 400,000 words, one stretch of them a repetition of 30,000."""
    w = np.random.default_rng(3).zipf(1.3, 400_000) % 50_000
    w[100_000:175_000] = np.resize(w[100_000:130_000], 75_000)
    w[99_999], w[175_000] = 60_000, 60_001
    (runs,) = periodic.runs_of(w.astype(np.int64), np.array([0, len(w)]))
    assert (100_000, 75_000, 30_000) in runs
    for start, length, period in runs:
        assert (w[start : start + length - period] == w[start + period : start + length]).all()


def test_query_against_plain_computation(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    short = {d for d, t in docs.items() if len(BLANK.findall(t or "")) <= 700}
    assert len(short) > 100
    rows = entry.op12_periodic_runs(spark, DATA).collect()
    assert len(rows) == len(docs)
    assert sum(r["n_runs"] for r in rows) > 10
    for r in rows:
        if r["doc_id"] in short:
            assert tuple(r) == digests_by_hand(r["doc_id"], planted(r["doc_id"], BLANK.findall(docs[r["doc_id"]] or "")))


def test_odd_rows(spark):
    again = " ".join(["a b c"] * 6)
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, again), (4, again), (4, again), (5, "x " * 12), (6, "x " * 11), (7, "Ä ä " * 7), (8, "a a " * 12)]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, collapsed string, period int")
    found = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.find(docs).collect()]
    whole = ([(0, 18, 3)], "a b c")
    want = [(1, [], ""), (2, [], ""), (3, [], ""), (None, *whole), (4, *whole), (4, *whole), (5, [(0, 12, 1)], "x"), (6, [], "x " * 10 + "x"), (7, [(0, 14, 2)], "Ä ä"), (8, [(0, 12, 1)], "a a")]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert periodic.digests(periodic.find(docs.limit(0))).collect() == []
    made = periodic.with_planted_runs(docs.limit(0)).columns
    assert made == ["doc_id", "text"]
