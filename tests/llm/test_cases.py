"""Odd inputs of each operator, and what plain computations say of them."""

import base64
import gzip
import hashlib
import io
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers

from millrace.llm import ann, decontaminate, entry, line_dedup, ngram_join, packing, secret_scan, token_store, toxicity, url_filter, warc, words

F = ann.F
TEXT = "doc_id long, text string"


# WARC


def _archive(rng, n=60):
    records, parts = [], []
    for i in range(n):
        size = int(rng.choice([0, 5, 300, 5000, 200_000]))
        payload = rng.bytes(size) if i % 2 else b"<p>" * (size // 3)
        payload = payload + (b"\x1f\x8b\x08\x00" if i % 3 == 0 else b"")
        parts.append(warc.encode_record(i, f"http://a/{i}", payload, hashlib.sha1(payload).hexdigest(), None))
        records.append((i, payload))
        if i % 7 == 0:  # members that are no records
            parts += [gzip.compress(b"something else"), gzip.compress(b"WARC/1.1\r\nnothing more\r\n\r\n")]
    return records, b"".join(parts)


@pytest.mark.parametrize("split", [40, 1000, 70_001, 1 << 30])
def test_ranges_own_the_records_that_start_in_them(split):
    records, data = _archive(np.random.default_rng(split))
    found = []
    for begin in range(0, len(data), split):
        for raw in warc.records_in(io.BytesIO(data), len(data), begin, min(begin + split, len(data))):
            row = warc.decode_record(raw)
            found.append((row["page_id"], row["payload"]))
    assert found == records


def test_a_record_that_is_cut_off_is_an_error():
    payload = np.random.default_rng(0).bytes(100_000)
    data = warc.encode_record(1, "u", payload, hashlib.sha1(payload).hexdigest(), None)[:-5000]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records_in(io.BytesIO(data), len(data), 0, len(data)))


def test_archives_of_odd_pages(spark, tmp_path):
    long, short = "x" * 1500, "y" * 10
    rows = [(1, "u", long), (2, None, long), (None, "u", long), (4, "u\r\nv", short), (5, "u", short), (6, "u", None), (7, "u", ""), (2, "again", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = warc.write(pages, f"file://{tmp_path}/a")
    found = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read(spark, files, split_bytes=100).collect())
    assert found == Counter({(1, "revisit", 2, 1500): 1, (2, "response", None, 1500): 2, (None, "revisit", 2, 1500): 1, (4, "response", None, 10): 1, (5, "response", None, 10): 1, (6, "response", None, 0): 1, (7, "response", None, 0): 1})
    empty = warc.write(pages.limit(0), f"file://{tmp_path}/b")
    assert empty.count() == 0 and warc.read(spark, empty).count() == 0


def _stored(head, payload):
    """A foreign record's member in which deflate stores the payload as it is."""
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    text = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Payload-Digest: sha1:%s\r\nX-Page-Id: %d\r\nContent-Length: %d\r\n\r\n" % (digest, head, len(block))
    squeeze = zlib.compressobj(0, zlib.DEFLATED, 31)
    return squeeze.compress(text + block + b"\r\n\r\n") + squeeze.flush()


def _pages_at_every_offset(data, steps):
    for split in steps:
        found = []
        for begin in range(0, len(data), split):
            found += [warc.decode_record(r)["page_id"] for r in warc.records_in(io.BytesIO(data), len(data), begin, min(begin + split, len(data)))]
        yield found


def test_archives_within_records_are_none_of_the_files():
    """Two members in the payload of one that is stored as it is: rows don't depend on where ranges begin."""
    own = lambda i, text: warc.encode_record(i, None, text, hashlib.sha1(text).hexdigest(), None)
    inner = own(98, b"inner " * 30) + own(99, b"innermost " * 20)
    foreign = own(1, b"first") + _stored(2, inner + bytes(range(256))) + own(3, b"third") + _stored(4, inner) + own(5, b"last")
    assert foreign.count(inner) == 2
    for found in _pages_at_every_offset(foreign, range(17, len(foreign) + 1, 31)):
        assert found == [1, 2, 3, 4, 5]
    for at in range(len(foreign)):
        ends = [[warc.decode_record(r)["page_id"] for r in warc.records_in(io.BytesIO(foreign), len(foreign), *span)] for span in ((0, at), (at, len(foreign)))]
        assert ends[0] + ends[1] == [1, 2, 3, 4, 5]


def test_the_writer_makes_no_member_that_holds_another(monkeypatch):
    rng = np.random.default_rng(3)
    inner = warc.encode_record(99, None, b"x" * 50, hashlib.sha1(b"x" * 50).hexdigest(), None)
    noise = rng.integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    payload = noise + inner + noise  # noise is stored as it is, and with it the member
    raw = warc._member([b"x" * 100 + payload])
    assert inner in raw and warc._holds_record(raw)
    member = warc.encode_record(1, "u", payload, hashlib.sha1(payload).hexdigest(), None)
    assert not warc._holds_record(member) and warc.decode_record(zlib.decompress(member, 31))["payload"] == payload
    monkeypatch.setattr(warc, "CHAIN", 0)
    data = member + warc.encode_record(2, None, b"y", hashlib.sha1(b"y").hexdigest(), None)
    for found in _pages_at_every_offset(data, (997, 20_000, 61_000, len(data))):
        assert found == [1, 2]


# Nearest neighbours


def test_vectors_that_take_no_part(spark):
    rows = [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 0.0]), (9, [0.0, 2.0]), (9, [0.0, 2.0])]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in found] == [(1, 1), (2, 2), (3, 9), (4, 9)]
    assert [r["score"] for r in found] == pytest.approx([0, 0, math.sqrt(5), math.sqrt(5)])


def test_no_query_is_left_with_few(spark, monkeypatch):
    """Tight clusters of three and one probe: the probed list holds two candidates at most."""
    monkeypatch.setattr(ann, "TARGET_RECALL", 0.0)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) * 100
    rows = [(i, (centres[i // 3] + rng.normal(size=8) * 0.01).tolist()) for i in range(120)]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0).collect()
    assert Counter(r["query_id"] for r in found) == Counter({i: 10 for i in range(0, 120, 10)})
    vectors = np.array([v for _, v in rows])
    for q in range(0, 120, 10):
        far = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        far[q] = np.inf
        hits = {r["vec_id"] for r in found if r["query_id"] == q} & set(np.argsort(far)[:10].tolist())
        assert len(hits) >= 5


def test_recall_at_larger_scale(spark):
    data = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    good = [r is not None and len(r) > 0 and np.isfinite(np.array(r, float)).all() and np.any(r) for r in table["embedding"]]
    table = table[good]
    ids, vectors = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), float)
    found = {}
    for r in entry.op2_nearest(spark, data).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        far[q] = np.inf
        hits += len(found[ids[q]] & set(ids[np.lexsort((ids, far))[:10]].tolist()))
        total += 10
    assert hits / total >= 0.9


# Decontamination


def best_windows(docs, items, size=5, least=0.8):
    """Every window of every item's length, compared word for word."""
    split = lambda t: [w for w in "".join(c.lower() if c.isalnum() or ord(c) > 127 else " " for c in t or "").split(" ") if w]
    held = {}
    for i, t in items:
        w = split(t)
        part = size if len(w) >= size else len(w)
        if w:
            held.setdefault(part, {})[i] = w
    out = {}
    for part, group in held.items():
        bags = {i: Counter(tuple(w[k : k + part]) for k in range(len(w) - part + 1)) for i, w in group.items()}
        count = Counter(g for bag in bags.values() for g in bag)
        weight = lambda g: 1 + math.log(len(bags) / count[g]) if g in count else 1 + math.log(len(bags))  # noqa: B023, E731
        for doc, t in docs:
            w = split(t)
            grams = [tuple(w[k : k + part]) for k in range(len(w) - part + 1)]
            for i, own in group.items():
                if bags[i].keys().isdisjoint(grams):
                    continue
                n = len(own) - part + 1
                for at in range(len(grams) - n + 1):
                    b = Counter(grams[at : at + n])
                    if not b.keys() & bags[i].keys():
                        continue
                    names = b.keys() | bags[i].keys()
                    s = sum(min(b[g], bags[i][g]) * weight(g) for g in names) / sum(max(b[g], bags[i][g]) * weight(g) for g in names)
                    if s >= least and s > out.get((doc, i), (0, 0))[0] + 1e-12:
                        out[doc, i] = s, at
    return out


def test_windows_against_every_window(spark):
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 300, n)]
    items = [(k, " ".join(word(n))) for k, n in enumerate([1, 2, 4, 5, 6, 9, 15, 22, 30, 40, 60, 60])]
    items.append((12, items[11][1]))  # an item twice under two ids
    docs = []
    for d in range(60):
        own = word(int(rng.integers(0, 40)))
        piece = items[int(rng.integers(len(items)))][1].split()
        for _ in range(int(rng.integers(0, 3))):
            piece[int(rng.integers(len(piece)))] = f"x{rng.integers(99)}"
        docs.append((d, " ".join([*own, *piece, *word(int(rng.integers(0, 20)))]) if d % 9 else " ".join([*piece, *piece])))
    docs += [(60, None), (61, ""), (62, "w1")]
    want = best_windows(docs, items)
    found = decontaminate.find(spark.createDataFrame(docs, TEXT), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): pytest.approx(r["similarity"]) for r in found} == {k: s for k, (s, _) in want.items()}
    assert {(r["doc_id"], r["item_id"]): r["start_word"] for r in found} == {k: at for k, (_, at) in want.items()}


# Toxicity


def test_toxicity_of_odd_labels(spark):
    docs = spark.createDataFrame([(f"d{i}", "vile vile scum" if i % 3 == 0 else f"kind words {i}", 1) for i in range(60)] + [("n", None, 2), ("e", "", None)], "doc_id string, text string, severity int")
    labels = spark.createDataFrame([(f"d{i}", int(i % 3 == 0)) for i in range(50)] + [("d0", 0), (None, 1), ("d1", None), ("none", 1)], "doc_id string, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert {r["doc_id"] for r in scored if r["rejected"]} == {f"d{i}" for i in range(0, 60, 3)}
    alone = toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 1"))).collect()
    assert {(r["severity"], r["grade"], r["rejected"]) for r in alone} == {(1.0, 1, False)}
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


# Secrets


def test_findings_without_or_with_one_label(spark):
    docs = spark.createDataFrame([(1, "password = 1a2b3c4d5e6f7a8b9c0d"), (2, None), (3, ""), (4, "see https://example.com/a/b/12345678")], TEXT)
    found = secret_scan.candidates(docs).cache()
    assert found.count() == 2
    for label, verdict in ((None, {None}), (1.0, {True}), (0.0, {False})):
        rows = secret_scan.scan(found, secret_scan.train(found.withColumn("label", F.lit(label).cast("double")))).collect()
        assert {r["is_secret"] for r in rows} == verdict
    none = found.limit(0).withColumn("label", F.lit(1.0))
    assert secret_scan.scan(found.limit(0), secret_scan.train(none)).count() == 0


# Token store


@pytest.mark.parametrize("n", [0, 1, 2, 64, 5000])
def test_perfect_hash(n, monkeypatch):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    for levels in (40, 1):  # with one level most keys are left to the list
        monkeypatch.setattr(token_store, "LEVELS", levels)
        table = token_store.PerfectHash.build(keys)
        assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
        index = token_store.Index(token_store.encode_index(keys, np.zeros(len(keys), int), np.arange(len(keys)), np.ones(len(keys), int)))
        there, _, offset, _ = index.find(keys)
        assert there.all() and offset.tolist() == list(range(len(keys)))
        other = rng.integers(2**63, 2**64, 3000, dtype=np.uint64)
        assert index.find(other)[0].sum() <= 2


def test_equal_keys_are_refused():
    with pytest.raises(ValueError, match="equal"):
        token_store.encode_index(np.array([5, 5], np.uint64), *(np.zeros(2, int),) * 3)


def test_store_of_odd_documents(spark, tmp_path):
    rows = [(3, "b"), (1, None), (2, ""), (3, "a"), (None, "zero"), (3, "b"), (5, "word " * 30_000)]
    docs = spark.createDataFrame(rows, TEXT)
    path = public_tokenizers.path("byte_bpe_50k.json")
    store = token_store.write(docs, f"file://{tmp_path}/s", path)
    found = token_store.with_crc(token_store.read(spark, store, token_store.keys_of(docs))).orderBy("start").collect()
    assert [(r["doc_id"], r["ordinal"]) for r in found] == [(None, 0), (1, 0), (2, 0), (3, 0), (3, 1), (3, 2), (5, 0)]
    assert [r["n_tokens"] for r in found[1:3]] == [1, 1] and found[4]["ids_crc32"] == found[5]["ids_crc32"]
    asked = spark.createDataFrame([(3, 1), (3, 9), (77, 0)], "doc_id long, ordinal int")
    assert [(r["doc_id"], r["ordinal"]) for r in token_store.read(spark, store, asked).collect()] == [(3, 1)]
    empty = token_store.write(docs.limit(0), f"file://{tmp_path}/e", path)
    assert token_store.read(spark, empty, token_store.keys_of(docs)).count() == 0


# N-gram join


def test_odd_documents_of_the_join(spark):
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (2, "A B C D E"), (9, None), (8, " "), (7, "a b")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], f"{TEXT}, set_id int, doc string")
    found = Counter(tuple(r) for r in ngram_join.similar_groups(docs, 4, (85, 100)).collect())
    assert found == Counter({(None, 2, None): 1, (4, 2, 2): 2, (2, 2, 2): 1, (9, 0, 9): 1, (8, 0, 8): 1, (7, 1, 7): 1})


def test_sets_of_distant_sizes_meet(spark):
    base = [f"w{i}" for i in range(80)]
    rows = [(k, " ".join(base[:n])) for k, n in enumerate((80, 55, 38, 26, 18, 12))]
    found = ngram_join.similar_groups(spark.createDataFrame(rows, TEXT), 1, (2, 3)).collect()
    assert {r["component_id"] for r in found} == {0}
    found = ngram_join.similar_groups(spark.createDataFrame(rows[::2], TEXT), 1, (2, 5)).collect()
    assert {r["component_id"] for r in found} == {0}


def test_many_near_copies_of_one_text(spark):
    """Copies with some words changed each: a run of equal segments holds many components, which only some pairs link."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(300):
        copy = list(base)
        for at in rng.choice(60, 3, replace=False):
            copy[at] = f"x{rng.integers(4)}"
        rows.append((d, " ".join(copy)))
    held = [(d, {*map(tuple, zip(*(t.split()[k:] for k in range(4))))}) for d, t in rows]
    root = list(range(300))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(held, 2):
        if 100 * len(x & y) >= 75 * len(x | y):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    assert 1 < len({top(d) for d in range(300)}) < 300
    found = ngram_join.similar_groups(spark.createDataFrame(rows, TEXT), 4, (75, 100)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {d: top(d) for d in range(300)}


def test_other_texts_under_an_id_stay(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "quite another text is here"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)]
    kept = ngram_join.keep_one(spark.createDataFrame([(*r, "x") for r in rows], f"{TEXT}, doc string")).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([rows[0], rows[2], rows[4], rows[5]])
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    kept = decontaminate.clean(spark.createDataFrame(rows, TEXT), items).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([rows[2], rows[4], rows[5]])


# Packing, lines, urls, hashing


def test_packing_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d"), (3, None), (4, "word " * 9000)], TEXT)
    placed, held = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    rows = placed.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter({1: 2, None: 1, 3: 1, 4: 3}) and held.count() == len(rows)
    assert sum(r["length"] for r in rows if r["doc_id"] == 4) == 9001
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_lines_of_which_one_is_everywhere(spark):
    rows = [(i, f"common\nown {i}\ncommon", f"s{i % 9}", i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lines_removed int")
    out = {r["doc_id"]: (r["text"], r["lines_removed"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert out[0] == ("common\nown 0", 1)
    assert all(out[i] == (f"own {i}", 2) for i in range(1, 400))


def test_urls_beside_clashing_names(spark):
    pages = spark.createDataFrame([(1, None, "a", "b", "r"), (2, "http://X.org/es/a\nb?q", "a", "b", "r")], "page_id long, url string, host string, url_host string, rule string")
    out = {r["page_id"]: r for r in url_filter.filter_pages(pages, spark.createDataFrame(entry.URL_RULES, "host string, path string, verdict string")).collect()}
    assert out[1].asDict() == {"page_id": 1, "url": None, "host": "a", "url_host": "b", "rule": "r", "url_url_host": "", "path": "", "url_rule": None, "verdict": "allow"}
    assert (out[2]["url_url_host"], out[2]["path"], out[2]["url_rule"], out[2]["verdict"]) == ("x.org", "/es/a\nb", "org/es/", "block")


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    texts = pa.array(["one two  three", None, "", "four", "x" * 500 + " y", "ünï côdé"] * 20)
    data, ends = words.buffers(texts)
    whole = words.word_hashes(data, ends)
    monkeypatch.setattr(words, "CHUNK_BYTES", 64)
    for a, b in zip(whole, words.word_hashes(data, ends)):
        assert (a == b).all()
    assert sum(stop - row for row, stop, _, _ in words.chunks(texts)) == len(texts)


@pytest.mark.parametrize("at_once", [1, 7, 1000])
def test_passes_over_the_benchmark_change_nothing(spark, monkeypatch, at_once):
    """Items that share a passage weigh it by the whole benchmark, however many are compared at a time."""
    rng = np.random.default_rng(2)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    shared = word(12)
    items = [(k, " ".join([*word(int(rng.integers(6, 14))), *shared])) for k in range(30)] + [(30, "one two"), (31, "three")]
    docs = []
    for d, (_, text) in enumerate(items * 2):
        piece = text.split()
        if d % 3:
            piece[int(rng.integers(len(piece)))] = "x"
        docs.append((d, " ".join([*word(30), *piece, *word(9)])))
    docs, bench = spark.createDataFrame(docs, TEXT), spark.createDataFrame(items, "item_id long, text string")
    key = lambda rows: {(r["doc_id"], r["item_id"]): (round(r["similarity"], 12), r["start_word"], r["n_words"]) for r in rows}
    whole = key(decontaminate.find(docs, bench, similarity=0.7).collect())
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", at_once)
    monkeypatch.setattr(decontaminate, "SHINGLES_AT_ONCE", 40 * at_once)
    assert len(whole) > 25 and key(decontaminate.find(docs, bench, similarity=0.7).collect()) == whole
