"""Language identification: sums over segmentations against every segmentation, and held-out accuracy."""

import numpy as np
import public_tokenizers
import pytest

from millrace.llm import entry, language_id

DATA = "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
ROW = "doc_id long, text string, lang string"


def every_segmentation(unit, chance):
    """(product, pieces) of each way to cut unit."""
    if not unit:
        return [(1.0, [])]
    return [(chance[unit[:n]] * p, [unit[:n], *rest]) for n in range(1, len(unit) + 1) if unit[:n] in chance for p, rest in every_segmentation(unit[n:], chance)]


def test_forward_and_expected_uses_against_all_segmentations():
    rng = np.random.default_rng(5)
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba", b"aba", b"bab", b" ab"]
    model = language_id.Model.even(["one", "two"], pieces)
    model.chance = rng.dirichlet(np.ones(len(pieces)), 2)
    at = {p: int(np.flatnonzero(model.hashes == language_id._span(language_id._sums(language_id._matrix([p])[0]), 0, len(p)))[0]) for p in pieces}
    units = [b" a", b" ab", b" aba", b" babab", b" bbbb", b" abababab"]
    got = model.log_chance(units)
    times = rng.integers(1, 9, len(units)).astype(float)
    for language in (0, 1):
        chance = {p: model.chance[language, at[p]] for p in pieces}
        ways = [every_segmentation(u, chance) for u in units]
        assert got[:, language] == pytest.approx([np.log(sum(p for p, _ in w)) for w in ways])
        uses = np.zeros(len(pieces))
        for n, w in zip(times, ways):
            for p, cut in w:
                for piece in cut:
                    uses[at[piece]] += n * p / sum(q for q, _ in w)
        assert model.expected(units, language, times) == pytest.approx(uses)


def test_held_out_accuracy(spark):
    rows = entry.op11_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 200 and len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) >= 0.99
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_the_language_column_of_held_out_rows_is_no_input(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(300)
    model = language_id.train(docs, VOCABULARY, rows_per_language=50)
    out = language_id.predict(docs.select("doc_id", "text"), model)
    swapped = language_id.predict(docs.withColumn("lang", docs.source).select("doc_id", "text", "lang"), model)
    key = lambda df: sorted((r["doc_id"], r["lang_pred"]) for r in df.collect())
    assert key(out) == key(swapped)


def test_odd_rows(spark):
    en, de = "the and of with that this " * 20, "der und die nicht auch über " * 20
    rows = [(1, en, "en"), (2, de, "de"), (2, de, "de"), (3, None, "en"), (4, "", "de"), (5, "12 34 .,", "en"), (6, en, None), (None, de, None), (7, "日本語", None), (8, "x" * 300_000, None), (9, (en + " ") * 2000, None)]
    docs = spark.createDataFrame([(*r, "old") for r in rows], ROW + ", lang_pred string")
    model = language_id.train(docs, VOCABULARY)
    assert model.languages == ["de", "en"]
    got = {}
    for r in language_id.predict(docs, model).collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert [x for x, _ in got[2]] == ["de", "de"] and got[None][0][0] == "de" and got[1][0][0] == got[6][0][0] == got[9][0][0] == "en"
    assert got[3] == got[4] == got[5] == [("und", 0.0)]
    assert all(p in ("de", "en") and 0 < s <= 1 for k in (7, 8) for p, s in got[k])
    none = language_id.train(docs.limit(0), VOCABULARY)
    assert {tuple(r[-2:]) for r in language_id.predict(docs, none).select("lang_pred", "score").collect()} == {("und", 0.0)}
    assert language_id.predict(docs.limit(0), model).collect() == []


def test_words_that_a_task_no_longer_keeps(monkeypatch):
    model = language_id.Model.even(["a", "b"], language_id.load_pieces(VOCABULARY))
    model.chance = np.random.default_rng(1).dirichlet(np.ones(len(model.hashes)), 2)
    monkeypatch.setattr(language_id, "KNOWN", 3)
    monkeypatch.setattr(language_id, "AT_ONCE", 2)
    known, units = language_id._Known(model), [f" w{i}".encode() for i in range(7)]
    for _ in range(3):
        some = sorted(np.random.default_rng(2).choice(7, 5, replace=False).tolist())
        assert known.of(np.array(some, np.uint64) * np.uint64(11), [units[i] for i in some]) == pytest.approx(model.log_chance([units[i] for i in some]))
