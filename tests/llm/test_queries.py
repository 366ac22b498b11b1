"""The queries on a generated table set: against their SQL, and the pipeline end to end."""

import re
from collections import defaultdict

import pytest
import public_tokenizers
from oracle import assert_same
from test_brute_force import groups_by_hand, sets_of
from test_cases import best_windows
from tokenizers import Tokenizer

from millrace.llm import entry, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_sql_says_the_same(spark, name):
    assert_same(entry.queries()[name](spark, DATA), DATA, entry.oracle_sql()[name])


def test_pipeline_packs_what_its_stages_keep(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = stage(spark, kept, DATA).cache()
        assert kept.columns == docs.columns, name
        assert 0 < kept.count() <= before, name
    placed = corpus_pipeline.STAGES[-1][1](spark, kept, DATA).collect()
    assert {r["doc_id"] for r in placed} == {r["doc_id"] for r in kept.select("doc_id").collect()}
    tokens = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    tokens.encode_special_tokens = True
    expected = sum(len(tokens.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in kept.collect())
    assert sum(r["length"] for r in placed) == expected


def _without_boilerplate(docs):
    sites, first = defaultdict(set), {}
    for doc, text, site in sorted(docs, key=lambda r: r[0]):
        for at, line in enumerate((text or "").split("\n")):
            if re.search(r"[^\W_]", line):
                sites[line.strip(" ")].add(site)
                first.setdefault(line.strip(" "), (doc, at))
    common = {line for line, s in sites.items() if len(s) >= 5}
    keep = lambda doc, at, line: line.strip(" ") not in common or first[line.strip(" ")] == (doc, at)
    return {doc: None if text is None else "\n".join(x for at, x in enumerate(text.split("\n")) if keep(doc, at, x)) for doc, text, _ in docs}


def test_pipeline_against_plain_computations(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels, items = spark.read.parquet(f"{DATA}/labels.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    scored = toxicity.score(docs, toxicity.train(docs, labels)).where("not rejected").select("doc_id", "text", "source").collect()
    texts = _without_boilerplate([tuple(r) for r in scored])
    groups = groups_by_hand(list(texts.items()), 5, 4, 5)
    texts = {d: t for d, t in texts.items() if groups[d][1] == d}
    leaks = {d for d, _ in best_windows(list(texts.items()), [(r["item_id"], r["text"]) for r in items])}
    assert leaks
    rows = entry.pipeline(spark, DATA).collect()
    assert {r["doc_id"] for r in rows} == texts.keys() - leaks
    tokens = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    tokens.encode_special_tokens = True
    length = defaultdict(int)
    for r in rows:
        length[r["doc_id"]] += r["length"]
    assert length == {d: len(tokens.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in texts.items() if d not in leaks}


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls everywhere, a repeated row, an id with two texts, no benchmark and no labels; and no documents."""
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    rows = [(1, None, None, None, None), (None, "a text of no id", "en", "s", None), (2, "", "en", None, 0), (3, "one two three four five six", "en", "s", 27), (3, "one two three four five six", "en", "s", 27), (4, "one two three four five six", None, "t", 27), (3, "another text under that id", "en", "s", 26)]
    for n, some in enumerate((rows, [])):
        folder = f"{tmp_path}/{n}"
        spark.createDataFrame(some, schema).write.parquet(f"{folder}/documents.parquet")
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
        found = sorted((r["doc_id"] or 0, r["length"]) for r in entry.pipeline(spark, folder).collect())
        assert [d for d, _ in found] == ([0, 1, 2, 3, 3, 3] if some else [])


def test_shingles_of_the_plain_side():
    assert sets_of("A b", 5) == {("a", "b")} and sets_of(" ", 5) == set()
