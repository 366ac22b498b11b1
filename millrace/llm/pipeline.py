"""Corpus pipeline: toxicity, line dedup, near duplicates, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, line_dedup, ngram_join, packing, storage, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model doesn't reject; it is trained on labelled documents among them."""
    model = toxicity.train(docs, storage.read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("not rejected").select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, cross-site boilerplate lines left only where they occur first; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("lines_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group whose five-word shingles are similar by 0.8 or more."""
    return ngram_join.keep_one(docs, n=5, similarity=(4, 5))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is similar to a benchmark item by 0.8 or more."""
    return decontaminate.clean(docs, storage.read_table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 4096 ids."""
    import public_tokenizers

    folder = storage.scratch(spark, "packing")
    placed, _ = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), folder=folder)
    return storage.kept_alone(placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"), folder)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: No SQL: a trained model, a tokenizer and a linear program decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written before the next one reads it, and gone once that has."""
    docs, before = storage.read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = storage.scratch(spark, name)
        docs = storage.save(stage(spark, docs, sf_dir), folder)
        if before:
            storage.remove(spark, before)
        before = folder
    return docs
