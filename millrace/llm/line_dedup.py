"""Line dedup across sites, by DataFrame functions alone.

A line is boilerplate if it stands on `min_sites` distinct sites or more. Each line's hash gathers a
HyperLogLog sketch of its sites, merged by aggregation; lines whose estimate is near the threshold are
counted exactly. Boilerplate stays where it occurs first (smallest doc_id, then first position) and
goes everywhere else, so no line is lost to the corpus.

Defined results: null texts stay null and empty ones empty; lines without a letter or digit are never
boilerplate; a null site is a site of its own; rows that repeat a doc_id with other texts are judged each by its own lines, rows that
repeat both alike; a document may be left with an empty text, and
its row stays; empty tables give empty results; extra columns are kept, but one named lines_removed is replaced. The commonest
boilerplate lines, HOT at most, are spread over SALT places when lines meet them, so that no place takes all of one line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

MIN_SITES = 5
#: Lines that are spread, and the places of each.
HOT, SALT = 1000, 64
#: Sketch size: 2**10 registers, a standard error of about 3 %.
SKETCH_LOG2 = 10
#: Estimates this far around the threshold (relative) are settled by exact counts: over six standard errors.
NEAR = 0.2


def _line_key(line):
    """Two independent hashes stand for a line."""
    return F.xxhash64(line), F.xxhash64(F.lit(1), line)


def lines_of(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """__doc, __text (a hash), __at (from 0), __h1, __h2, __site of every line with a letter or digit."""
    split = docs.select(F.col(doc_id).alias("__doc"), F.xxhash64(text).alias("__text"), F.coalesce(F.col(site).cast("string"), F.lit("\0")).alias("__site"),
                        F.posexplode(F.split(F.col(text), "\n")).alias("__at", "__line"))
    h1, h2 = _line_key(F.trim("__line"))
    lines = split.where(F.col("__line").rlike(r"[\p{L}\p{N}]"))
    return lines.select("__doc", "__text", "__at", "__site", h1.alias("__h1"), h2.alias("__h2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """__h1, __h2 of lines on min_sites distinct sites or more, __first (the smallest doc and place), and __n, how often they occur."""
    spread = lines.groupBy("__h1", "__h2").agg(
        F.hll_sketch_agg("__site", F.lit(SKETCH_LOG2)).alias("__sketch"), F.count("*").alias("__n"),
        F.min(F.struct("__doc", "__at")).alias("__first"),
    )
    spread = spread.where(F.col("__n") >= min_sites).withColumn("__sites", F.hll_sketch_estimate("__sketch"))
    spread = spread.where(F.col("__sites") >= min_sites * (1 - NEAR)).drop("__sketch")
    near = spread.where(F.col("__sites") <= min_sites * (1 + NEAR)).select("__h1", "__h2")
    exact = lines.join(near, ["__h1", "__h2"], "left_semi").groupBy("__h1", "__h2").agg(F.count_distinct("__site").alias("__exact"))
    settled = spread.join(exact, ["__h1", "__h2"], "left")
    return settled.where(F.coalesce("__exact", "__sites") >= min_sites).select("__h1", "__h2", "__first", "__n")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with the boilerplate lines taken out of `text`, and lines_removed (int) beside it."""
    docs = docs.drop("lines_removed")
    lines = lines_of(docs, doc_id, text, site)
    common = storage.save(boilerplate(lines, min_sites), storage.scratch(docs.sparkSession, "boilerplate"))
    hot = common.orderBy(F.desc("__n"), "__h1", "__h2").limit(HOT).select("__h1", "__h2", F.lit(True).alias("__hot"))
    salts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    spread = common.drop("__n").join(F.broadcast(hot), ["__h1", "__h2"], "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64("__doc", "__text"), F.lit(SALT)).cast("int")).otherwise(0)
    lines = lines.join(F.broadcast(hot), ["__h1", "__h2"], "left").withColumn("__salt", salt).drop("__hot")  # HOT rows at most
    doomed = lines.join(spread, ["__h1", "__h2", "__salt"])
    doomed = doomed.where(~F.struct("__doc", "__at").eqNullSafe(F.col("__first")))
    gone = doomed.groupBy("__doc", "__text").agg(F.collect_set("__at").alias("__gone"))
    same = docs[doc_id].eqNullSafe(gone["__doc"]) & F.xxhash64(docs[text]).eqNullSafe(gone["__text"])
    out = docs.join(gone, same, "left").drop("__doc", "__text")
    # A generator holds the split text, so that each line below is looked up and not split anew.
    lines = F.explode(F.array(F.when(F.col("__gone").isNotNull(), F.split(F.col(text), "\n"))))
    out = out.withColumn("__lines", lines)
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    new = F.array_join(F.transform(kept, lambda at: F.get("__lines", at)), "\n")
    whole = F.col("__gone").isNull()
    return out.withColumns({"lines_removed": F.when(whole, 0).otherwise(F.size("__gone")), text: F.when(whole, F.col(text)).otherwise(new)}).drop("__gone", "__lines")
