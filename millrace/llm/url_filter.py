"""URL filters: block and allow rules on host suffixes and path prefixes.

Every distinct url is expanded into (host suffix, path prefix) expressions, only for prefix lengths
that some rule has. Expressions meet rules in an equi-join on a short prefix of their SHA-256 digest;
the full digest then confirms the match, and the longest rule wins.

Defined results: a null url or one without `://` has an empty host and path and fits no rule; repeated
urls are judged once and keep all their rows; rules with a null host or verdict are ignored; empty
tables give empty results; columns other than the named ones play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hexadecimal digits of the digest in the join's key.
SHORT = 8
#: More rules than this are joined by shuffling, without a broadcast.
BROADCAST_RULES = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def _suffixes(host: Column) -> Column:
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def _expression(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """One row for each distinct url: url, host, path, rule (host followed by path), verdict.

    rules: host, path (a prefix, `/` first; empty or null: all), verdict. The longest rule that fits
    wins; of equally long ones that with the longer host, then one that allows.
    """
    host, path = host_and_path(F.col("__url"))
    urls = pages.select(F.col(url).alias("__url")).distinct().withColumns({"__host": host, "__path": path})
    path = F.coalesce("path", F.lit(""))
    rules = rules.where("host is not null and verdict is not null").select(
        F.lower("host").alias("__h"), path.alias("__p"), F.col("verdict").alias("__v"),
        _expression(F.lower("host"), path).alias("__full"),
    ).withColumn("__short", F.substring("__full", 1, SHORT))
    shape = rules.agg(F.collect_set(F.length("__p")).alias("lengths"), F.count("*").alias("n")).first()
    lengths = F.array(*[F.lit(n) for n in sorted(shape["lengths"])]) if shape["n"] else F.array().cast("array<int>")
    if shape["n"] <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    pairs = urls.where("__host != ''").select("__url", "__path", F.explode(_suffixes(F.col("__host"))).alias("__suffix"))
    pairs = pairs.select("__url", "__path", "__suffix", F.explode(lengths).alias("__n")).where("length(__path) >= __n")
    asked = pairs.select("__url", _expression(F.col("__suffix"), F.expr("substring(__path, 1, __n)")).alias("__digest"))
    asked = asked.withColumn("__key", F.substring("__digest", 1, SHORT))
    found = asked.join(rules, (asked["__key"] == rules["__short"]) & (asked["__digest"] == rules["__full"]))
    rank = F.struct(
        (F.length("__h") + F.length("__p")).alias("n"), F.length("__h").alias("h"),
        F.when(F.col("__v") == "allow", 1).otherwise(0).alias("a"), F.concat("__h", "__p").alias("rule"), F.col("__v").alias("v"),
    )
    best = found.groupBy("__url").agg(F.max(rank).alias("__best"))
    out = urls.join(best, "__url", "left")
    return out.select(
        F.col("__url").alias("url"), F.col("__host").alias("host"), F.col("__path").alias("path"),
        F.col("__best.rule").alias("rule"), F.coalesce("__best.v", F.lit(default)).alias("verdict"),
    )


def filter_pages(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All rows of pages with host, path, rule and verdict beside them, each under `url_` (once or oftener) before its name where pages has that."""
    judged = judge(pages.where(F.col(url).isNotNull()), rules, url, default)
    names = {}
    for c in ("host", "path", "rule", "verdict"):
        names[c] = c
        while names[c] in pages.columns:
            names[c] = f"url_{names[c]}"
    judged = judged.select(F.col("url").alias("__judged"), *[F.col(c).alias(n) for c, n in names.items()])
    # Rows without a url meet no verdict, so they stay where they are.
    known = pages.where(F.col(url).isNotNull()).join(judged, F.col("__judged") == F.col(url), "left").drop("__judged")
    values = {"host": F.lit(""), "path": F.lit(""), "rule": F.lit(None).cast("string"), "verdict": F.lit(default)}
    return known.unionByName(pages.where(F.col(url).isNull()).select("*", *[values[c].alias(n) for c, n in names.items()]))
