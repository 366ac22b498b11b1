"""Temporary views taken out of an edge relation: what makes a view's column makes what is made of it.

Views are those of all edges (a list of names) or of one file each (a relation of source_file and view); names are compared
in lower case. A column of a view is looked up by these rules, the first that has an entry alone:
its own entries; for `v.*`, the entries of all columns of v; for a named column, the entries of `v.*`, of which `p.*` stands for
p's column of that name, and a named source counts only if its column has that name.

All views of all files are resolved at once, from each asked column towards its sources, as rounds of equi-joins over the edges into
views alone; rounds end with the longest chain of views, whatever the number of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import lineage
from millrace.operators.lineage import column_of, table_of
from millrace.sources.shared import Work, cut, union

_CHAIN = "struct<rank: int, depth: int, transform: string, expression: string>"


def priority(transform: Column) -> Column:
    """As lineage.priority; transforms that it doesn't know (filters, join keys) tell as little as a passthrough."""
    return F.greatest(lineage.priority(transform), F.lit(1))


def _marked(edges: DataFrame, views: DataFrame | list[str]) -> tuple[DataFrame, DataFrame]:
    """edges with __scope and whether each end is a view's column, and the views (__scope, __view)."""
    spark = edges.sparkSession
    if isinstance(views, DataFrame):
        scope, known = F.col("source_file"), views.select(F.col("source_file").alias("__scope"), F.lower("view").alias("__view"))
    else:
        scope, known = F.lit(""), spark.createDataFrame([("", v.lower()) for v in views], "__scope string, __view string")
    known = cut(known.where("__scope is not null and __view is not null").distinct())  # so that few are broadcast
    out = edges.withColumn("__scope", scope)
    if not isinstance(views, DataFrame):
        within = lambda end: F.contains(end, F.lit(".")) & F.lower(table_of(F.col(end))).isin([v.lower() for v in views])
        return out.withColumns({"__from": F.coalesce(within("source_col"), F.lit(False)), "__to": F.coalesce(within("target_col"), F.lit(False))}), known
    for end, name in (("source_col", "__from"), ("target_col", "__to")):
        one = known.select("__scope", F.col("__view").alias("__table"), F.lit(True).alias(name))
        out = out.withColumn("__table", F.lower(table_of(F.col(end)))).join(one, ["__scope", "__table"], "left").drop("__table")
        out = out.withColumn(name, F.coalesce(name, F.lit(False)) & F.contains(end, F.lit(".")))
    return out, known


def _step(asked: DataFrame, entries: DataFrame, known: DataFrame) -> DataFrame:
    """asked (__scope, at) with the sources of `at` (next) and the edge they come by; none where the rules have none."""
    keys = entries.select("__scope", F.col("key").alias("at")).distinct().withColumn("own", F.lit(True))
    asked = asked.join(keys, ["__scope", "at"], "left").withColumn("table", table_of(F.col("at")))
    exact = asked.where("own").join(entries.withColumnRenamed("key", "at").drop("table"), ["__scope", "at"])
    every = asked.where("own is null and endswith(at, '.*')").join(entries.drop("key"), ["__scope", "table"])
    named = asked.where("own is null and not endswith(at, '.*')").withColumn("key", F.concat("table", F.lit(".*"))).join(entries.drop("table"), ["__scope", "key"])
    star = F.endswith(F.col("next"), F.lit(".*"))
    own_name = F.when(star, F.concat(table_of(F.col("next")), F.lit("."), column_of(F.col("at")))).when(column_of(F.col("next")) == column_of(F.col("at")), F.col("next"))
    named = named.withColumn("next", own_name).where("next is not null")
    columns = [c for c in asked.columns if c not in ("own", "table")] + ["next", "edge"]
    return union([part.select(columns) for part in (exact, every, named)])


def _deeper(chain: Column, edge: Column, depth: int) -> Column:
    """Of a chain and the edge before it the more telling; of equal ones the deeper."""
    here = F.struct(edge["rank"].alias("rank"), F.lit(depth).alias("depth"), edge["transform"].alias("transform"), edge["expression"].alias("expression")).cast(_CHAIN)
    return F.when(chain.isNull() | (edge["rank"] >= chain["rank"]), here).otherwise(chain)


def sources_of(asked: DataFrame, entries: DataFrame, known: DataFrame) -> DataFrame:
    """__scope, start, up, chain: the sources outside of views of each asked view column (__scope, start), with the best of the chains to them.

    A column that nothing writes is its own source, where a chain ends there. Going in circles ends: what was reached is gone through
    again only if by a more telling chain.
    """
    with Work(asked.sparkSession) as work:
        entries = work.cut(entries)
        front = work.cut(asked.distinct().select("__scope", "start", F.col("start").alias("at"), F.lit(None).cast(_CHAIN).alias("chain")))
        seen, ends, depth = front, [], 0
        tables = known.select("__scope", F.col("__view").alias("table"), F.lit(True).alias("inner"))
        written = entries.select("__scope", "key").distinct()
        while not front.isEmpty():
            depth += 1
            met = _step(front, entries, known).withColumn("chain", _deeper(F.col("chain"), F.col("edge"), depth))
            met = met.groupBy("__scope", "start", F.col("next").alias("at")).agg(F.max("chain").alias("chain"))
            met = met.withColumn("table", table_of(F.col("at"))).join(tables, ["__scope", "table"], "left").drop("table")
            # Of views' columns those that no rule finds an entry for end a chain, too.
            met = work.cut(_resolvable(met, written))
            ends.append(met.where("inner is null or not found").select("__scope", "start", F.col("at").alias("up"), "chain"))
            before = seen.groupBy("__scope", "start", "at").agg(F.max(F.coalesce("chain.rank", F.lit(-1))).alias("rank"))
            front = met.where("inner and found").join(before, ["__scope", "start", "at"], "left").where("rank is null or chain.rank > rank")
            front = work.cut(front.select("__scope", "start", "at", "chain"))
            seen = work.cut(seen.unionAll(front)) if depth % 8 == 0 else seen.unionAll(front)
        found = union(ends) if ends else front.select("__scope", "start", F.col("at").alias("up"), "chain")
        return cut(found.groupBy("__scope", "start", "up").agg(F.max("chain").alias("chain")))


def _resolvable(met: DataFrame, written: DataFrame) -> DataFrame:
    """met with `found`: whether the rules know entries for `at` (which may still have no source of its name)."""
    own = written.select("__scope", F.col("key").alias("at"), F.lit(True).alias("own"))
    whole = written.where("endswith(key, '.*')").select("__scope", F.col("key").alias("star"), F.lit(True).alias("starred"))
    every = written.select("__scope", F.concat(table_of(F.col("key")), F.lit(".*")).alias("at"), F.lit(True).alias("any")).distinct()
    out = met.withColumn("star", F.concat(table_of(F.col("at")), F.lit(".*")))
    out = out.join(own, ["__scope", "at"], "left").join(whole, ["__scope", "star"], "left").join(every, ["__scope", "at"], "left")
    return out.select(*met.columns, F.coalesce("own", "starred", "any", F.lit(False)).alias("found"))


def inline_views(edges: DataFrame, views: DataFrame | list[str]) -> DataFrame:
    """Edges without those into views; an edge from a view's column stands once for each source of that column outside of views.

    Such an edge keeps its own file, line and confidence. Its transform and expression are the most telling along the chain, its own
    unless another is strictly better; of equal ones in a chain the deepest counts. `v.* -> t.*` stands for an edge into
    `t.c` of each named column c of v as well. An edge whose view column has no source (nothing writes it, or only views that feed
    themselves do) stays as it is. Sources that are put in are in lower case.
    """
    marked, known = _marked(edges, views)
    into = marked.where("__to")
    edge = F.struct(priority(F.col("transform_type")).alias("rank"), F.col("transform_type").alias("transform"), F.col("expression").alias("expression")).alias("edge")
    entries = into.select("__scope", F.lower("target_col").alias("key"), F.lower(table_of(F.col("target_col"))).alias("table"), F.lower("source_col").alias("next"), edge)
    used = marked.where("__from and not __to")
    both_stars = F.endswith("source_col", F.lit(".*")) & F.endswith("target_col", F.lit(".*"))
    asked = used.select("__scope", F.lower("source_col").alias("start"))
    starred = used.where(both_stars).select("__scope", F.lower(table_of(F.col("source_col"))).alias("table")).distinct()
    columns = entries.where("not endswith(key, '.*')").join(starred, ["__scope", "table"], "left_semi").select("__scope", F.col("key").alias("start"))
    sources = sources_of(asked.unionAll(columns), entries, known)
    rest = marked.where("not __to")
    # Edges from no view's column have nothing to be joined with, and stay where they are.
    plain = rest.where("__from").withColumn("start", F.lower("source_col")).join(sources, ["__scope", "start"], "left")
    plain = plain.withColumn("source_col", F.coalesce("up", "source_col"))
    other = rest.where("not __from").withColumn("chain", F.lit(None).cast(_CHAIN))
    named = sources.where("not endswith(start, '.*')").withColumn("table", table_of(F.col("start")))
    wide = rest.where(F.col("__from") & both_stars).withColumn("table", F.lower(table_of(F.col("source_col")))).join(named, ["__scope", "table"])
    wide = wide.withColumn("source_col", F.col("up")).withColumn("target_col", F.concat(table_of(F.col("target_col")), F.lit("."), column_of(F.col("start"))))
    # `start` may be asked by others without being written: only columns with an entry of their own are v's.
    keys = cut(entries.select("__scope", F.col("key").alias("start")).distinct())
    wide = wide.join(keys, ["__scope", "start"], "left_semi")
    better = F.coalesce(F.col("chain.rank") > priority(F.col("transform_type")), F.lit(False))
    out = union([part.select(*edges.columns, "chain") for part in (plain, other, wide)])
    # Both at once: each looks at the transform that was.
    out = out.withColumns({"transform_type": F.when(better, F.col("chain.transform")).otherwise(F.col("transform_type")), "expression": F.when(better, F.col("chain.expression")).otherwise(F.col("expression"))})
    return out.select(edges.columns)
