"""Stored tables: a graph that a stream refreshes, changes file by file, clones and loads, and the SQL that says the same.

Tables lie in folders of their own in the shared folder, and are removed when a query's result has been written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import lineage
from millrace.plans.lineage import _D, on_edges
from millrace.sources import loads
from millrace.sources.shared import alone, fresh
from millrace.sources.stored import StoredTable
from millrace.streaming import refresh

Query = Callable[[SparkSession, str], DataFrame]


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


# Three generations of extractions arrive in two goes; the second go is applied twice, and the first one once more, late.


def refreshed(d: DataFrame) -> DataFrame:
    """G26 with a stream: the customers' edges are extracted anew as casts, the orders' lose those of odd keys, and the suppliers have none any more."""
    spark = d.sparkSession
    arrivals, folder, checkpoint = (fresh(spark, name) for name in ("arrivals", "graph", "stream"))
    first = d.withColumns({"source_id": F.col("source_file"), "generation": F.lit(1)})
    none = d.sparkSession.createDataFrame([(None, None, None, None, None, None, None, None, "supplier.sql", 3)], first.schema)
    key = lineage.column_of(F.col("target_col")).try_cast("long")
    again = first.where("source_file = 'customer.sql'").withColumns({"transform_type": F.lit("cast"), "generation": F.lit(2)})
    fewer = first.where((F.col("source_file") == "orders.py") & (key % 2 == 0)).withColumn("generation", F.lit(3))
    old = first.where("source_file = 'orders.py'").withColumn("generation", F.lit(2))
    second = again.unionAll(fewer).unionAll(old).unionAll(none)
    for batch in (first, second):
        batch.write.mode("append").parquet(arrivals)
        refresh.follow(spark, arrivals, first.schema, folder, checkpoint)
    refresh.apply(second, folder)
    refresh.apply(first.where("source_file in ('customer.sql', 'orders.py', 'supplier.sql')"), folder)
    return refresh.read_graph(spark, folder, first).drop("source_id")


_REFRESHED = """select source_col, target_col, case when source_file = 'customer.sql' then 'cast' else transform_type end as transform_type, source_file, expression, source_line, confidence, seq,
  cast(case source_file when 'customer.sql' then 2 when 'orders.py' then 3 else 1 end as integer) as generation
from d where source_file <> 'supplier.sql' and (source_file <> 'orders.py' or cast(split_part(target_col, '.', 2) as bigint) % 2 = 0)"""


def _customers(spark: SparkSession, sf_dir: str) -> StoredTable:
    """Customers in files by ranges of their keys."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows = customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), _cents("c_acctbal").alias("cents"))
    return StoredTable(spark, fresh(spark, "customers")).create(rows.repartitionByRange(16, "id"))


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kept = orders.where("o_custkey % 2 = 0 and o_orderstatus = 'F'")
    return kept.groupBy(F.col("o_custkey").alias("id")).agg(F.sum(_cents("o_totalprice")).alias("spent"), F.count("*").alias("n"))


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10 S15 M01-M06 M09 by files: an UPDATE, a DELETE and a MERGE, of which each rewrites only the files with rows that change."""

    def make() -> DataFrame:
        table = _customers(spark, sf_dir)
        table.delete(F.col("id") % 3 == 0)
        table.update(F.col("cents") < 0, {"cents": F.lit(0), "name": F.concat("name", F.lit(" owes "), F.col("cents").cast("string"))})
        insert = {"id": F.col("s_id"), "name": F.concat(F.lit("new "), F.col("s_n").cast("string")), "cents": -F.col("s_spent")}
        table.merge(_totals(spark, sf_dir), "id", {"cents": F.col("cents") - F.col("s_spent")}, insert, F.col("s_n") >= 8)
        return table.read()

    return alone(spark, make)


_TOTALS = "t as (select o_custkey as id, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as spent, count(*) as n from orders where o_custkey % 2 = 0 and o_orderstatus = 'F' group by 1)"
_CHANGED = f"""with c as (
  select c_custkey as id, case when c_acctbal < 0 then c_name || ' owes ' || cast(round(c_acctbal * 100) as bigint) else c_name end as name, greatest(0, cast(round(c_acctbal * 100) as bigint)) as cents from customer where c_custkey % 3 <> 0
), {_TOTALS}
select c.id, name, cents - coalesce(spent, 0) as cents from c left join t on t.id = c.id where coalesce(n, 0) < 8
union all select id, 'new ' || n, -spent from t where id not in (select id from c)"""


def cloned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies with and without the original's files; all three are changed afterwards, and none shows in another."""

    def make() -> DataFrame:
        table = _customers(spark, sf_dir)
        shallow, deep = table.shallow_clone(fresh(spark, "shallow")), table.deep_clone(fresh(spark, "deep"))
        table.delete(F.col("id") % 5 == 0)
        shallow.update(F.col("id") % 7 == 0, {"cents": F.lit(7)})
        deep.append(deep.read().where("id % 11 = 0"))
        named = {"table": table, "shallow": shallow, "deep": deep}
        out = None
        for name, one in named.items():
            rows = one.read().select(F.lit(name).alias("kind"), "id", "cents")
            out = rows if out is None else out.unionAll(rows)
        return out.unionAll(table.read(0).where("id % 5 = 0").select(F.lit("before"), "id", "cents"))

    return alone(spark, make)


_CLONED = """with c as (select c_custkey as id, cast(round(c_acctbal * 100) as bigint) as cents from customer)
select 'table' as kind, id, cents from c where id % 5 <> 0 union all select 'shallow', id, case when id % 7 = 0 then 7 else cents end from c
union all select 'deep', id, cents from c union all select 'deep', id, cents from c where id % 11 = 0 union all select 'before', id, cents from c where id % 5 = 0"""


def copied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON files of orders, copied in three times while files are added; each counts once, and names its file and source."""

    def make() -> DataFrame:
        files, folder = fresh(spark, "files"), fresh(spark, "loaded")
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
        schema = "o_orderkey long, o_custkey long, o_orderstatus string"
        orders.where("o_orderstatus != 'P'").write.json(f"{files}/2024 open-and.filled")
        counts = [loads.copy_into(spark, folder, files, "json", schema)]
        orders.where("o_orderstatus = 'P'").write.json(f"{files}/later")
        counts += [loads.copy_into(spark, folder, files, "json", schema) for _ in range(2)]
        rows = loads.loaded(spark, folder, schema).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.min(F.endswith("source_file", F.lit(".json"))).alias("named"))
        again = loads.read_files(spark, f"{files}/2024 open-and.filled", "json", schema).groupBy("source_name").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
        out = rows.select(F.lit("copied").alias("kind"), F.col("o_orderstatus").alias("name"), "n", "keys", "named")
        out = out.unionAll(again.select(F.lit("read"), "source_name", "n", "keys", F.lit(True)))
        return out.unionAll(spark.range(1).select(F.lit("third load"), F.lit(None).cast("string"), F.lit(counts[2]).cast("long"), F.lit(None).cast("long"), F.lit(counts[0] > 0 and counts[1] > 0)))

    return alone(spark, make)


_COPIED = """select 'copied' as kind, o_orderstatus as name, count(*) as n, cast(sum(o_orderkey) as bigint) as keys, true as named from orders group by 2
union all select 'read', '2024_open_and_filled', count(*), cast(sum(o_orderkey) as bigint), true from orders where o_orderstatus <> 'P' union all select 'third load', null, 0, null, true"""

_QUERIES: dict[str, tuple[Query, str]] = {
    "g26_stored_refresh": (on_edges(refreshed), f"with {_D} {_REFRESHED}"),
    "x17_copy_on_write": (changed, _CHANGED),
    "x18_clones": (cloned, _CLONED),
    "x19_copy_into": (copied, _COPIED),
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items()}
