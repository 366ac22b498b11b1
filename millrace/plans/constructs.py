"""Executable constructs: each query runs a family of relational constructs on the order tables, beside the SQL that says the same.

Sums are over whole numbers (quantities, cents), so that both engines give the same digits in any order of rows. The
comments name the rows of the operator inventory that a query covers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.shared import alone, cut, fresh, setting

Query = Callable[[SparkSession, str], DataFrame]
#: By how much an approximate count of distinct values may err, as a relative standard deviation.
APART = 0.01


def _read(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names]


def _cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns, computed columns and a predicate, all of which reach the scan."""
    (orders,) = _read(spark, sf_dir, "orders")
    kept = orders.where((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")) & F.col("o_orderpriority").like("1-%"))
    return kept.select("o_orderkey", F.upper(F.substring("o_orderpriority", 3, 20)).alias("priority"), (_cents("o_totalprice") * 2).alias("double_cents"), F.year("o_orderdate").alias("year"))


PROJECT_FILTER = """select o_orderkey, upper(substring(o_orderpriority, 3, 20)) as priority, cast(round(o_totalprice * 100) as bigint) * 2 as double_cents, cast(year(o_orderdate) as integer) as year
from orders where o_orderstatus = 'F' and o_orderdate >= timestamp '1996-01-01' and o_orderpriority like '1-%'"""


def star_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of a derived table, a struct's field, and a union of branches by position."""
    nation, supplier = _read(spark, sf_dir, "nation", "supplier")
    part = nation.where("n_regionkey < 3").select("*", F.struct(F.col("n_name").alias("name"), F.length("n_name").alias("size")).alias("info"))
    named = part.select("n_nationkey", "n_regionkey", F.col("info.name").alias("name"), F.col("info.size").alias("size"))
    return named.unionAll(supplier.select(F.col("s_suppkey").cast("int"), F.col("s_nationkey"), "s_name", F.length("s_name")))


STAR_DERIVED = """select n_nationkey, n_regionkey, info.name as name, cast(info.size as integer) as size from (select *, {'name': n_name, 'size': length(n_name)} as info from (select * from nation where n_regionkey < 3))
union all select cast(s_suppkey as integer), s_nationkey, s_name, cast(length(s_name) as integer) from supplier"""


def having_qualify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups kept by their aggregate, then the first of each by a window."""
    (orders,) = _read(spark, sf_dir, "orders")
    each = orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.sum(_cents("o_totalprice")).alias("cents")).where("n >= 2")
    first = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("cents"), "o_custkey"))
    return each.withColumn("place", first).where("place <= 5")


HAVING_QUALIFY = """select o_custkey, o_orderpriority, count(*) as n, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents,
  cast(row_number() over (partition by o_orderpriority order by sum(cast(round(o_totalprice * 100) as bigint)) desc, o_custkey) as integer) as place
from orders group by 1, 2 having count(*) >= 2 qualify place <= 5"""


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline values and a temporary view go into a table by CREATE AS, INSERT and a writer, and are read back."""
    (nation,) = _read(spark, sf_dir, "nation")
    name = f"millrace_{uuid.uuid4().hex}"

    def make() -> DataFrame:
        nation.where("n_nationkey < 5").createOrReplaceTempView(f"{name}_view")
        try:
            spark.sql(f"create table {name} using parquet location '{fresh(spark, 'table')}' as select n_nationkey as id, n_name as name, 'view' as made from {name}_view")
            spark.sql(f"insert into {name} select * from values (100, 'one hundred', 'values'), (101, null, 'values') as v(id, name, made)")
            nation.where("n_nationkey >= 20").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("writer").alias("made")).write.insertInto(name)
            return cut(spark.table(name).where("id != 101 or name is null"))
        finally:
            spark.sql(f"drop table if exists {name}")
            spark.catalog.dropTempView(f"{name}_view")

    return alone(spark, make)


TABLES = """select n_nationkey as id, n_name as name, 'view' as made from nation where n_nationkey < 5
union all select * from (values (100, 'one hundred', 'values'), (101, null, 'values'))
union all select n_nationkey, n_name, 'writer' from nation where n_nationkey >= 20"""


def joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J01 (inner, left, right, full; equality and range), J02 (each region with each nation: 125 rows), J03, J05."""
    region, nation, customer, supplier = _read(spark, sf_dir, "region", "nation", "customer", "supplier")
    side = lambda df, name: df.select(F.lit(name).alias("kind"), F.col("a").cast("long"), F.col("b").cast("long"))
    rich = supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("b"))
    few = nation.where("n_nationkey < 12").select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").alias("a"))
    out = [side(few.join(rich, "k", how), how) for how in ("inner", "left", "right", "full")]
    # A balance less than 50 above another lies in its bin of 50 or the next, so both sides meet by nation and bin.
    range_ = (F.col("s_acctbal") > F.col("c_acctbal")) & (F.col("s_acctbal") < F.col("c_acctbal") + 50)
    binned = customer.withColumn("bin", F.explode(F.array(F.floor(F.col("c_acctbal") / 50), F.floor(F.col("c_acctbal") / 50) + 1)))
    binned = binned.join(supplier.withColumn("s_bin", F.floor(F.col("s_acctbal") / 50)), (F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("s_bin") == F.col("bin")) & range_)
    out.append(side(binned.select(F.col("c_custkey").alias("a"), F.col("s_suppkey").alias("b")), "range"))
    out.append(side(region.crossJoin(F.broadcast(nation)).where("n_regionkey != r_regionkey").select(F.col("r_regionkey").alias("a"), F.col("n_nationkey").alias("b")), "cross"))
    counted = customer.groupBy("c_nationkey").agg(F.count("*").alias("b")).withColumnRenamed("c_nationkey", "a")
    out.append(side(nation.select(F.col("n_nationkey").alias("a")).join(counted, "a"), "derived"))
    whole = out[0]
    for one in out[1:]:
        whole = whole.unionAll(one)
    return whole


_RICH = "f as (select n_nationkey as k, n_nationkey as a from nation where n_nationkey < 12), s as (select s_nationkey as k, s_suppkey as b from supplier where s_acctbal > 5000)"
JOINS = f"""with {_RICH}, u as (
  select 'inner' as kind, a, b from f join s using (k) union all select 'left', a, b from f left join s using (k)
  union all select 'right', a, b from f right join s using (k) union all select 'full', a, b from f full join s using (k)
  union all select 'range', c_custkey, s_suppkey from customer, supplier where s_acctbal > c_acctbal and s_acctbal < c_acctbal + 50 and s_nationkey = c_nationkey
  union all select 'cross', r_regionkey, n_nationkey from region, nation where n_regionkey <> r_regionkey
  union all select 'derived', n_nationkey, n from nation join (select c_nationkey, count(*) as n from customer group by 1) on c_nationkey = n_nationkey
) select kind, cast(a as bigint) as a, cast(b as bigint) as b from u"""


def semi_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi and anti joins, IN, EXISTS and a scalar subquery, as joins on keys."""
    orders, customer, lineitem = _read(spark, sf_dir, "orders", "customer", "lineitem")
    with_orders = customer.join(orders.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.lit("exists").alias("kind"), F.col("c_custkey").alias("key"))
    without = customer.join(orders.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.lit("anti"), "c_custkey")
    large = lineitem.where("l_quantity >= 50 and l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    within = orders.join(large, "o_orderkey", "left_semi").select(F.lit("in"), "o_orderkey")
    mean = orders.agg(F.sum(_cents("o_totalprice")).alias("cents"), F.count("*").alias("n"))
    above = orders.crossJoin(F.broadcast(mean)).where(_cents("o_totalprice") * F.col("n") * 2 > F.col("cents") * 3).select(F.lit("scalar"), "o_orderkey")
    return with_orders.unionAll(without).unionAll(within).unionAll(above)


SEMI_JOINS = """select 'exists' as kind, c_custkey as key from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')
union all select 'anti', c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')
union all select 'in', o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity >= 50 and l_discount > 0.05)
union all select 'scalar', o_orderkey from orders where cast(round(o_totalprice * 100) as bigint) * (select count(*) from orders) * 2 > (select sum(cast(round(o_totalprice * 100) as bigint)) from orders) * 3"""


def aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain, collecting, approximate (within a tenth of the exact count, and one of the exact median), quantile and spread aggregates.

    An approximate count errs by APART (as a standard deviation), so that a tenth is far out of its reach. Distinct values are counted apart: counted
    with the others, each of them would hold a state of all aggregates, approximate counts' registers included.
    """
    (lineitem,) = _read(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    exact = lineitem.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"))
    plain = lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(q.cast("long")).alias("total"), F.count("*").alias("n"), F.round(F.avg(q.cast("long")), 6).alias("mean"), F.max(q).alias("most"), F.min(q).alias("least"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.col("l_linenumber"))), lambda x: x.cast("string")), "+").alias("lines"),
        F.array_join(F.array_sort(F.collect_set(F.when(q > 49, F.date_format("l_shipdate", "yyyy")))), ",").alias("years"),
        F.approx_count_distinct("l_partkey", APART).alias("about"),
        (F.abs(F.percentile_approx("l_quantity", 0.5, 10_000) - F.percentile("l_quantity", F.lit(0.5))) <= 1).alias("near"),
        F.percentile("l_quantity", F.lit(0.5)).alias("median"), F.round(F.stddev_samp(q), 6).alias("sd"), F.round(F.stddev_pop(q), 6).alias("sd_pop"), F.round(F.variance(q), 6).alias("variance"),
    )
    both = plain.join(F.broadcast(exact), F.col("l_returnflag").eqNullSafe(F.col("flag")) & F.col("l_linestatus").eqNullSafe(F.col("status")))
    close = F.abs(F.col("about") - F.col("parts")) <= F.col("parts") / 10
    return both.select("l_returnflag", "l_linestatus", "total", "n", "mean", "most", "least", "lines", "years", "suppliers", close.alias("close"), "near", "median", "sd", "sd_pop", "variance")


AGGREGATES = """select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as bigint)) as bigint) as total, count(*) as n, round(avg(cast(l_quantity as bigint)), 6) as mean, max(l_quantity) as most, min(l_quantity) as least,
  array_to_string(list_sort(array_agg(distinct l_linenumber)), '+') as lines, coalesce(string_agg(distinct case when l_quantity > 49 then strftime(l_shipdate, '%Y') end, ',' order by case when l_quantity > 49 then strftime(l_shipdate, '%Y') end), '') as years,
  count(distinct l_suppkey) as suppliers, true as close, true as near, quantile_cont(l_quantity, 0.5) as median, round(stddev_samp(l_quantity), 6) as sd, round(stddev_pop(l_quantity), 6) as sd_pop, round(var_samp(l_quantity), 6) as variance
from lineitem group by 1, 2"""


def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CUBE, ROLLUP and stated GROUPING SETS, and which keys a row was grouped by."""
    (orders,) = _read(spark, sf_dir, "orders")
    cube = orders.cube("o_orderstatus", "o_orderpriority").agg(F.lit("cube").alias("kind"), F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))
    rolled = orders.rollup("o_orderstatus", "o_orderpriority").agg(F.lit("rollup").alias("kind"), F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))
    sets = [[F.col("o_orderstatus"), F.col("o_orderpriority")], [F.col("o_orderpriority")], []]
    stated = orders.groupingSets(sets, "o_orderstatus", "o_orderpriority").agg(F.lit("sets").alias("kind"), F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))
    return cube.unionAll(rolled).unionAll(stated)


GROUPING_SETS = """select o_orderstatus, o_orderpriority, 'cube' as kind, cast(grouping(o_orderstatus, o_orderpriority) as bigint) as level, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)
union all select o_orderstatus, o_orderpriority, 'rollup', cast(grouping(o_orderstatus, o_orderpriority) as bigint), count(*) from orders group by rollup (o_orderstatus, o_orderpriority)
union all select o_orderstatus, o_orderpriority, 'sets', cast(grouping(o_orderstatus, o_orderpriority) as bigint), count(*) from orders group by grouping sets ((o_orderstatus, o_orderpriority), (o_orderpriority), ())"""


def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pivot with stated values, and its columns turned back into rows."""
    (orders,) = _read(spark, sf_dir, "orders")
    wide = orders.groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum(_cents("o_totalprice")))
    return wide.unpivot("year", ["F", "O", "P"], "status", "cents").where("cents is not null")


PIVOT = """select cast(year as integer) as year, status, cast(cents as bigint) as cents from (
  select year(o_orderdate) as year, o_orderstatus as status, sum(cast(round(o_totalprice * 100) as bigint)) as cents from orders where o_orderstatus in ('F', 'O', 'P') group by 1, 2)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks, neighbours, and running frames by rows and by range."""
    (orders,) = _read(spark, sf_dir, "orders")
    own = orders.select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), _cents("o_totalprice").alias("cents"))
    by_day = Window.partitionBy("o_custkey").orderBy("day")
    row = Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")
    near = Window.partitionBy("o_custkey").orderBy(F.datediff("day", F.lit("1990-01-01").cast("date"))).rangeBetween(-90, 0)
    return own.select(
        "o_custkey", "o_orderkey", F.row_number().over(row).alias("place"), F.rank().over(by_day).alias("place_ties"), F.dense_rank().over(by_day).alias("place_dense"),
        F.lag("cents").over(row).alias("before"), F.lead("cents", 1, -1).over(row).alias("after"), F.sum("cents").over(row.rowsBetween(-2, 0)).alias("three"), F.sum("cents").over(near).alias("quarter"),
    )


WINDOWS = """with o as (select o_custkey, o_orderkey, cast(o_orderdate as date) as day, cast(round(o_totalprice * 100) as bigint) as cents from orders)
select o_custkey, o_orderkey, cast(row_number() over r as integer) as place, cast(rank() over d as integer) as place_ties, cast(dense_rank() over d as integer) as place_dense,
  lag(cents) over r as before, lead(cents, 1, -1) over r as after, cast(sum(cents) over (r rows between 2 preceding and current row) as bigint) as three,
  cast(sum(cents) over (partition by o_custkey order by date_diff('day', date '1990-01-01', day) range between 90 preceding and current row) as bigint) as quarter
from o window r as (partition by o_custkey order by day, o_orderkey), d as (partition by o_custkey order by day)"""


def order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rows, one row a key, a dropped column, a repartitioning that changes nothing, and the top of an order."""
    orders, lineitem = _read(spark, sf_dir, "orders", "lineitem")
    top = orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select(F.lit("top").alias("kind"), "o_orderkey", "o_orderstatus")
    status = orders.select("o_orderstatus").distinct().select(F.lit("distinct"), F.lit(None).cast("long"), "o_orderstatus")
    flags = lineitem.select("l_orderkey", F.lit("x").alias("flag"), "l_returnflag").repartition("l_orderkey").drop("l_returnflag").dropDuplicates(["l_orderkey"])
    return top.unionAll(status).unionAll(flags.select(F.lit("key"), "l_orderkey", "flag"))


ORDER_LIMIT = """select * from (select 'top' as kind, o_orderkey, o_orderstatus from orders order by o_totalprice desc, o_orderkey limit 20)
union all select 'distinct', null, o_orderstatus from (select distinct o_orderstatus from orders) union all select 'key', l_orderkey, 'x' from (select distinct l_orderkey from lineitem)"""


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference, of sets and of bags."""
    customer, supplier = _read(spark, sf_dir, "customer", "supplier")
    a, b = customer.where("c_acctbal > 2000").select(F.col("c_nationkey").alias("k")), supplier.select(F.col("s_nationkey").alias("k"))
    kinds = {"union all": a.unionAll(b), "union": a.union(b).distinct(), "intersect": a.intersect(b), "intersect all": a.intersectAll(b), "except": a.subtract(b), "except all": a.exceptAll(b)}
    out = None
    for kind, df in kinds.items():
        one = df.groupBy("k").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "k", "n")
        out = one if out is None else out.unionAll(one)
    return out


_BAGS = "(select c_nationkey as k from customer where c_acctbal > 2000) {0} (select s_nationkey from supplier)"
SET_OPERATIONS = " union all ".join(f"(select '{kind}' as kind, k, count(*) as n from ({_BAGS.format(kind)}) group by 2)" for kind in ("union all", "union", "intersect", "intersect all", "except", "except all"))


def common_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table expression over one table, one over another, and one over a join, each used by the next.

    Bands are ranked among themselves (a million cents each), not among the customers, so no window holds all customers.
    """
    nation, customer, orders = _read(spark, sf_dir, "nation", "customer", "orders")
    text = """with spent as (select o_custkey, sum(cast(round(o_totalprice * 100) as bigint)) as cents from {orders} group by o_custkey),
      bands as (select step, row_number() over (order by step desc) as band from (select distinct cents div 1000000 as step from spent)),
      ranked as (select o_custkey, cents, band from spent join bands on cents div 1000000 = step),
      placed as (select c_nationkey, band, cents from ranked join {customer} on c_custkey = o_custkey)
    select n_name, count(*) as customers, sum(cents) as cents, min(band) as best from placed join {nation} on n_nationkey = c_nationkey group by n_name"""
    return spark.sql(text, nation=nation, customer=customer, orders=orders)


COMMON_TABLES = """select n_name, count(*) as customers, cast(sum(cents) as bigint) as cents, cast(min(band) as integer) as best from (
  select o_custkey, cents, dense_rank() over (order by cents // 1000000 desc) as band from (select o_custkey, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents from orders group by 1))
join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1"""


def recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The depth of every part below the first one, a part's parent being half its key; an inline anchor counts beside it.

    Spark ends a recursion at a number of rows (a million) unless told otherwise, so the query is told how many parts there are, and run.
    """
    (part,) = _read(spark, sf_dir, "part")
    text = """with recursive tree(id, depth) as (
        select p_partkey, 0 from {part} where p_partkey = 1
        union all select p_partkey, depth + 1 from tree join {part} on p_partkey div 2 = id and p_partkey > 1),
      numbers(n) as (values (1) union all select n + 1 from numbers where n < 10)
    select depth, count(*) as parts, max(id) as last from tree group by depth
    union all select -n, n, n from numbers"""
    with setting(spark, "spark.sql.cteRecursionRowLimit", str(max(1_000_000, 2 * part.count()))):
        return cut(spark.sql(text, part=part))


RECURSION = """with recursive tree(id, depth) as (select p_partkey, 0 from part where p_partkey = 1 union all select p_partkey, depth + 1 from tree join part on p_partkey // 2 = id and p_partkey > 1)
select depth, count(*) as parts, max(id) as last from tree group by 1 union all select -n, n, n from range(1, 11) t(n)"""


def generators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array's items, with and without their places; an empty or null array gives no row."""
    (part,) = _read(spark, sf_dir, "part")
    words = F.when(F.col("p_partkey") % 7 != 0, F.split(F.concat_ws(" ", "p_name", "p_type"), " "))
    places = part.select("p_partkey", F.posexplode(words).alias("at", "word"))
    plain = part.where("p_size > 40").select("p_partkey", F.explode(words).alias("word")).select("p_partkey", F.lit(-1), "word")
    return places.unionAll(plain)


GENERATORS = """with w as (select p_partkey, p_size, string_split(concat_ws(' ', p_name, p_type), ' ') as w from part where p_partkey % 7 <> 0)
select p_partkey, cast(generate_subscripts(w, 1) - 1 as integer) as at, unnest(w) as word from w
union all select p_partkey, -1, unnest(w) from w where p_size > 40"""


def merge(target: DataFrame, source: DataFrame, key: str, update: dict, insert: dict, delete_unmatched=None) -> DataFrame:
    """The target after MERGE: rows of the source update equal keys, others are inserted; unmatched target rows go where `delete_unmatched` holds.

    Columns of the source are named `s_` and the key's own name. One full outer join, with both sides dealt by the key; source keys must be unique.
    """
    named = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns])
    both = target.withColumn("__t", F.lit(True)).join(named.withColumn("__s", F.lit(True)), F.col(key) == F.col(f"s_{key}"), "full")
    if delete_unmatched is not None:
        both = both.where(~(F.col("__s").isNull() & F.coalesce(delete_unmatched, F.lit(False))))
    value = lambda c: F.when(F.col("__t").isNull(), insert[c]).when(F.col("__s").isNotNull(), update.get(c, F.col(c))).otherwise(F.col(c))
    return both.select(*[value(c).alias(c) for c in target.columns])


def merge_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals merged into customers: updated, inserted, and the penniless without orders deleted."""
    customer, orders = _read(spark, sf_dir, "customer", "orders")
    target = customer.where("c_custkey % 3 != 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), _cents("c_acctbal").alias("cents"))
    source = orders.where("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("id")).agg(F.sum(_cents("o_totalprice")).alias("spent"), F.count("*").alias("n"))
    update = {"cents": F.col("cents") - F.col("s_spent")}
    insert = {"id": F.col("s_id"), "name": F.concat(F.lit("new "), F.col("s_n").cast("string")), "cents": -F.col("s_spent")}
    return merge(target, source, "id", update, insert, F.col("cents") < 0)


MERGE = """with t as (select c_custkey as id, c_name as name, cast(round(c_acctbal * 100) as bigint) as cents from customer where c_custkey % 3 <> 0),
s as (select o_custkey as id, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as spent, count(*) as n from orders where o_custkey % 2 = 0 group by 1)
select t.id, name, cents - spent as cents from t join s on t.id = s.id
union all select id, name, cents from t where id not in (select id from s) and not cents < 0
union all select id, 'new ' || n, -spent from s where id not in (select id from t)"""

_QUERIES: dict[str, tuple[Query, str]] = {
    "x01_project_filter": (project_filter, PROJECT_FILTER),
    "x02_star_derived": (star_derived, STAR_DERIVED),
    "x03_having_qualify": (having_qualify, HAVING_QUALIFY),
    "x04_tables": (tables, TABLES),
    "x05_joins": (joins, JOINS),
    "x06_semi_joins": (semi_joins, SEMI_JOINS),
    "x07_aggregates": (aggregates, AGGREGATES),
    "x08_grouping_sets": (grouping_sets, GROUPING_SETS),
    "x09_pivot": (pivot, PIVOT),
    "x10_windows": (windows, WINDOWS),
    "x11_order_limit": (order_limit, ORDER_LIMIT),
    "x12_set_operations": (set_operations, SET_OPERATIONS),
    "x13_common_tables": (common_tables, COMMON_TABLES),
    "x14_recursion": (recursion, RECURSION),
    "x15_generators": (generators, GENERATORS),
    "x16_merge": (merge_customers, MERGE),
}


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items()}
