"""View inlining on the foreign keys' edges, over all files and file by file, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import lineage, views
from millrace.plans.lineage import _D, _DEDUP, _extra, on_edges
from millrace.plans.lineage import _RANK as _KNOWN
from millrace.sources.shared import cut

# Customers and suppliers are views, in whose making some customers are cast. A mart takes all customers by `*` and one that isn't
# there. Suppliers are audited through a view that was made by `*` of raw columns, of one other column, and has one column of its own.


_RANK = f"greatest(1, {_KNOWN})"


def _with_views(d: DataFrame) -> DataFrame:
    d = d.withColumn("transform_type", F.when((F.col("source_file") == "customer.sql") & (F.col("seq") % 3 == 0), "cast").otherwise(F.col("transform_type")))
    key = lineage.column_of(F.col("target_col"))
    audit = d.where("source_file = 'supplier.sql'").withColumns({"source_col": F.concat(F.lit("Wild."), key), "target_col": F.concat(F.lit("audit."), key), "source_file": F.lit("audit.sql")})
    more = [
        ("Customer.*", "mart.*", "passthrough", "mart.sql"), ("customer.none", "mart.none", "passthrough", "mart.sql"), ("raw.*", "wild.*", "cast", "wild.sql", "raw"),
        ("seed.3", "wild.*", "expression", "wild.sql", "seed"), ("only.x", "wild.5", "window", "wild.sql", "only"), ("wild.tag", "wild2.tag", "aggregation", "wild.sql", "tag"), ("wild2.tag", "audit.tag", "expression", "audit.sql", "own"),
    ]
    return _extra(d.unionByName(audit), more)


def _inlined(raw: DataFrame) -> DataFrame:
    """Edges into views are taken once, as of a chain the best edge counts. Others are when views are taken out: between the same columns
    the last by seq stands then as before, and those of the same seq are of one line item and alike.
    """
    into = F.coalesce(F.lower(lineage.table_of(F.col("target_col"))).isin("customer", "supplier"), F.lit(False))
    d = cut(lineage.dedup_edges(raw.where(into))).unionByName(raw.where(~into))
    return lineage.dedup_edges(views.inline_views(_with_views(d), ["CUSTOMER", "supplier", "wild", "wild2"]))


_REST = "o.source_file, o.source_line, o.confidence, o.seq, o.transform_type, o.expression, a.transform_type as kt, a.expression as ke"
_INLINED = f"""v as (select * replace (case when source_file = 'customer.sql' and seq % 3 = 0 then 'cast' else transform_type end as transform_type) from d),
s as (select split_part(target_col, '.', 2) as k, * from v where source_file = 'supplier.sql'),
best as (select * from v where source_file = 'customer.sql' qualify row_number() over (partition by source_col order by {_RANK.format('transform_type')} desc, transform_type desc, expression desc nulls last) = 1),
mart as (select 'mart.sql' as source_file, 1 as source_line, 'certain' as confidence, -1::bigint as seq, 'passthrough' as transform_type, null::varchar as expression),
c as (
  select a.source_col, o.target_col, {_REST} from v o join v a on a.target_col = o.source_col where o.source_file = 'orders.py' or starts_with(o.source_col, 'supplier.')
  union all select a.source_col, 'mart.' || split_part(a.target_col, '.', 2), {_REST} from v a, mart o where a.source_file = 'customer.sql'
  union all select a.source_col, 'mart.*', {_REST} from best a, mart o
  union all select 'raw.' || k, 'audit.' || k, 'audit.sql', source_line, confidence, seq, transform_type, expression, 'cast', 'raw' from s where k <> '5'
  union all select 'seed.3', 'audit.3', 'audit.sql', source_line, confidence, seq, transform_type, expression, 'expression', 'seed' from s where k = '3'
  union all select 'only.x', 'audit.5', 'audit.sql', source_line, confidence, seq, transform_type, expression, 'window', 'only' from s where k = '5'
), i as (
  select source_col, target_col, case when {_RANK.format('kt')} > {_RANK.format('transform_type')} then kt else transform_type end as transform_type, source_file,
    case when {_RANK.format('kt')} > {_RANK.format('transform_type')} then ke else expression end as expression, source_line, confidence, seq from c
  union all select source_col, target_col, transform_type, source_file, expression, source_line, confidence, seq from v where source_file = 'geo.sql' or starts_with(source_col, 'orders.')
  union all select 'customer.none', 'mart.none', 'passthrough', 'mart.sql', null, 1, 'certain', -1
  union all select 'raw.tag', 'audit.tag', 'cast', 'audit.sql', 'raw', 1, 'certain', -1
)
{_DEDUP.format('i')}"""

# Seven files each have a view `stage` of their own, in which ten customers of theirs make a column.


def _by_file(d: DataFrame) -> DataFrame:
    made = d.where("source_file = 'customer.sql'").withColumn("n", lineage.column_of(F.col("target_col")).try_cast("long"))
    used = d.where("source_file = 'orders.py'").withColumn("n", lineage.column_of(F.col("source_col")).try_cast("long"))
    stage, file = F.expr("concat('Stage.', n div 10)"), F.expr("concat('f', n % 7, '.py')")
    made = made.withColumns({"source_col": F.col("target_col"), "target_col": stage, "source_file": file})
    used = used.withColumns({"source_col": F.lower(stage), "source_file": file})
    edges = made.unionByName(used).drop("n")
    known = edges.select("source_file", F.lit("stage").alias("view")).where("source_file != 'f0.py'").distinct()
    return views.inline_views(edges, known)


_BY_FILE = f"""m as (select *, cast(split_part(target_col, '.', 2) as bigint) as n from d where source_file = 'customer.sql'),
u as (select *, cast(split_part(source_col, '.', 2) as bigint) as n from d where source_file = 'orders.py')
select m.target_col as source_col, u.target_col, 'f' || u.n % 7 || '.py' as source_file, u.source_line, u.confidence, u.seq,
  case when {_RANK.format('m.transform_type')} > {_RANK.format('u.transform_type')} then m.transform_type else u.transform_type end as transform_type, case when {_RANK.format('m.transform_type')} > {_RANK.format('u.transform_type')} then m.expression else u.expression end as expression
from u join m on m.n // 10 = u.n // 10 and m.n % 7 = u.n % 7 where u.n % 7 <> 0
union all select 'stage.' || n // 10, target_col, 'f0.py', source_line, confidence, seq, transform_type, expression from u where n % 7 = 0 or not exists (select 1 from m where m.n // 10 = u.n // 10 and m.n % 7 = u.n % 7)
union all select target_col, 'Stage.' || n // 10, 'f0.py', source_line, confidence, seq, transform_type, expression from m where n % 7 = 0"""

_QUERIES: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "g27_inline_views": (_inlined, f"with {_D}, {_INLINED}"),
    "f05_views_by_file": (_by_file, f"with {_D}, {_BY_FILE}"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: on_edges(operator, raw=name == "g27_inline_views") for name, (operator, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items()}
