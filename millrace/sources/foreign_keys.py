"""An edge relation derived from the foreign keys of the order tables: lineage at the scale of data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COLUMNS = ["source_col", "target_col", "transform_type", "source_file", "expression", "source_line", "confidence", "seq"]
_LINEITEM = "concat('lineitem.', l_orderkey, '_', l_linenumber)"
_SEQ = "cast({0} as bigint) * 1000000000000 + l_orderkey * 1000 + cast(l_quantity as bigint)"
_PARTS = {
    "nation": "select concat('region.', n_regionkey), concat('nation.', n_nationkey), 'passthrough', 'geo.sql', cast(null as string), n_nationkey, 'certain', cast(n_nationkey as bigint) from {nation}",
    "customer": "select concat('nation.', c_nationkey), concat('customer.', c_custkey), if(c_acctbal < 0, 'filter', 'passthrough'), 'customer.sql', if(c_acctbal < 0, 'c_acctbal < 0', null), cast(c_custkey % 50 as int), "
    "if(c_acctbal < 0, 'approximate', 'certain'), 1000000000000 + c_custkey from {customer}",
    "orders": "select concat('customer.', o_custkey), concat('orders.', o_orderkey), 'join_key', 'orders.py', 'o_custkey = c_custkey', cast(o_orderkey % 50 as int), 'certain', 2000000000000 + o_orderkey from {orders}",
    "lineitem": f"select concat('orders.', l_orderkey), {_LINEITEM}, if(l_discount > 0.05, 'expression', 'aggregation'), 'lineitem.ipynb', if(l_discount > 0.05, 'price * (1 - discount)', 'sum(quantity)'), l_linenumber, 'certain', {_SEQ.format(3)} from {{lineitem}} union all "
    f"select concat('supplier.', l_suppkey), {_LINEITEM}, 'window', 'lineitem.ipynb', 'row_number() over (partition by supplier)', l_linenumber + 10, 'certain', {_SEQ.format(5)} from {{lineitem}}",
    "supplier": "select concat('nation.', s_nationkey), concat('supplier.', s_suppkey), 'passthrough', 'supplier.sql', null, cast(s_suppkey % 50 as int), 'certain', 4000000000000 + s_suppkey from {supplier}",
}


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """COLUMNS of every edge; seq says which of two edges between the same columns is the later."""
    out = None
    for table, text in _PARTS.items():
        part = spark.sql(text, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")}).toDF(*COLUMNS)
        out = part if out is None else out.unionAll(part)
    return out
