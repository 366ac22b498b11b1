"""Layers and confidence on the foreign keys' edges, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import layers
from millrace.plans.lineage import _D, on_edges

_LAYERS = """r(node, layer) as (
  select source_col, 0 from d where source_col not in (select target_col from d) union select target_col, layer + 1 from d join r on source_col = node
), m as (select node, max(layer) as layer from r group by 1)
select node, cast(layer as integer) as layer, cast(row_number() over (partition by layer order by node) as integer) as place, false as cyclic from m"""

# Customers in debt are approximate, so lines of their orders are reached certainly through their suppliers alone.
_CONFIDENCE = """r(node, sure, hops) as (
  select 'nation.3', true, 0 union select target_col, sure and confidence = 'certain', hops + 1 from d join r on source_col = node
), b as (select node, max(sure) as sure from r group by 1)
select b.node, case when b.sure then 'certain' else 'approximate' end as confidence, cast(min(hops) as integer) as hops from b join r on r.node = b.node and r.sure = b.sure where b.node <> 'nation.3' group by 1, 2"""

_QUERIES: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "g38_layers": (layers.layers, f"with recursive {_D}, {_LAYERS}"),
    "p12_confidence": (lambda d: layers.confidence_of(d, "nation.3"), f"with recursive {_D}, {_CONFIDENCE}"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: on_edges(operator) for name, (operator, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items()}
