"""Queries of layouts, totals and registries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelake.operators import discovery, layout
from acrelake.plans.catalogue import query, t
from acrelake.plans.cycles import _SPOTS, _items
from acrelake.sources import scratch


@query(f"SELECT c_custkey, x, y FROM ({_SPOTS.format(d='::DOUBLE')}) WHERE x BETWEEN -83.1 AND -82.45 AND y BETWEEN 33.5 AND 34.0")
def box_of_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places written by tiles, then a box of them."""
    path = scratch.fresh_path(spark, "tiles")
    layout.write_tiles(t(spark, sf_dir, "customer").selectExpr(*_items(_SPOTS.format(d="D").removeprefix("SELECT ").removesuffix(" FROM customer"))), path, "x", "y", 0.5)
    return layout.read_box(spark, path, "x", "y", 0.5, (-83.1, 33.5, -82.45, 34.0))


_OUTCOMES = "CASE WHEN event_type = 'error' THEN 'unmappable' WHEN value > 50 THEN 'rejection' ELSE 'discovery' END"


@query(f"SELECT coalesce(corridor, 'total') AS corridor, count(*) FILTER (outcome = 'discovery') AS discovery, count(*) FILTER (outcome = 'rejection') AS rejection, count(*) FILTER (outcome = 'unmappable') AS unmappable FROM (SELECT 'c' || (user_id % 6) AS corridor, {_OUTCOMES} AS outcome FROM events) GROUP BY ROLLUP (corridor)")
def corridor_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").selectExpr("concat('c', user_id % 6) AS corridor", f"{_OUTCOMES} AS outcome")
    return discovery.totals(rows, "corridor", "outcome", ["discovery", "rejection", "unmappable"])


@query("""SELECT n_name AS name, coalesce(market, 'm0') AS market, n_regionkey AS layer, coalesce(id_field, 'ID') AS id_field
  FROM nation LEFT JOIN (SELECT n_name AS k, CASE WHEN n_nationkey % 4 = 0 THEN 'm' || n_nationkey END AS market, 'F' || n_nationkey AS id_field FROM nation WHERE n_nationkey % 2 = 0) ON k = n_name WHERE n_name NOT LIKE 'A%'""")
def merged_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = t(spark, sf_dir, "nation")
    known = nation.where("n_name NOT LIKE 'A%'")
    overlay = known.where("n_nationkey % 2 = 0").selectExpr("n_name AS name", "CASE WHEN n_nationkey % 4 = 0 THEN concat('m', n_nationkey) END AS market", "concat('F', n_nationkey) AS id_field")
    return discovery.merged_registry(known.selectExpr("n_name AS name", "n_regionkey AS layer"), overlay, "name", {"market": "m0", "id_field": "ID"}).select("name", "market", "layer", "id_field")
