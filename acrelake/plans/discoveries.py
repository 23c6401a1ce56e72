"""Queries of a discovery cycle into a store, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelake.operators import discover
from acrelake.operators.store import Store
from acrelake.plans.catalogue import query, t
from acrelake.plans.cycles import _items
from acrelake.sources import scratch

_FEATURES = """CASE WHEN c_custkey % 19 <> 0 THEN 'p' || c_custkey END AS parcel_id, CASE WHEN c_custkey % 17 = 0 THEN 'no geometry' END AS skip_reason, c_custkey % 8 = 0 AS multipolygon, 'c' || c_custkey % 3 AS corridor,
  CASE WHEN c_custkey % 13 <> 0 THEN c_custkey % 40 + {k} + 0.25{d} END AS acreage, CASE c_custkey % 5 WHEN 0 THEN 'public' WHEN 1 THEN NULL ELSE 'llc' END AS owner_type_inferred, CASE WHEN c_custkey % 4 <> 0 THEN 'M-1' END AS zoning,
  'county {k}' AS county, CASE WHEN c_custkey % 6 + {k} <> 1 THEN 'run {k}' END AS discovery_source"""
_COLUMNS = ["parcel_id", "county", "acreage", "owner_type_inferred", "zoning", "discovery_source"]
#: Two cycles: all features, then every second one after a change.
_CYCLES = ((1, 1), (2, 2))
_SEEN = """SELECT 'disco-{k}' AS cycle_id, *, CASE WHEN skip_reason IS NOT NULL OR parcel_id IS NULL THEN 'unmappable feature: ' || coalesce(skip_reason, 'no key') END AS lost,
  CASE WHEN coalesce(acreage < 12, true) THEN 'H1: too small' WHEN owner_type_inferred = 'public' THEN 'H2: public owner' END AS bad FROM (SELECT {features} FROM customer WHERE c_custkey % {k} = 0)"""
_ALL = " UNION ALL ".join(_SEEN.format(k=k, features=_FEATURES.format(k=k, d="::DOUBLE")) for k, _ in _CYCLES)


def _discovered(spark: SparkSession, sf_dir: str) -> tuple[Store, list[DataFrame]]:
    store, counts = Store(spark, scratch.fresh_path(spark, "discovered")), []
    rejects = [("H1: too small", F.col("acreage") < 12), ("H2: public owner", F.coalesce(F.col("owner_type_inferred") == "public", F.lit(False)))]
    flags = [("H5: zoning not known", F.col("zoning").isNull())]
    for k, every in (*_CYCLES, _CYCLES[-1]):  # the last one is known already
        rows = t(spark, sf_dir, "customer").where(F.col("c_custkey") % every == 0).selectExpr(*_items(_FEATURES.format(k=k, d="D")))
        done = discover.discover(store, f"disco-{k}", rows, "market", rejects, flags, _COLUMNS, [F.col("acreage").desc()], ["discovery_source"], ["county"], 8)
        if done is not None:
            counts.append(done.withColumn("cycle_id", F.lit(f"disco-{k}")))
    return store, counts


@query(f"""WITH s AS ({_ALL}), a AS (SELECT * FROM s WHERE lost IS NULL AND bad IS NULL AND cycle_id = 'disco-1'), b AS (SELECT * FROM s WHERE lost IS NULL AND bad IS NULL AND cycle_id = 'disco-2')
  SELECT coalesce(b.parcel_id, a.parcel_id) AS parcel_id, coalesce(a.county, b.county) AS county, coalesce(b.acreage, a.acreage) AS acreage, CASE WHEN b.parcel_id IS NULL THEN a.owner_type_inferred ELSE b.owner_type_inferred END AS owner_type_inferred,
    CASE WHEN b.parcel_id IS NULL THEN a.zoning ELSE b.zoning END AS zoning, coalesce(a.discovery_source, b.discovery_source) AS discovery_source FROM a FULL JOIN b USING (parcel_id)""")
def discovered_parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discovered(spark, sf_dir)[0].read("parcels")


@query(f"""WITH s AS ({_ALL}) SELECT cycle_id, CASE WHEN lost IS NULL AND bad IS NULL THEN 'discovery' ELSE 'rejection' END AS kind, CASE WHEN lost IS NULL THEN parcel_id END AS parcel_id,
    coalesce(lost, bad, 'corridor=' || corridor || '; acreage=' || coalesce(acreage::VARCHAR, 'None') || '; owner_type=' || coalesce(owner_type_inferred, 'None')) AS said FROM s
  UNION ALL SELECT cycle_id, 'data_gap', parcel_id, 'H5: zoning not known' FROM s WHERE lost IS NULL AND bad IS NULL AND zoning IS NULL
  UNION ALL SELECT cycle_id, 'data_gap', parcel_id, 'multi-polygon parcel reduced to largest outer ring' FROM s WHERE lost IS NULL AND bad IS NULL AND multipolygon""")
def discovery_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, _ = _discovered(spark, sf_dir)
    log = store.read("log").select("cycle_id", F.col("action_type").alias("kind"), "parcel_id", F.col("notes").alias("said"))
    return log.unionByName(store.read("flags").select("cycle_id", F.col("flag_type").alias("kind"), "parcel_id", F.col("description").alias("said")))


@query(f"""WITH s AS ({_ALL}) SELECT cycle_id, coalesce(corridor, 'total') AS corridor, count(*) FILTER (lost IS NULL AND bad IS NULL) AS discovery, count(*) FILTER (lost IS NOT NULL) AS skip_unmappable,
  count(*) FILTER (lost IS NULL AND bad LIKE 'H1%') AS rejection_h1, count(*) FILTER (lost IS NULL AND bad LIKE 'H2%') AS rejection_h2 FROM s GROUP BY GROUPING SETS ((cycle_id, corridor), (cycle_id))""")
def discovery_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _discovered(spark, sf_dir)[1]
    return first.unionByName(second)
