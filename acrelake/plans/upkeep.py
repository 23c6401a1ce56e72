"""Queries of documented cuts, moved scores, late exports, assemblages, health of markets and masked fields, each beside its SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelake.functions import spec_scores
from acrelake.operators import upkeep
from acrelake.plans.catalogue import query, t
from acrelake.plans.cycles import _items

_SPEC = """c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey * 7 % 130) / 10.0{d} END AS miles, CASE WHEN c_custkey % 8 <> 0 THEN (c_custkey * 11 % 180) / 10.0{d} END AS grade,
  CASE WHEN c_custkey % 7 <> 0 THEN c_custkey * 7919 % 260000 END AS workers, CASE c_custkey % 6 WHEN 0 THEN 'by_right' WHEN 1 THEN 'minor_variance' WHEN 2 THEN 'rezoning_with_precedent' WHEN 3 THEN 'rezoning' WHEN 4 THEN 'other' END AS way,
  nullif(c_custkey % 5, 4) AS offers, CASE c_custkey % 4 WHEN 0 THEN 'spur' WHEN 1 THEN 'adjacent' WHEN 2 THEN 'none' END AS access, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 30) / 10.0{d} END AS rail_miles,
  (c_custkey * 13 % 250) / 10.0{d} AS generator"""


@query(f"""SELECT c_custkey, CASE WHEN miles <= 1 THEN 10 WHEN miles <= 3 THEN 8 WHEN miles <= 5 THEN 5 WHEN miles <= 10 THEN 2 WHEN miles > 10 THEN 0 END AS s1,
  CASE WHEN grade <= 3 THEN 10 WHEN grade <= 8 THEN 7 WHEN grade <= 15 THEN 4 WHEN grade > 15 THEN 0 END AS s3,
  CASE WHEN workers > 200000 THEN 10 WHEN workers >= 100000 THEN 7 WHEN workers >= 50000 THEN 4 WHEN workers < 50000 THEN 0 END AS s7,
  CASE way WHEN 'by_right' THEN 10 WHEN 'minor_variance' THEN 7 WHEN 'rezoning_with_precedent' THEN 4 WHEN 'rezoning' THEN 1 END AS s9,
  CASE WHEN offers >= 3 THEN 10 WHEN offers = 2 THEN 7 WHEN offers = 1 THEN 4 WHEN offers = 0 THEN 0 END AS s10,
  CASE WHEN access = 'spur' THEN 10 WHEN access = 'adjacent' THEN 7 WHEN rail_miles <= 1 THEN 3 WHEN access IS NULL AND rail_miles IS NULL THEN NULL ELSE 0 END AS s11,
  CASE WHEN generator <= 5 THEN 10 WHEN generator <= 10 THEN 7 WHEN generator <= 20 THEN 3 ELSE 0 END AS s12 FROM (SELECT {_SPEC.format(d="::DOUBLE")} FROM customer)""")
def documented_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, c, s = t(spark, sf_dir, "customer").selectExpr(*_items(_SPEC.format(d="D"))), F.col, spec_scores
    return x.select(
        "c_custkey",
        s.up_to(c("miles"), s.INTERCHANGE_MILES).alias("s1"),
        s.up_to(c("grade"), s.GRADE_FEET).alias("s3"),
        s.labor(c("workers")).alias("s7"),
        s.entitlement(c("way")).alias("s9"),
        s.incentives(c("offers")).alias("s10"),
        s.rail(c("access"), c("rail_miles")).alias("s11"),
        s.up_to(c("generator"), s.GENERATOR_MILES).alias("s12"),
    )


_HISTORY = "o_custkey, o_orderkey, o_orderdate, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey * 37 % 200) / 8.0{d} END AS composite"


@query(f"""SELECT o_custkey, o_orderkey, composite, before, composite - before AS delta FROM (SELECT *, last_value(composite IGNORE NULLS) OVER
  (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT {_HISTORY.format(d="::DOUBLE")} FROM orders)) WHERE abs(composite - before) >= 5""")
def moved_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "orders").selectExpr(*_items(_HISTORY.format(d="D")))
    return upkeep.moved(rows, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "composite").select("o_custkey", "o_orderkey", "composite", "before", "delta")


@query("""SELECT s_suppkey, days, CASE WHEN days IS NULL THEN 'missing' WHEN days > 14 THEN 'alert' WHEN days > 7 THEN 'warning' ELSE 'ok' END AS state,
  CASE WHEN days > 7 THEN 7.0::DOUBLE / days WHEN days IS NOT NULL THEN 1.0::DOUBLE END AS factor, CASE WHEN days > 7 THEN 'land sales data is ' || days || ' days stale' END AS note
  FROM (SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 25 - 2 END AS INT) AS days FROM supplier)""")
def late_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "supplier").selectExpr("s_suppkey", "CASE WHEN s_suppkey % 7 <> 0 THEN date_sub(DATE '1998-01-01', CAST(s_suppkey % 25 - 2 AS INT)) END AS expected")
    return rows.select("s_suppkey", upkeep.late(F.col("expected"), F.lit(datetime.date(1998, 1, 1)), "land sales").alias("l")).select("s_suppkey", "l.*")


@query("""WITH s AS (SELECT c_custkey, c_custkey % 40 AS x, c_custkey // 40 AS y, (c_custkey * 7 % 60) / 4.0::DOUBLE + 0.25 AS acres, nullif(c_custkey % 6, 5) AS owner FROM customer), u AS (SELECT * FROM s WHERE acres < 10 AND owner IS NOT NULL),
  p AS (SELECT a.c_custkey, a.acres AS own, b.c_custkey AS other, b.acres, row_number() OVER (PARTITION BY a.c_custkey ORDER BY b.acres DESC, b.c_custkey) AS rn FROM u a JOIN u b
    ON b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND a.c_custkey <> b.c_custkey AND a.owner <> b.owner)
  SELECT c_custkey, string_agg(other::VARCHAR, ',' ORDER BY rn) AS parts, any_value(own) + sum(acres) AS acres FROM p WHERE rn <= 3 GROUP BY 1 HAVING any_value(own) + sum(acres) >= 15""")
def parcel_assemblages(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = t(spark, sf_dir, "customer").selectExpr("c_custkey", "c_custkey % 40 AS x0", "c_custkey div 40 AS y0", "c_custkey % 40 + 1 AS x1", "c_custkey div 40 + 1 AS y1", "(c_custkey * 7 % 60) / 4.0D + 0.25D AS acres", "nullif(c_custkey % 6, 5) AS owner")
    return upkeep.assemblages(sites, "c_custkey", 1.0)


_HEALTH = "user_id AS market, CASE event_id % 200 WHEN 0 THEN 'failing' WHEN 1 THEN 'degraded' WHEN 2 THEN 'degraded' WHEN 3 THEN NULL ELSE 'healthy' END AS health"


@query(f"""SELECT c_custkey AS market, CASE WHEN bool_or(h.market IS NULL OR health IS NULL OR health = 'failing') THEN 'fail' WHEN bool_or(health = 'degraded') THEN 'warning' ELSE 'ok' END AS status
  FROM customer LEFT JOIN (SELECT {_HEALTH} FROM events) h ON h.market = c_custkey GROUP BY 1""")
def market_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.market_health(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("market")), t(spark, sf_dir, "events").selectExpr(*_items(_HEALTH)))


_PEOPLE = "c_custkey, c_name, CASE c_custkey % 5 WHEN 0 THEN 'sold to John Smith in May' WHEN 1 THEN 'SMITH JOHN H' WHEN 2 THEN 'parcel 12' WHEN 3 THEN '[REDACTED]' END AS note, CASE c_custkey % 3 WHEN 0 THEN 'Anna Lee' ELSE c_mktsegment END AS segment"
_MASK = "CASE WHEN {c} NOT IN ('[REDACTED]', '[REDACTION_FAILSAFE]') AND regexp_matches({c}, '" + upkeep.PERSON + "') THEN '{then}' {rest} END"


@query(f"""SELECT c_custkey, '[REDACTED]' AS c_name, {_MASK.replace("{c}", "note").replace("{then}", upkeep.FAILSAFE).replace("{rest}", "ELSE note")} AS note, {_MASK.replace("{c}", "segment").replace("{then}", upkeep.FAILSAFE).replace("{rest}", "ELSE segment")} AS segment,
  concat_ws(',', {_MASK.replace("{c}", "note").replace("{then}", "note").replace("{rest}", "")}, {_MASK.replace("{c}", "segment").replace("{then}", "segment").replace("{rest}", "")}) AS residual FROM (SELECT {_PEOPLE} FROM customer)""")
def masked_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upkeep.mask_fields(t(spark, sf_dir, "customer").selectExpr(*_items(_PEOPLE)), ["c_name"], ["note", "segment"])
