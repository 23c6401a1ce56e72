"""Queries of land signals, memo paragraphs and the source dashboard, each beside the SQL that must give the same rows."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelake.functions import thesis
from acrelake.operators import health, signals
from acrelake.plans.catalogue import query, t
from acrelake.plans.cycles import _items

_BOX = "c_custkey % 40 + {s} AS x0, c_custkey div 40 + {s} AS y0, c_custkey % 40 + 1{d} - {s} AS x1, c_custkey div 40 + 1{d} - {s} AS y1"
_SIDE = "CASE WHEN c_custkey % 5 = 0 THEN 0.25{d} ELSE 0.0{d} END"
_FACTS = """c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'M-1' WHEN 1 THEN 'AG-1' ELSE 'C' END AS zoning, c_custkey % 4 = 1 AS delinquent, c_custkey % 7 = 3 AS developed,
  CASE c_custkey % 6 WHEN 0 THEN 'Box 1, Atlanta, GA 30301' WHEN 1 THEN 'Box 2, Mobile, AL 36601' WHEN 2 THEN 'Box 3' WHEN 3 THEN NULL ELSE 'Box 4, Tampa, FL 33601' END AS mailing,
  CASE c_custkey % 5 WHEN 0 THEN 'estate' WHEN 1 THEN 'trust' WHEN 2 THEN NULL ELSE 'individual' END AS owner,
  CASE WHEN c_custkey % 8 <> 0 THEN {date} END AS since"""
_DUCK_SITES = f"SELECT {_FACTS.format(date='make_date(1970 + CAST(c_custkey % 30 AS INT), 6, 1)')}, {_BOX.format(s=_SIDE.format(d='::DOUBLE'), d='::DOUBLE').replace(' div ', ' // ')} FROM customer"
_NEXT = f"SELECT a.c_custkey, b.c_custkey AS other, b.zoning AS z, b.developed AS dev FROM ({_DUCK_SITES}) a JOIN ({_DUCK_SITES}) b ON a.c_custkey <> b.c_custkey AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 AND NOT (a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)"


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _items(_FACTS.format(date="make_date(CAST(1970 + c_custkey % 30 AS INT), 6, 1)"))
    side = F.expr(_SIDE.format(d="D"))
    x, y = F.expr("c_custkey % 40"), F.expr("c_custkey div 40")
    box = [(x + side).alias("x0"), (y + side).alias("y0"), (x + 1.0 - side).alias("x1"), (y + 1.0 - side).alias("y1")]
    return t(spark, sf_dir, "customer").select(*[F.expr(e) for e in facts], *box)


@query(f"SELECT c_custkey, other FROM ({_NEXT})")
def touching_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir)
    return signals.touching(sites, sites, "c_custkey", 1.0)


@query(f"""WITH n AS (SELECT c_custkey, bool_or(z LIKE 'M-%') AS industrial, count(*) FILTER (dev) AS dev FROM ({_NEXT}) GROUP BY 1),
  s AS (SELECT c_custkey, zoning = 'AG-1' AND coalesce(industrial, false) AS adjacent, mailing NOT LIKE '%GA %' AND regexp_matches(mailing, '[A-Z]{{2}} [0-9]{{5}}') AS absentee,
    owner IN ('estate', 'trust') AS family, delinquent, since < DATE '1986-11-04' AS long_hold, coalesce(dev, 0) >= 3 AS surrounded FROM ({_DUCK_SITES}) LEFT JOIN n USING (c_custkey)),
  c AS (SELECT *, adjacent::INT + coalesce(absentee, false)::INT + coalesce(family, false)::INT + delinquent::INT + coalesce(long_hold, false)::INT + surrounded::INT AS n_signals FROM s)
  SELECT *, n_signals >= 3 AS outreach FROM c""")
def land_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _sites(spark, sf_dir)
    pairs = signals.touching(sites, sites.where("zoning LIKE 'M-%' OR developed"), "c_custkey", 1.0)
    beside = pairs.join(sites.select(F.col("c_custkey").alias("other"), "zoning", "developed"), "other")
    beside = beside.groupBy("c_custkey").agg(F.bool_or(F.col("zoning").startswith("M-")).alias("industrial"), F.count_if("developed").alias("dev"))
    as_of = F.lit(datetime.date(2001, 11, 4))
    rows = sites.join(beside, "c_custkey", "left").select(
        "c_custkey",
        ((F.col("zoning") == "AG-1") & F.coalesce("industrial", F.lit(False))).alias("adjacent"),
        signals.absentee(F.col("mailing")).alias("absentee"),
        F.col("owner").isin("estate", "trust").alias("family"),
        "delinquent",
        signals.long_hold(F.col("since"), as_of).alias("long_hold"),
        (F.coalesce("dev", F.lit(0)) >= signals.SURROUNDED).alias("surrounded"),
    )
    return signals.counted(rows, ["adjacent", "absentee", "family", "delinquent", "long_hold", "surrounded"])


_MEMO = """c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN 'Atlanta' END AS market, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE c_mktsegment END AS submarket, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 40 + 0.25{d} END AS acres,
  CASE c_custkey % 3 WHEN 0 THEN 'M-1' WHEN 1 THEN '' END AS zoning, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey * 1003 END AS assessed, CASE c_custkey % 6 WHEN 0 THEN 'trust' WHEN 1 THEN 'llc' WHEN 2 THEN 'absentee' END AS owner,
  CASE WHEN c_custkey % 8 <> 0 THEN c_custkey % 12 + 0.5{d} END AS vacancy, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey * 991 - 500000 END AS absorbed, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey * 17 END AS supply,
  CASE WHEN c_custkey % 5 <> 0 THEN DATE '1997-10-01' END AS as_of, CASE WHEN c_custkey % 2 = 0 THEN 'survey' END AS source,
  CASE c_custkey % 5 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL:strategy' WHEN 2 THEN 'FAIL:deal_killer' WHEN 3 THEN 'PENDING' END AS verdict, CASE c_custkey % 3 WHEN 0 THEN 'land_bank' WHEN 1 THEN 'other' END AS strategy"""


@query(rf"""WITH p AS (SELECT o_custkey AS c_custkey, list_sort(list((o_totalprice::DOUBLE)) FILTER (o_orderkey % 3 = 0)) AS prices FROM orders GROUP BY 1),
  x AS (SELECT m.*, p.prices FROM (SELECT {_MEMO.format(d="::DOUBLE")} FROM customer) m LEFT JOIN p USING (c_custkey)),
  y AS (SELECT c_custkey,
    concat_ws(', ', CASE WHEN market IS NOT NULL AND submarket <> '' THEN 'The parcel sits in the ' || submarket || ' submarket of the ' || market || ' industrial market' WHEN market IS NOT NULL THEN 'The parcel sits in the ' || market || ' industrial market' END,
      CASE WHEN acres <> 0 THEN 'on a ' || printf('%.2f', acres) || ' acres site' END, CASE WHEN zoning <> '' THEN 'zoned ' || zoning END) AS loc,
    concat_ws('. ', CASE WHEN assessed <> 0 AND acres > 0 THEN 'County assessed value of $' || format('{{:,}}', assessed::BIGINT) || ' implies ~$' || format('{{:,}}', trunc(assessed / acres)::BIGINT) || '/acre on the tax roll' END,
      CASE WHEN len(prices) > 0 THEN 'recent submarket land comps (n=' || len(prices) || ') transacted near $' || format('{{:,}}', trunc(prices[len(prices) // 2 + 1])::BIGINT) || '/acre' END,
      CASE WHEN owner IN ('trust', 'absentee') THEN 'owner is classified as ' || owner || ' -- typically motivated for a clean disposition' END) AS opp,
    concat_ws(', ', CASE WHEN vacancy IS NOT NULL THEN 'submarket vacancy is ' || printf('%.1f', vacancy) || '%' END,
      CASE WHEN absorbed IS NOT NULL THEN 'trailing-12-month net absorption is ' || format('{{:,}}', absorbed::BIGINT) || ' SF (' || CASE WHEN absorbed >= 0 THEN 'positive' ELSE 'negative' END || ')' END,
      CASE WHEN supply IS NOT NULL THEN 'under-construction pipeline is ' || format('{{:,}}', supply::BIGINT) || ' SF' END) AS tim, as_of, source,
    CASE WHEN verdict = 'PASS' THEN 'Actionability passes all four gates with primary strategy ' || CASE strategy WHEN 'land_bank' THEN 'Land Bank' WHEN 'other' THEN 'other' ELSE '—' END || '; the recommendation below captures the specific next step.'
      WHEN verdict = 'FAIL:strategy' THEN 'Actionability fails at the strategy gate: none fits. Remediating that single blocker would move this parcel into the actionable pipeline.'
      WHEN verdict = 'FAIL:deal_killer' THEN 'Actionability fails at the deal_killer gate. Remediating that single blocker would move this parcel into the actionable pipeline.'
      ELSE 'Actionability is PENDING -- additional data sources or scoring passes are required before this parcel can be classified.' END AS risk FROM x)
  SELECT c_custkey, concat_ws(chr(10) || chr(10), CASE WHEN loc <> '' THEN loc || '.' END, CASE WHEN opp <> '' THEN opp || '.' END,
    CASE WHEN tim <> '' THEN 'On market timing: ' || tim || ' (as of ' || coalesce(as_of::VARCHAR, '—') || ', ' || coalesce(source, 'submarket data') || ').' END, risk) AS thesis FROM y""")
def memo_thesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = t(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list(F.col("o_totalprice").cast("double")).alias("prices"))
    x = t(spark, sf_dir, "customer").selectExpr(*_items(_MEMO.format(d="D"))).join(prices, "c_custkey", "left")
    c = F.col
    blocked = F.create_map(F.lit("strategy"), F.lit("none fits"))
    return x.select("c_custkey", thesis.thesis(
        thesis.location(c("market"), c("submarket"), c("acres"), c("zoning")),
        thesis.opportunity(c("assessed"), c("acres"), F.coalesce("prices", F.array().cast("array<double>")), c("owner")),
        thesis.timing(c("vacancy"), c("absorbed"), c("supply"), c("as_of"), c("source")),
        thesis.risk(c("verdict"), c("strategy"), blocked),
    ).alias("thesis"))


@query("""SELECT user_id AS source, round(avg(CASE WHEN event_id % 6 <> 0 THEN (event_id % 100) / 100.0::DOUBLE END), 2) AS mean_rate, max(CASE WHEN event_id % 4 = 0 THEN event_id % 900 END) AS response_ms,
  coalesce(string_agg(CASE WHEN event_id % 50 = 0 THEN 'w' || event_id END, '; ' ORDER BY event_id), string_agg(CASE WHEN event_id % 40 = 0 THEN 'e' || event_id END, '; ' ORDER BY event_id), '') AS notes FROM events GROUP BY 1""")
def source_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").selectExpr("user_id AS source", "event_id AS place", "CASE WHEN event_id % 6 <> 0 THEN (event_id % 100) / 100.0D END AS rate", "CASE WHEN event_id % 4 = 0 THEN event_id % 900 END AS response_ms", "CASE WHEN event_id % 50 = 0 THEN concat('w', event_id) END AS warning", "CASE WHEN event_id % 40 = 0 THEN concat('e', event_id) END AS error")
    return health.dashboard(rows)
