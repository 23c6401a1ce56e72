"""Queries of site snapshots, verdicts with a lifetime and all signals of land, each beside its SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelake.functions import geometry, scoring, snapshot
from acrelake.operators import signals
from acrelake.plans import reports
from acrelake.plans.catalogue import SQL, query, t
from acrelake.plans.cycles import _items
from acrelake.streaming import verdicts

WEIGHTS = {"s1": 12, "s2": 8, "s3": 6, "s4": 12, "s5": 10, "s6": 8, "s7": 8, "s8": 12, "s9": 10, "s10": 4, "s11": 4, "s12": 6}
THRESHOLD = 65.0
#: Sentences of this catalogue for a strategy and its rating.
REASONS = {("bts", "STRONG"): "by right | served", ("bts", "WEAK"): "rezoning", ("spec", "MODERATE"): "some  supply", ("flip", "N/A"): "at market"}

_SITE = """c_custkey, CASE WHEN c_custkey % 6 <> 0 THEN c_name END AS address, CASE WHEN c_custkey % 11 <> 0 THEN 'Atlanta' END AS market, CASE c_custkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE c_mktsegment END AS submarket,
  CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 40 + 0.25{d} END AS acres, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey * 1003 END AS assessed, CASE WHEN c_custkey % 8 <> 0 THEN c_custkey % 12 + 0.5{d} END AS vacancy,
  CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey * 37 % 200) / 2.0{d} END AS composite, CASE c_custkey % 5 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL:strategy' WHEN 2 THEN 'FAIL:deal_killer' WHEN 3 THEN 'PENDING' END AS verdict,
  CASE c_custkey % 3 WHEN 0 THEN 'land_bank' WHEN 1 THEN 'other' END AS strategy, CASE c_custkey % 4 WHEN 0 THEN 'STRONG' WHEN 1 THEN 'WEAK' WHEN 2 THEN 'odd' END AS bts, CASE c_custkey % 3 WHEN 0 THEN 'MODERATE' WHEN 1 THEN 'STRONG' END AS spec,
  """ + ", ".join(f"CASE WHEN c_custkey % {i + 2} <> 0 THEN c_custkey * {i} % 11 END AS s{i}" for i in range(1, 13))
_BLOCK = "no strategy fits | a `remedy`\n is open"
_DUCK_BLOCK = "'no strategy fits \\| a remedy is open'"
_GATE = "'| {name} | ' || {status} || ' | ' || {detail} || ' |'"


def _gate_sql(place: int, name: str, detail: str) -> str:
    """``f`` is the place of the failing gate, 0 where none fails."""
    status = f"CASE WHEN f = {place} THEN 'FAIL' WHEN f > {place} THEN 'PASS' WHEN f = 0 AND verdict = 'PASS' THEN 'PASS' ELSE 'PENDING' END"
    return _GATE.format(name=name, status=status, detail=f"CASE WHEN f = {place} THEN {detail} ELSE '—' END")


_LINES = ", ".join(f"'| {snapshot.SCORE_NAMES[s]} | ' || coalesce(s{s[1:]} || '/10', '—') || ' | {w} | ' || printf('%.2f', coalesce({s} * {w}, 0)::DOUBLE) || ' |'" for s, w in WEIGHTS.items())
_SUM = " + ".join(f"coalesce({s} * {w}, 0)" for s, w in WEIGHTS.items())


@query(f"""WITH fl AS (SELECT o_custkey AS c_custkey, string_agg('- **' || o_orderstatus || '**: ' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS flags FROM orders WHERE o_orderkey % 9 = 0 GROUP BY 1),
  x AS (SELECT s.*, fl.flags, coalesce(composite, -1) AS c, CASE verdict WHEN 'FAIL:strategy' THEN 3 WHEN 'FAIL:deal_killer' THEN 4 ELSE 0 END AS f,
    CASE strategy WHEN 'land_bank' THEN 'Land Bank' WHEN 'other' THEN 'other' ELSE '—' END AS named FROM (SELECT {_SITE.format(d="::DOUBLE")} FROM customer) s LEFT JOIN fl USING (c_custkey))
  SELECT c_custkey, '# Site Snapshot: ' || coalesce(address, '—') || chr(10) || '## ' || coalesce(market, '—') || ' — ' || coalesce(nullif(trim(submarket), ''), '—') || ' | ' || coalesce(printf('%.2f', acres) || ' acres', '—')
      || ' | Score: ' || coalesce(printf('%.1f', composite), '—') || '/100 | ' || CASE WHEN verdict = 'PASS' THEN 'ACTIONABLE' WHEN composite >= 65 THEN 'QUALIFIED — NOT ACTIONABLE' ELSE 'BELOW THRESHOLD' END || chr(10) || chr(10)
    || '### Facts' || chr(10) || '- **Assessed value (total)**: ' || coalesce('$' || format('{{:,}}', assessed::BIGINT), '—') || chr(10) || '- **Submarket vacancy**: ' || coalesce(printf('%.1f', vacancy) || '%', '—') || chr(10) || chr(10)
    || '### Strategy Fit Assessment' || chr(10) || concat_ws(chr(10), '| Strategy | Fit | Rationale |', '|----------|-----|-----------|',
      '| BTS Development | ' || CASE bts WHEN 'STRONG' THEN 'STRONG | by right \\| served' WHEN 'WEAK' THEN 'WEAK | rezoning' ELSE 'N/A | —' END || ' |',
      '| Spec Development | ' || CASE spec WHEN 'MODERATE' THEN 'MODERATE | some supply' WHEN 'STRONG' THEN 'STRONG | —' ELSE 'N/A | —' END || ' |',
      '| Land Bank | N/A | — |', '| Ground Lease | N/A | — |', '| Land Flip / Disposition | N/A | at market |') || chr(10) || chr(10)
    || '### Score Breakdown' || chr(10) || concat_ws(chr(10), '| Parameter | Sub-Score | Weight | Weighted |', '|-----------|-----------|--------|----------|', {_LINES}, '| **Composite** |  |  | **' || printf('%.1f', ({_SUM}) / 100.0::DOUBLE * 10) || '/100** |') || chr(10) || chr(10)
    || '### Actionability Assessment' || chr(10) || concat_ws(chr(10), '| Gate | Status | Detail |', '|------|--------|--------|', {_gate_sql(1, 'Path to control', "''")}, {_gate_sql(2, 'Path to entitlement', "''")},
      {_gate_sql(3, 'Viable strategy with next step', _DUCK_BLOCK)}, {_gate_sql(4, 'No deal-killers', "'—'")}, '', '**Overall actionability**: ' || coalesce(verdict, 'PENDING')) || chr(10) || chr(10)
    || '### Flags / Open Items' || chr(10) || coalesce(flags, '- (no open flags)') || chr(10) || chr(10)
    || '### Recommendation' || chr(10) || CASE WHEN c < 65 THEN '**PASS** — Composite score ' || printf('%.1f', c) || ' is below the 65 qualification threshold.'
      WHEN verdict = 'PASS' THEN '**PURSUE** — Composite ' || printf('%.1f', c) || ' clears threshold and all four actionability gates pass. Primary strategy: ' || named || '.'
      ELSE '**MONITOR** — Composite ' || printf('%.1f', c) || ' clears threshold but ' || CASE f WHEN 3 THEN 'strategy gate fails: no strategy fits | a `remedy`' || chr(10) || ' is open.' WHEN 4 THEN 'deal_killer gate fails.' ELSE '(unknown) gate fails.' END END || chr(10) AS snapshot FROM x""")
def site_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites, c = t(spark, sf_dir, "customer").selectExpr(*_items(_SITE.format(d="D"))), F.col
    flags = t(spark, sf_dir, "orders").where("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("c_custkey"), F.struct("o_orderkey", F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("text")).alias("f"))
    x = sites.join(flags.groupBy("c_custkey").agg(F.array_sort(F.collect_list("f")).alias("flags")), "c_custkey", "left")
    blockers = F.create_map(F.lit("strategy"), F.lit(_BLOCK))
    fit = F.create_map(F.lit("bts"), c("bts"), F.lit("spec"), c("spec"))
    head = snapshot.heading(c("address"), c("market"), c("submarket"), c("acres"), c("composite"), scoring.overall_status(c("composite"), c("verdict"), THRESHOLD))
    text = snapshot.document(head, {
        "Facts": snapshot.listed({"Assessed value (total)": snapshot.whole(c("assessed"), "$"), "Submarket vacancy": snapshot.figure("%.1f%%", c("vacancy"))}),
        "Strategy Fit Assessment": snapshot.strategies(fit, REASONS),
        "Score Breakdown": snapshot.breakdown(WEIGHTS),
        "Actionability Assessment": snapshot.gates(c("verdict"), blockers),
        "Flags / Open Items": snapshot.open_flags(c("flags")),
        "Recommendation": snapshot.recommendation(c("composite"), c("verdict"), THRESHOLD, c("strategy"), blockers),
    })
    return x.select("c_custkey", text.alias("snapshot"))


LIFETIME = 6 * 3600
_PROBES = "CASE event_id % 7 WHEN 0 THEN 'failing' WHEN 1 THEN 'degraded' WHEN 2 THEN NULL WHEN 3 THEN 'unheard of' ELSE 'healthy' END AS health"
_GOOD = "health IN ('healthy', 'degraded')"


@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, health NULLS LAST) AS n FROM (SELECT user_id::VARCHAR AS source, ts, {_PROBES} FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)),
  r AS (SELECT source, ts, n, CASE WHEN {_GOOD} THEN health ELSE 'failing' END AS status, false AS served, CASE WHEN {_GOOD} THEN ts END AS kept_at, CASE WHEN {_GOOD} THEN health END AS kept FROM e WHERE n = 1
    UNION ALL SELECT source, ts, n, CASE WHEN again THEN kept WHEN {_GOOD} THEN health ELSE 'failing' END, again, CASE WHEN NOT again AND {_GOOD} THEN ts ELSE kept_at END, CASE WHEN NOT again AND {_GOOD} THEN health ELSE kept END
    FROM (SELECT e.source, e.ts, e.n, e.health, r.kept, r.kept_at, coalesce(e.ts - r.kept_at < INTERVAL 6 HOUR, false) AS again FROM r JOIN e ON e.source = r.source AND e.n = r.n + 1))
  SELECT source, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS asked, status, served FROM r""")
def verdicts_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").selectExpr("user_id AS source", "ts AS at", _PROBES)
    return verdicts.served_rows(rows, LIFETIME).select("source", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("asked"), "status", "served")


_PLACE = "CASE WHEN c_custkey % 13 <> 0 THEN -84.5{d} + c_custkey % 40 * 0.013{d} END AS x, 33.5{d} + c_custkey % 37 * 0.011{d} AS y"
_DEAL = "-84.5{d} + s_suppkey % 39 * 0.013{d} AS x, 33.504{d} + s_suppkey % 31 * 0.011{d} AS y, s_suppkey % 5 AS acres, s_suppkey * 7919 % 400000 AS price"
_MILES = f"2 * {geometry.RADIUS_MILES} * asin(least(1, sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2))))"


@query(f"""WITH a AS (SELECT c_custkey, {_PLACE.format(d="::DOUBLE")} FROM customer), d AS (SELECT s_suppkey, {_DEAL.format(d="::DOUBLE")}, DATE '2001-11-04' - CAST(s_suppkey * 11 % 500 - 20 AS INT) AS sold FROM supplier),
  sale AS (SELECT DISTINCT c_custkey FROM a, d b WHERE acres > 0 AND price / acres >= 60000 AND sold BETWEEN DATE '2000-11-04' AND DATE '2001-11-04' AND {_MILES} <= 1),
  works AS (SELECT DISTINCT c_custkey FROM a, d b WHERE s_suppkey % 3 = 0 AND {_MILES} <= 1)
  SELECT *, n >= 3 AS outreach FROM (SELECT c_custkey, adjacent, absentee, family, delinquent, long_hold, surrounded, s.c_custkey IS NOT NULL AS recent_sale, w.c_custkey IS NOT NULL AS infrastructure,
    n_signals + (s.c_custkey IS NOT NULL)::INT + (w.c_custkey IS NOT NULL)::INT AS n FROM ({SQL['land_signals']}) l LEFT JOIN sale s USING (c_custkey) LEFT JOIN works w USING (c_custkey))""".replace("AS n FROM (", "AS n_signals FROM (").replace("n >= 3", "n_signals >= 3"))
def land_signals_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit(datetime.date(2001, 11, 4))
    sites = t(spark, sf_dir, "customer").selectExpr("c_custkey", *_items(_PLACE.format(d="D")))
    deals = t(spark, sf_dir, "supplier").selectExpr("s_suppkey", *_items(_DEAL.format(d="D")), "date_sub(DATE '2001-11-04', CAST(s_suppkey * 11 % 500 - 20 AS INT)) AS sold")
    sale = deals.where(signals.recent_sale(F.col("sold"), F.col("price"), F.col("acres"), F.lit(60000), as_of))
    near = signals.with_near(sites, "c_custkey", {"recent_sale": sale, "infrastructure": deals.where("s_suppkey % 3 = 0")}).drop("x", "y")
    six = reports.land_signals(spark, sf_dir).drop("n_signals", "outreach")
    names = [c for c in six.columns if c != "c_custkey"]
    return signals.counted(six.join(near, "c_custkey"), [*names, "recent_sale", "infrastructure"])
