"""Queries of the scoring, discovery, ingestion and report cycles, each beside the SQL that must give the same rows."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelake.functions import geometry, scoring, text
from acrelake.operators import cycle, discovery, history, spatial
from acrelake.plans.catalogue import query, t
from acrelake.sources import exports

DAY = datetime.date(1998, 1, 1)
WEIGHTS = {"s1": 15, "s2": 5, "s3": 5, "s4": 10, "s5": 10, "s6": 10, "s7": 10, "s8": 20, "s9": 5, "s10": 0, "s11": 5, "s12": 5}

_PARCELS = """SELECT c_custkey AS parcel_id, CASE WHEN c_custkey % 10 = 0 THEN '' WHEN c_custkey % 11 <> 0 THEN concat('m', CAST(c_custkey % 30 AS {text})) END AS submarket,
  CASE c_custkey % 4 WHEN 0 THEN 'ga' WHEN 1 THEN 'GA' WHEN 2 THEN 'FL' END AS state, CASE WHEN c_custkey % 13 <> 0 THEN CAST(c_custkey % 40 AS DOUBLE) END AS acres,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey * 900 AS DOUBLE) END AS sale_price, CASE WHEN c_custkey % 2 = 0 THEN DATE '1997-06-01' ELSE DATE '1994-01-01' END AS sale_date,
  CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey * 700 AS DOUBLE) END AS assessed, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 9 = 0 END AS in_zone FROM customer"""
_CONTEXT = """SELECT s_suppkey AS context_id, concat('m', CAST(s_suppkey % 25 AS {text})) AS submarket, CASE WHEN s_suppkey % 3 = 0 THEN 'first' ELSE 'other' END AS source,
  CASE WHEN s_suppkey % 17 <> 0 THEN CAST({day} AS DATE) END AS as_of, CASE WHEN s_suppkey % 8 <> 0 THEN (s_suppkey * 7 % 130) / 10.0{d} END AS vacancy,
  CASE WHEN s_suppkey % 9 <> 0 THEN CAST(s_suppkey * 3701 % 3000000 - 900000 AS DOUBLE) END AS absorbed, CASE WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey * 7919 % 2000000 AS DOUBLE) END AS supply FROM supplier"""
_SALES = """SELECT concat('m', CAST(o_custkey % 28 AS {text})) AS submarket, CAST(o_orderdate AS DATE) AS sale_date, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_totalprice AS DOUBLE) / 10 END AS price
  FROM orders WHERE o_custkey % 28 <> 5 OR o_orderkey % 500 = 1"""
_BLOCKS = "SELECT c_custkey AS parcel_id, CASE c_custkey % 12 WHEN 0 THEN 'Entitlement pending' WHEN 6 THEN 'Flood plain' ELSE '' END AS block FROM customer WHERE c_custkey % 3 = 0"


def _spark(sql: str) -> str:
    return sql.format(text="STRING", day="date_add(DATE '1997-10-01', CAST(s_suppkey % 90 AS INT))", d="D")


def _duck(sql: str) -> str:
    return sql.format(text="VARCHAR", day="DATE '1997-10-01' + CAST(s_suppkey % 90 AS INT)", d="::DOUBLE")


def _inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    out = {}
    for name, base, sql in (("parcels", "customer", _PARCELS), ("context", "supplier", _CONTEXT), ("sales", "orders", _SALES), ("blocks", "customer", _BLOCKS)):
        select, where = _spark(sql).replace("\n", " ").split(f" FROM {base}")
        rows = t(spark, sf_dir, base)
        out[name] = (rows.where(where.replace("WHERE", "", 1)) if where.strip() else rows).selectExpr(*_items(select.removeprefix("SELECT ")))
    return out


def _items(select: str) -> list[str]:
    """The columns of a select list: cut at commas outside of brackets and quotes."""
    items, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(select):
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")") if not quoted else 0
        if c == "," and not depth and not quoted:
            items.append(select[start:i])
            start = i + 1
    return [*items, select[start:]]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _inputs(spark, sf_dir)
    return cycle.scored(x["parcels"], x["context"], x["sales"], x["blocks"], F.lit(DAY), WEIGHTS, "first")


_LATEST = f"SELECT DISTINCT ON (submarket) * FROM ({_duck(_CONTEXT)}) ORDER BY submarket, CASE WHEN source = 'first' THEN 0 ELSE 1 END, as_of DESC NULLS FIRST, context_id"
_MEDIANS = f"SELECT submarket, count(*) AS median_n, quantile_cont(price, 0.5) AS median FROM ({_duck(_SALES)}) WHERE price IS NOT NULL AND sale_date >= DATE '1995-01-01' GROUP BY submarket"
_JOINED = f"""SELECT p.*, c.* EXCLUDE (submarket), coalesce(m.median_n, 0) AS median_n, m.median, b.block,
  CASE WHEN acres > 0 AND sale_price > 0 AND date_diff('day', sale_date, DATE '1998-01-01') BETWEEN 0 AND 720 THEN sale_price / acres
    WHEN acres > 0 AND assessed > 0 THEN assessed * (CASE WHEN upper(state) = 'GA' THEN 2.5 ELSE 1.0 END) / acres END AS basis,
  CASE WHEN acres > 0 AND sale_price > 0 AND date_diff('day', sale_date, DATE '1998-01-01') BETWEEN 0 AND 720 THEN 'recent_sale'
    WHEN acres > 0 AND assessed > 0 THEN CASE WHEN upper(state) = 'GA' THEN 'assessed_inflated_ga' ELSE 'assessed_raw' END ELSE 'unavailable' END AS basis_source
  FROM ({_duck(_PARCELS)}) p LEFT JOIN ({_LATEST}) c ON nullif(p.submarket, '') = c.submarket LEFT JOIN ({_MEDIANS}) m ON nullif(p.submarket, '') = m.submarket LEFT JOIN ({_BLOCKS}) b ON p.parcel_id = b.parcel_id"""
_S = f"""SELECT *, CASE WHEN vacancy IS NULL THEN NULL WHEN vacancy < 3 THEN 10 WHEN vacancy < 5 THEN 8 WHEN vacancy < 7 THEN 6 WHEN vacancy <= 10 THEN 3 ELSE 0 END AS s4,
  CASE WHEN absorbed IS NULL THEN NULL WHEN absorbed > 2000000 THEN 10 WHEN absorbed >= 500000 THEN 7 WHEN absorbed >= -500000 THEN 4 ELSE 0 END AS s5,
  CASE WHEN context_id IS NULL THEN NULL WHEN supply IS NULL OR supply <= 0 THEN 10 WHEN supply < 500000 THEN 7 WHEN supply <= 1500000 THEN 4 ELSE 0 END AS s6,
  CASE WHEN median_n < 3 OR basis IS NULL OR median IS NULL OR median <= 0 THEN NULL WHEN basis / median < 0.95 THEN 10 WHEN basis / median <= 1.10 THEN 7 WHEN basis / median <= 1.25 THEN 4 ELSE 0 END AS s8,
  5 AS s9, CASE WHEN in_zone IS NULL THEN NULL WHEN in_zone THEN 4 ELSE 0 END AS s10, date_diff('day', as_of, DATE '1998-01-01') AS stale_days FROM ({_JOINED})"""
_TOP = "(coalesce(s4 * 10, 0) + coalesce(s5 * 10, 0) + coalesce(s6 * 10, 0) + coalesce(s8 * 20, 0) + s9 * 5)::DOUBLE"
_BASE = "(CASE WHEN s4 IS NULL THEN 0 ELSE 10 END + CASE WHEN s5 IS NULL THEN 0 ELSE 10 END + CASE WHEN s6 IS NULL THEN 0 ELSE 10 END + CASE WHEN s8 IS NULL THEN 0 ELSE 20 END + 5)"
_KNOWN = "((s4 IS NOT NULL)::INT + (s5 IS NOT NULL)::INT + (s6 IS NOT NULL)::INT + (s8 IS NOT NULL)::INT + 1 + (s10 IS NOT NULL)::INT)"
_RATED = f"""SELECT *, round_even({_TOP} / {_BASE} * 10.0, 2) AS composite, {_KNOWN} / 12.0::DOUBLE AS confidence,
  CASE WHEN acres IS NULL OR acres < 8.609 THEN 'N/A' WHEN s9 >= 7 AND s4 >= 8 AND s5 >= 8 THEN 'STRONG' WHEN s9 >= 4 AND s4 >= 6 AND s5 >= 7 THEN 'MODERATE' ELSE 'WEAK' END AS bts,
  CASE WHEN s4 < 3 THEN 'N/A' WHEN s4 >= 6 AND s5 >= 7 AND s9 >= 4 THEN 'MODERATE' ELSE 'WEAK' END AS spec,
  CASE s8 WHEN 10 THEN 'STRONG' WHEN 7 THEN 'MODERATE' WHEN 4 THEN 'WEAK' ELSE 'N/A' END AS land_bank, CASE WHEN acres IS NULL OR acres < 8.609 THEN 'N/A' ELSE 'WEAK' END AS ground_lease,
  CASE WHEN s8 = 10 AND s4 >= 6 THEN 'STRONG' WHEN s8 IN (10, 7) THEN 'MODERATE' WHEN s8 = 4 THEN 'WEAK' ELSE 'N/A' END AS flip FROM ({_S})"""
_LISTED = "concat_ws(',', " + ", ".join(f"CASE WHEN {k} IN ('STRONG', 'MODERATE') THEN '{k}' END" for k in ("bts", "spec", "land_bank", "ground_lease", "flip")) + ")"
_JUDGED = f"""SELECT *, {_LISTED} AS strategies, coalesce({", ".join(f"CASE WHEN {k} = '{tier}' THEN '{k}' END" for tier in ("STRONG", "MODERATE") for k in scoring.PRIORITY)}) AS primary_strategy,
  CASE WHEN lower(block) LIKE '%entitlement%' THEN 'FAIL:entitlement' WHEN {_LISTED} = '' THEN 'FAIL:strategy' WHEN coalesce(block, '') <> '' THEN 'FAIL:deal_killer' ELSE 'PASS' END AS actionability FROM ({_RATED})"""


@query(f"SELECT parcel_id, s4, s5, s6, stale_days, source FROM ({_S})")
def market_context_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("parcel_id", "s4", "s5", "s6", "stale_days", "source")


@query(f"SELECT parcel_id, round(basis, 4) AS basis, basis_source, median_n, round(median, 4) AS median, s8 FROM ({_S})")
def land_basis_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    return rows.select("parcel_id", F.round("basis.value", 4).alias("basis"), F.col("basis.source").alias("basis_source"), "median_n", F.round("median", 4).alias("median"), "s8")


@query(f"SELECT parcel_id, s9, s10, composite, round(confidence, 6) AS confidence, strategies, primary_strategy, actionability FROM ({_JUDGED})")
def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    return rows.select("parcel_id", "s9", "s10", "composite", F.round("confidence", 6).alias("confidence"), scoring.strategies_listed(F.col("strategy_fit")).alias("strategies"), "primary_strategy", "actionability")


_GAPS = " UNION ALL ".join([f"SELECT parcel_id, '{s.upper()} missing' AS flag FROM s" + (f" WHERE {s} IS NULL" if s in ("s4", "s5", "s6", "s8", "s10") else " WHERE false" if s == "s9" else "") for s in cycle.SUB_SCORES])


@query(
    f"WITH s AS ({_S}) SELECT parcel_id, 'cycle=score-1; ' || flag AS flag FROM ({_GAPS} UNION ALL SELECT parcel_id, 'context stale by ' || stale_days || 'd' FROM s WHERE stale_days > 30 "
    "UNION ALL SELECT parcel_id, 'S6 at submarket grain' FROM s WHERE s6 IS NOT NULL UNION ALL SELECT parcel_id, 'S8 has only ' || median_n || ' comps' FROM s WHERE median_n < 3 AND coalesce(submarket, '') <> '')"
)
def score_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycle.flags(_scored(spark, sf_dir), "score-1")


@query(f"""SELECT parcel_id, CASE WHEN actionability = 'PASS' THEN 'PASS' WHEN actionability = 'FAIL:control' THEN 'FAIL' ELSE 'PASS' END AS control,
  CASE WHEN actionability = 'FAIL:entitlement' THEN 'FAIL' ELSE 'PASS' END AS entitlement, CASE actionability WHEN 'FAIL:strategy' THEN 'FAIL' WHEN 'FAIL:entitlement' THEN 'PENDING' ELSE 'PASS' END AS strategy,
  CASE actionability WHEN 'FAIL:deal_killer' THEN 'FAIL' WHEN 'PASS' THEN 'PASS' ELSE 'PENDING' END AS deal_killer, CASE WHEN actionability = 'PASS' THEN 'ACTIONABLE' WHEN composite >= 60 THEN 'QUALIFIED — NOT ACTIONABLE' ELSE 'BELOW THRESHOLD' END AS overall,
  CASE actionability WHEN 'PASS' THEN NULL WHEN 'FAIL:strategy' THEN 'no strategy is strong or moderate' ELSE block END AS reason, round({_TOP} / 100.0 * 10.0, 2) AS full_composite FROM ({_JUDGED})""")
def gate_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, verdict = _scored(spark, sf_dir), F.col("actionability")
    shown = [c.alias(g) for g, c in scoring.gate_statuses(verdict).items()]
    reason = F.element_at(F.map_values("blockers"), 1)
    return rows.select("parcel_id", *shown, scoring.overall_status(F.col("composite"), verdict, 60.0).alias("overall"), F.when(F.size("blockers") > 0, reason).alias("reason"), F.round(scoring.full_weight_composite(WEIGHTS), 2).alias("full_composite"))


@query(f"SELECT coalesce(nullif(submarket, ''), '(unset)') AS submarket, count(*) AS n FROM ({_JUDGED}) GROUP BY 1 ORDER BY n DESC, submarket LIMIT 10")
def composition_by_submarket(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.coalesce(F.nullif("submarket", F.lit("")), F.lit("(unset)"))
    return _scored(spark, sf_dir).groupBy(name.alias("submarket")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "submarket").limit(10)


@query(f"SELECT actionability, count(*) AS n FROM ({_JUDGED}) GROUP BY 1")
def composition_by_actionability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy(F.coalesce("actionability", F.lit("PENDING")).alias("actionability")).agg(F.count("*").alias("n"))


_STATS = """SELECT p_partkey AS id, CASE WHEN p_partkey % 17 = 0 THEN ' ' ELSE p_brand END AS submarket_name, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE 'Atlanta' END AS market,
  CASE p_partkey % 7 WHEN 0 THEN 'soon' WHEN 1 THEN '' ELSE '2026-04-27' END AS report_date, CASE p_partkey % 5 WHEN 0 THEN 'x1' WHEN 1 THEN '150' ELSE '5.4%' END AS vacancy_rate_pct,
  CASE p_partkey % 3 WHEN 0 THEN '-4' ELSE 'n/a' END AS availability_rate_pct, CASE p_partkey % 11 WHEN 0 THEN 'y' WHEN 1 THEN '$0' ELSE '$7.85' END AS asking_rent_nnn_psf,
  '1,000' AS total_inventory_sf, '' AS under_construction_sf, NULL AS proposed_sf, '-5' AS net_absorption_t12_sf FROM part"""


@query(f"""SELECT id, CASE WHEN trim(submarket_name) = '' THEN 'submarket_name: required' WHEN market IS NULL THEN 'market: required' WHEN report_date = 'soon' THEN 'report_date: not a date' WHEN report_date = '' THEN 'report_date: required'
  WHEN vacancy_rate_pct = 'x1' OR asking_rent_nnn_psf = 'y' THEN concat_ws('; ', CASE WHEN vacancy_rate_pct = 'x1' THEN 'vacancy_rate_pct: not a number' END, CASE WHEN asking_rent_nnn_psf = 'y' THEN 'asking_rent_nnn_psf: not a number' END)
  WHEN vacancy_rate_pct = '150' THEN 'vacancy_rate_pct: out of range' WHEN availability_rate_pct = '-4' THEN 'availability_rate_pct: out of range' WHEN asking_rent_nnn_psf = '$0' THEN 'asking_rent_nnn_psf: out of range' END AS error FROM ({_STATS})""")
def row_validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    select = _STATS.replace("\n", " ").removeprefix("SELECT ").removesuffix(" FROM part").replace("NULL AS proposed_sf", "CAST(NULL AS STRING) AS proposed_sf").replace("THEN NULL ELSE", "THEN CAST(NULL AS STRING) ELSE")
    raw = t(spark, sf_dir, "part").selectExpr(*_items(select))
    # the number travels in a column that no check reads
    checked = exports.validated(raw.withColumn("net_absorption_t12_sf", F.col("id").cast("string")), exports.SUBMARKET_STATS)
    return checked.select(F.col("net_absorption_t12_sf").alias("id"), "error")


_OLD = "SELECT lower(p_brand) AS k, min(p_brand) AS name FROM part WHERE p_partkey % 4 = 0 GROUP BY 1"
_NEW = "SELECT lower(p_brand) AS k, CASE WHEN p_partkey % 3 = 0 THEN concat(p_brand, ' x') ELSE p_brand END AS name FROM part WHERE p_partkey % 5 = 0"


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = t(spark, sf_dir, "part")
    old = part.where("p_partkey % 4 = 0").groupBy(F.lower("p_brand").alias("k")).agg(F.min("p_brand").alias("name"))
    return old, part.where("p_partkey % 5 = 0").select(F.lower("p_brand").alias("k"), F.expr("CASE WHEN p_partkey % 3 = 0 THEN concat(p_brand, ' x') ELSE p_brand END").alias("name"))


@query(f"SELECT DISTINCT k FROM ({_NEW}) WHERE k NOT IN (SELECT k FROM ({_OLD}) WHERE k <> 'brand#13')")
def ensure_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _named(spark, sf_dir)
    return history.created(old.where("k <> 'brand#13'"), new, "k").select("k")


@query(f"SELECT DISTINCT n.k, o.name AS existing, n.name AS incoming FROM ({_NEW}) n JOIN ({_OLD}) o ON n.k = o.k WHERE o.name <> '' AND o.name <> n.name")
def name_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.name_drift(*_named(spark, sf_dir), "k", "name")


@query("SELECT c_custkey, 'Atlanta' AS market, c_custkey % 4 NOT IN (1, 2) AS used_default FROM customer")
def market_of_county(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text.market_of(F.expr("CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' Fulton ' WHEN 2 THEN 'COBB' ELSE 'Bibb' END"))
    return t(spark, sf_dir, "customer").select("c_custkey", out["market"].alias("market"), out["used_default"].alias("used_default"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 1) THEN NULL WHEN o_orderkey % 4 = 2 THEN o_custkey + 0.75 ELSE -(o_custkey + 0.5) END::DOUBLE AS x, CASE WHEN o_orderkey % 4 IN (0, 1) THEN NULL WHEN o_orderkey % 4 = 2 THEN o_custkey ELSE -o_custkey END::BIGINT AS n FROM orders")
def coerce_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE o_orderkey % 4 WHEN 0 THEN concat('$', o_custkey) WHEN 1 THEN ' ' WHEN 2 THEN concat(' ', o_custkey, '.75\t') ELSE concat('-', o_custkey, '.5') END")
    return t(spark, sf_dir, "orders").select("o_orderkey", text.lenient_double(raw).alias("x"), text.lenient_long(raw).alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'k' || (event_id % 7) END AS last_marker, coalesce(CASE WHEN event_id % 2 = 0 THEN event_type END, '') AS kind FROM events")
def markers_and_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    note = F.expr("CASE WHEN event_id % 3 = 0 THEN 'none' ELSE concat('exp=old exp=k', event_id % 7, ' end') END")
    doc = F.expr("CASE WHEN event_id % 2 = 0 THEN concat('{\"kind\": \"', event_type, '\"}') ELSE '{broken' END")
    return t(spark, sf_dir, "events").select("event_id", text.marker(note, r"exp=(\w+)").alias("last_marker"), F.coalesce(text.json_or_empty(doc)["kind"], F.lit("")).alias("kind"))


_RUNS = "SELECT user_id, event_id, event_id % 5 AS metric, (event_id % 4) / 4.0{d} AS confidence, CASE WHEN event_id % 13 = 0 THEN 'crash' WHEN event_id % 17 = 0 THEN 'timeout' ELSE 'ok' END AS state FROM events"


@query(
    # with a lexical order of (metric, confidence) the anchor is the running maximum of both
    f"SELECT user_id, event_id, CASE WHEN state <> 'ok' THEN state WHEN best IS NULL THEN 'baseline' WHEN metric * 10 + confidence > best THEN 'keep' ELSE 'discard' END AS status FROM (SELECT *, max(CASE WHEN state = 'ok' THEN metric * 10 + confidence END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM ({_RUNS.format(d='::DOUBLE')}))"
)
def decision_tie_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").selectExpr(*_items(_RUNS.format(d="D").removeprefix("SELECT ").removesuffix(" FROM events")))
    return history.decisions(rows, "user_id", "event_id", "metric", "status", "confidence", "state")


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type IN ('click', 'view') THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM events")
def last_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").withColumn("status", F.expr("CASE event_type WHEN 'click' THEN 'keep' WHEN 'view' THEN 'baseline' ELSE 'discard' END"))
    return history.last_anchor(rows, "user_id", "event_id", "status", "value").select("user_id", "event_id", "anchor")


@query("SELECT c_custkey % 20 AS g, count(*) AS sample_size, count(*) FILTER (c_custkey % 6 = 0) AS redacted_count, count(*) FILTER (c_custkey % 6 = 1) AS too_short_count, count(*) FILTER (c_custkey % 6 = 0) > 0 AS failing FROM customer GROUP BY 1")
def owner_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.expr("CASE c_custkey % 6 WHEN 0 THEN 'With-held by owner' WHEN 1 THEN ' AB ' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE c_name END")
    return t(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 20).alias("g")).agg(*discovery.owner_redaction(owner))


@query("SELECT n_name AS logical, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN lower(n_name) ELSE n_name || 'X' END AS configured, CASE n_nationkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'case' ELSE 'missing' END AS outcome, CASE WHEN n_nationkey % 3 = 1 THEN n_name END AS actual FROM nation WHERE n_nationkey <> 4")
def field_mapping_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = t(spark, sf_dir, "nation")
    mapping = nation.selectExpr("n_name AS logical", "CASE WHEN n_nationkey = 4 THEN NULL WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN lower(n_name) ELSE n_name || 'X' END AS configured")
    return discovery.mapping_check(mapping, nation.select(F.col("n_name").alias("name")))


@query("SELECT c_custkey, 'H' || h AS filter, 'H' || h || ': data not joined' AS reason FROM customer, range(3, 11) x(h) WHERE c_acctbal > 0")
def flag_only_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.flag_only(t(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey")


@query("""SELECT CASE WHEN c_custkey % 9 <> 0 THEN 'f:' || c_custkey END AS parcel_id, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal::DOUBLE END AS acreage, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS owner_name,
  CASE WHEN c_custkey % 3 = 0 THEN 'Box 1 Macon' ELSE 'Box 1' END AS owner_mailing_address, c_custkey % 8 = 0 AS multipolygon,
  CASE WHEN c_custkey % 9 = 0 THEN 'no key' WHEN c_custkey % 7 = 0 THEN 'no polygon' WHEN c_custkey % 10 = 0 AND c_custkey % 8 <> 0 THEN 'centre not in degrees' END AS skip_reason,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 10 = 0 AND c_custkey % 8 <> 0 THEN 401.5 ELSE 1.5 END::DOUBLE AS cx, CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 10 = 0 AND c_custkey % 8 <> 0 THEN 'POLYGON((400.0 0.0, 403.0 0.0, 403.0 3.0, 400.0 3.0))' ELSE 'POLYGON((0.0 0.0, 3.0 0.0, 3.0 3.0, 0.0 3.0))' END END AS wkt
  FROM (SELECT * FROM customer WHERE c_custkey % 8 <> 0 OR c_custkey % 7 <> 0)""")
def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    square = lambda x: f"array(struct({x}.0D AS x, 0.0D AS y), struct({x + 3}.0D AS x, 0.0D AS y), struct({x + 3}.0D AS x, 3.0D AS y), struct({x}.0D AS x, 3.0D AS y))"
    hole = "array(struct(1.0D AS x, 1.0D AS y), struct(1.0D AS x, 2.0D AS y), struct(2.0D AS x, 1.0D AS y))"
    small = "array(struct(7.0D AS x, 7.0D AS y), struct(8.0D AS x, 7.0D AS y), struct(8.0D AS x, 8.0D AS y))"
    rows = t(spark, sf_dir, "customer").where("c_custkey % 8 <> 0 OR c_custkey % 7 <> 0").selectExpr(
        "'area' AS area",
        "map('ID', CASE WHEN c_custkey % 9 <> 0 THEN concat(' ', c_custkey) ELSE ' ' END, 'AC', CASE WHEN c_custkey % 4 <> 0 THEN cast(c_acctbal AS string) ELSE 'n/a' END, 'OW', CASE WHEN c_custkey % 5 <> 0 THEN c_name END, 'M1', 'ATTN: Box 1', 'M2', CASE WHEN c_custkey % 3 = 0 THEN ' Macon' END) AS attributes",
        f"CASE WHEN c_custkey % 7 = 0 THEN cast(array() AS array<array<struct<x: double, y: double>>>) WHEN c_custkey % 8 = 0 THEN array({small}, {square(0)}, {hole}) ELSE array(CASE WHEN c_custkey % 10 = 0 THEN {square(400)} ELSE {square(0)} END, {hole}) END AS rings",
    )
    names = {"parcel_id": "ID", "acreage": "AC", "owner_name": "OW", "mailing_1": "M1", "mailing_2": "M2"}
    out = discovery.parcels(rows, names, "f:", "Atlanta", "service", F.lit("2026-01-01"))
    return out.select("parcel_id", "acreage", "owner_name", "owner_mailing_address", "multipolygon", "skip_reason", F.col("center.x").alias("cx"), geometry.wkt(F.col("ring")).alias("wkt"))


_SPOTS = "SELECT c_custkey, -84.0{d} + (c_custkey * 17 % 500) / 100.0{d} AS x, 33.0{d} + (c_custkey * 29 % 400) / 100.0{d} AS y FROM customer"
_SITES = "SELECT -84.0{d} + (s_suppkey * 31 % 500) / 100.0{d} AS x, 33.0{d} + (s_suppkey * 13 % 400) / 100.0{d} AS y FROM supplier WHERE s_suppkey % 5 = 0"


@query(f"SELECT c_custkey FROM ({_SPOTS.format(d='::DOUBLE')}) a WHERE EXISTS (SELECT 1 FROM ({_SITES.format(d='::DOUBLE')}) b WHERE 2 * 3958.7613 * asin(sqrt(least(1.0, pow(sin((radians(b.y) - radians(a.y)) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin((radians(b.x) - radians(a.x)) / 2), 2)))) <= 2.0)")
def points_within_miles(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = t(spark, sf_dir, "customer").selectExpr(*_items(_SPOTS.format(d="D").removeprefix("SELECT ").removesuffix(" FROM customer")))
    sites = t(spark, sf_dir, "supplier").where("s_suppkey % 5 = 0").selectExpr(*_items(_SITES.format(d="D").removeprefix("SELECT ").split(" FROM ")[0]))
    return spatial.within_miles(spots, sites, 2.0).select("c_custkey")


@query("SELECT o_custkey, o_orderkey, 1000 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id FROM orders WHERE o_orderkey % 3 = 0")
def append_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = spark.createDataFrame([(0, 0, 1000)], "o_custkey long, o_orderkey long, id long")
    new = t(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select("o_custkey", "o_orderkey", "o_orderdate")
    return history.append_numbered(old.withColumn("o_orderdate", F.lit(None).cast(dict(new.dtypes)["o_orderdate"])), new, "id", ["o_orderdate", "o_orderkey"]).where("id > 1000").select("o_custkey", "o_orderkey", "id")


@query("SELECT DISTINCT c_mktsegment AS submarket FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AND c_mktsegment IS NOT NULL")
def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = t(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return t(spark, sf_dir, "customer").join(keys, "c_custkey", "left_semi").where("c_mktsegment IS NOT NULL").select(F.col("c_mktsegment").alias("submarket")).distinct()


@query("SELECT event_id, user_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 25")
def recent_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = t(spark, sf_dir, "events")
    newest = events.agg(F.max("ts").alias("_newest"))  # one row
    rows = events.where("event_type = 'error'").crossJoin(F.broadcast(newest)).where("ts >= _newest - INTERVAL 7 DAYS")
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "user_id", "ts")


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey = 1 AND o_orderstatus = 'F') + (SELECT count(*) FROM orders WHERE o_orderkey = 3) > 0 AS taken")
def collision_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a cycle id was used before: at most one row is read on."""
    orders = t(spark, sf_dir, "orders").where("(o_orderkey = 1 AND o_orderstatus = 'F') OR o_orderkey = 3")
    return orders.limit(1).agg((F.count("*") > 0).alias("taken"))


@query("SELECT o_orderkey, coalesce(c_name, '—') AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = t(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return t(spark, sf_dir, "orders").join(names, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.lit("—")).alias("name"))


@query(f"SELECT c_custkey, p.x AS lng, p.y AS lat FROM (SELECT c_custkey, {{'x': x, 'y': y}} AS p FROM ({_SPOTS.format(d='::DOUBLE')}))")
def centroid_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = t(spark, sf_dir, "customer").selectExpr(*_items(_SPOTS.format(d="D").removeprefix("SELECT ").removesuffix(" FROM customer")))
    return spots.select("c_custkey", F.struct("x", "y").alias("centroid")).select("c_custkey", F.col("centroid.x").alias("lng"), F.col("centroid.y").alias("lat"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, count(*) FILTER (user_id % 2 = 0) / count(*)::DOUBLE AS conversion_rate, CASE WHEN count(*) FILTER (value > 1e12) > 0 THEN 1.0 END AS scoring_rate FROM events GROUP BY event_type")
def cycle_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and ratios of a cycle; a ratio over nothing is null."""
    even, none = F.count_if(F.col("user_id") % 2 == 0), F.count_if(F.col("value") > 1e12)
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.try_divide(even, F.count("*")).alias("conversion_rate"), F.try_divide(none, none).alias("scoring_rate"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC) AS rn FROM orders)
  SELECT c_custkey, c_name, s.o_orderkey AS newest, coalesce(array_to_string(k.keys, ','), '') AS recent FROM customer JOIN r s ON s.o_custkey = c_custkey AND s.rn = 1
  LEFT JOIN (SELECT o_custkey, list(o_orderkey ORDER BY rn) AS keys FROM r WHERE rn <= 5 AND o_totalprice > 50000 GROUP BY 1) k ON k.o_custkey = c_custkey""")
def snapshot_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer that has an order, its newest one, and those of its five newest that count, in order."""
    order = [F.col("o_orderdate").desc_nulls_first(), F.col("o_orderkey").desc()]
    top = history.top_k(t(spark, sf_dir, "orders"), ["o_custkey"], order, 5)
    kept = F.when(F.col("o_totalprice") > 50000, F.struct("rn", "o_orderkey"))
    one = top.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("rn") == 1, F.col("o_orderkey"))).alias("newest"), F.array_sort(F.collect_list(kept)).alias("k"))
    recent = F.array_join(F.transform("k", lambda x: x["o_orderkey"].cast("string")), ",")
    return t(spark, sf_dir, "customer").join(one, "c_custkey").select("c_custkey", "c_name", "newest", recent.alias("recent"))


@query("SELECT entity, a, b, abs(a - b) / a > 0.05 AS conflict FROM (SELECT p_partkey AS entity, (p_partkey % 100 + 1)::DOUBLE AS a, (p_partkey % 100 + 1) * (1 + (p_partkey % 11) / 100.0::DOUBLE) + 0.001 AS b FROM part)")
def acreage_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "part").selectExpr("p_partkey AS entity", "cast(p_partkey % 100 + 1 AS double) AS a", "(p_partkey % 100 + 1) * (1 + (p_partkey % 11) / 100.0D) + 0.001D AS b")
    return rows.withColumn("conflict", F.try_divide(F.abs(F.col("a") - F.col("b")), F.col("a")) > 0.05)


@query("SELECT p_partkey, '{\"brand\":\"' || p_brand || '\",\"size\":\"' || p_size || '\"}' AS raw FROM part")
def raw_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", F.to_json(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))).alias("raw"))
