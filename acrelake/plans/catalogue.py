"""Queries over the driver's tables, each beside the SQL that must give the same rows.

Nulls that the tables lack are made alike on both sides with nullif.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelake.functions import address, geometry, scoring, text
from acrelake.operators import filters, health, history, spatial
from acrelake.sources import ledger

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


AS_OF = "DATE '2001-11-04'"
LATEST_SQL = "SELECT DISTINCT ON (o_custkey) * FROM orders {where} ORDER BY o_custkey, o_orderdate DESC NULLS FIRST, o_orderkey DESC"


def _latest_orders(orders: DataFrame) -> DataFrame:
    return history.latest(orders, ["o_custkey"], [F.col("o_orderdate").desc_nulls_first(), F.col("o_orderkey").desc()])


@query(f"SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM ({LATEST_SQL.format(where='')})")
def latest_row_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest_orders(t(spark, sf_dir, "orders")).select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")


@query(f"SELECT count(*) AS metric FROM ({LATEST_SQL.format(where=chr(32) + 'WHERE o_orderpriority <> ' + chr(39) + '5-LOW' + chr(39))}) WHERE o_orderstatus = 'F' AND o_totalprice >= 100000")
def metric_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scope is below the pick, status and threshold above it."""
    last = _latest_orders(t(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'"))
    return last.where("o_orderstatus = 'F' AND o_totalprice >= 100000").agg(F.count("*").alias("metric"))


@query(f"SELECT round(coalesce(sum(o_totalprice), 0), 2) AS metric FROM ({LATEST_SQL.format(where='')}) WHERE o_orderstatus = 'F' AND o_totalprice >= 100000")
def metric_weighted_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _latest_orders(t(spark, sf_dir, "orders")).where("o_orderstatus = 'F' AND o_totalprice >= 100000")
    return last.agg(F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("metric"))


@query("SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, ts DESC NULLS FIRST, event_id DESC")
def latest_with_source_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preferred source wins over a newer row."""
    order = [F.when(F.col("event_type") == "purchase", 0).otherwise(1), F.col("ts").desc_nulls_first(), F.col("event_id").desc()]
    return history.latest(t(spark, sf_dir, "events"), ["user_id"], order).select("user_id", "event_id", "event_type")


@query(f"SELECT l_suppkey, count(*) AS n, round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 6) AS median FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_shipdate >= {AS_OF} - INTERVAL 36 MONTH GROUP BY l_suppkey")
def group_median_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").where(f"l_extendedprice IS NOT NULL AND l_shipdate >= {AS_OF} - INTERVAL 36 MONTHS")
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.percentile(F.col("l_extendedprice").cast("double"), F.lit(0.5)), 6).alias("median"))


@query(f"WITH s AS (SELECT o_custkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS status FROM ({LATEST_SQL.format(where=' WHERE year(o_orderdate) = 1996')})) SELECT c_custkey FROM customer LEFT JOIN s ON c_custkey = o_custkey WHERE o_custkey IS NULL OR status = 'P'")
def needs_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A latest row without a status is neither missing nor pending."""
    orders = t(spark, sf_dir, "orders").where("year(o_orderdate) = 1996").withColumnRenamed("o_custkey", "c_custkey")
    order = [F.col("o_orderdate").desc_nulls_first(), F.col("o_orderkey").desc()]
    pending = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")) == "P"
    return history.needs_rescore(t(spark, sf_dir, "customer"), orders, "c_custkey", order, pending).select("c_custkey")


@query("SELECT DISTINCT ON (user_id) user_id, event_id FROM events WHERE event_type = 'error' AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ORDER BY user_id, ts DESC NULLS FIRST, event_id DESC")
def latest_flag_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = t(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    flags = t(spark, sf_dir, "events").where("event_type = 'error'").join(keys, "user_id", "left_semi")
    return history.latest(flags, ["user_id"], [F.col("ts").desc_nulls_first(), F.col("event_id").desc()]).select("user_id", "event_id")


@query("SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS FIRST, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 5")
def topk_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("o_orderdate").desc_nulls_first(), F.col("o_orderkey").desc()]
    return history.top_k(t(spark, sf_dir, "orders"), ["o_custkey"], order, 5).select("o_custkey", "o_orderkey", F.col("rn").cast("long").alias("rn"))


@query("SELECT o_orderkey, p FROM (SELECT o_orderkey, nullif(o_totalprice, 0) AS p FROM orders) ORDER BY CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE p END DESC NULLS LAST, o_orderkey LIMIT 25")
def topk_global_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "orders").select("o_orderkey", F.nullif(F.col("o_totalprice"), F.lit(0.0)).alias("p"))
    return rows.orderBy(F.when(F.col("o_orderkey") % 7 != 0, F.col("p")).desc_nulls_last(), "o_orderkey").limit(25)


@query("SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey JOIN (SELECT o_custkey AS k, max(o_orderdate) AS m FROM orders GROUP BY 1) ON k = o_custkey AND m = o_orderdate")
def latest_with_ties_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tied = history.latest_with_ties(t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate")
    return t(spark, sf_dir, "customer").join(tied, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "o_orderkey")


@query("SELECT event_type, count(*) AS n, max(event_id) AS newest FROM events GROUP BY event_type ORDER BY max(ts) DESC, event_type LIMIT 1")
def latest_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = t(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("m"), F.count("*").alias("n"), F.max("event_id").alias("newest"))
    return groups.orderBy(F.desc("m"), "event_type").limit(1).select("event_type", "n", "newest")


@query("SELECT count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE nullif(n_nationkey % 5, 0) IS NOT NULL")
def join_count_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
    return joined.where("nullif(n_nationkey % 5, 0) IS NOT NULL").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderkey % 7, 0) IS DISTINCT FROM nullif(o_custkey % 7, 0)")
def distinct_from_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.expr("nullif(o_orderkey % 7, 0)"), F.expr("nullif(o_custkey % 7, 0)")
    return t(spark, sf_dir, "orders").where(~a.eqNullSafe(b)).select("o_orderkey")


@query(" UNION ALL ".join(f"SELECT '{x}' AS name, count(*) AS n FROM {x}" for x in ("customer", "supplier", "part", "orders", "lineitem", "events")))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("customer", "supplier", "part", "orders", "lineitem", "events"):
        one = t(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def count_by_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


_MEASURES = """SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_partkey % 130) / 10.0 END AS vacancy,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE (p_partkey * 37) % 3000000 - 900000 END AS absorbed,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_partkey * 7919) % 2000000 END AS supply,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE 80.0 + (p_partkey * 13) % 60 END AS basis, 100.0 + 0 * p_partkey AS median,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE (p_partkey % 200) / 10.0 END AS acres,
  CASE WHEN p_partkey % 6 = 0 THEN 'Entitlement pending' WHEN p_partkey % 10 = 0 THEN 'Flood plain' WHEN p_partkey % 15 = 1 THEN '' END AS block FROM part"""
_SCORES = f"""SELECT *, CASE WHEN vacancy IS NULL THEN NULL WHEN vacancy < 3 THEN 10 WHEN vacancy < 5 THEN 8 WHEN vacancy < 7 THEN 6 WHEN vacancy <= 10 THEN 3 ELSE 0 END AS s4,
  CASE WHEN absorbed IS NULL THEN NULL WHEN absorbed > 2000000 THEN 10 WHEN absorbed >= 500000 THEN 7 WHEN absorbed >= -500000 THEN 4 ELSE 0 END AS s5,
  CASE WHEN supply IS NULL OR supply <= 0 THEN 10 WHEN supply < 500000 THEN 7 WHEN supply <= 1500000 THEN 4 ELSE 0 END AS s6,
  CASE WHEN basis IS NULL THEN NULL WHEN basis / median < 0.95 THEN 10 WHEN basis / median <= 1.10 THEN 7 WHEN basis / median <= 1.25 THEN 4 ELSE 0 END AS s8,
  CASE WHEN id % 3 = 0 THEN NULL ELSE id % 11 END AS s1, 5 + 0 * id AS s9 FROM ({_MEASURES})"""


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    skip = lambda n, c: F.when(p % n != 0, c)
    block = F.when(p % 6 == 0, "Entitlement pending").when(p % 10 == 0, "Flood plain").when(p % 15 == 1, "")
    return t(spark, sf_dir, "part").select(
        p.alias("id"), skip(7, (p % 130) / 10.0).alias("vacancy"), skip(11, (p * 37) % 3_000_000 - 900_000).alias("absorbed"), skip(5, (p * 7919) % 2_000_000).alias("supply"),
        skip(9, 80.0 + (p * 13) % 60).alias("basis"), F.lit(100.0).alias("median"), skip(13, (p % 200) / 10.0).alias("acres"), block.alias("block"),
    )


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _measures(spark, sf_dir).select(
        "*", scoring.vacancy(c("vacancy")).alias("s4"), scoring.absorption(c("absorbed")).alias("s5"), scoring.pipeline_supply(c("supply")).alias("s6"),
        scoring.land_basis(c("basis"), c("median")).alias("s8"), F.when(c("id") % 3 != 0, c("id") % 11).alias("s1"), F.lit(5).alias("s9"),
    )


@query(f"SELECT id, s4, s5, s6, s8 FROM ({_SCORES})")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("id", "s4", "s5", "s6", "s8")


_WEIGHTS = {"s1": 15, "s4": 10, "s5": 10, "s6": 0, "s8": 20, "s9": 5}
_COMPOSITE = "round_even((coalesce(s1 * 15, 0) + coalesce(s4 * 10, 0) + coalesce(s5 * 10, 0) + coalesce(s8 * 20, 0) + s9 * 5)::DOUBLE / (CASE WHEN s1 IS NULL THEN 0 ELSE 15 END + CASE WHEN s4 IS NULL THEN 0 ELSE 10 END + CASE WHEN s5 IS NULL THEN 0 ELSE 10 END + CASE WHEN s8 IS NULL THEN 0 ELSE 20 END + 5) * 10.0, 2)"


@query(f"SELECT id, {_COMPOSITE} AS composite, ((s1 IS NOT NULL)::INT + (s4 IS NOT NULL)::INT + (s5 IS NOT NULL)::INT + (s8 IS NOT NULL)::INT) / 4.0::DOUBLE AS confidence FROM ({_SCORES})")
def composite_weighted_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("id", scoring.composite(_WEIGHTS).alias("composite"), scoring.confidence(["s1", "s4", "s5", "s8"]).alias("confidence"))


_FIT = f"""SELECT *, CASE WHEN acres IS NULL OR acres = 0 OR acres < 8.609 THEN 'N/A' WHEN s9 >= 7 AND s4 >= 8 AND s5 >= 8 THEN 'STRONG' WHEN s9 >= 4 AND s4 >= 6 AND s5 >= 7 THEN 'MODERATE' ELSE 'WEAK' END AS bts,
  CASE WHEN s4 < 3 THEN 'N/A' WHEN s4 >= 8 AND s5 >= 7 AND s6 >= 7 AND s9 >= 7 THEN 'STRONG' WHEN s4 >= 6 AND s5 >= 7 AND s9 >= 4 THEN 'MODERATE' ELSE 'WEAK' END AS spec,
  CASE s8 WHEN 10 THEN 'STRONG' WHEN 7 THEN 'MODERATE' WHEN 4 THEN 'WEAK' ELSE 'N/A' END AS land_bank,
  CASE WHEN acres IS NULL OR acres = 0 OR acres < 8.609 OR s1 < 4 THEN 'N/A' WHEN s1 >= 8 AND s4 >= 8 AND s9 >= 7 THEN 'STRONG' WHEN s1 >= 6 AND s4 >= 6 THEN 'MODERATE' ELSE 'WEAK' END AS ground_lease,
  CASE WHEN s8 = 10 AND s4 >= 6 THEN 'STRONG' WHEN s8 IN (10, 7) THEN 'MODERATE' WHEN s8 = 4 THEN 'WEAK' ELSE 'N/A' END AS flip FROM ({_SCORES})"""
_PRIMARY = "coalesce(" + ", ".join(f"CASE WHEN {k} = '{tier}' THEN '{k}' END" for tier in ("STRONG", "MODERATE") for k in scoring.PRIORITY) + ")"
_GATE = "CASE WHEN lower(block) LIKE '%entitlement%' THEN 'FAIL:entitlement' WHEN NOT (bts IN ('STRONG', 'MODERATE') OR spec IN ('STRONG', 'MODERATE') OR land_bank IN ('STRONG', 'MODERATE') OR ground_lease IN ('STRONG', 'MODERATE') OR flip IN ('STRONG', 'MODERATE')) THEN 'FAIL:strategy' WHEN coalesce(block, '') <> '' THEN 'FAIL:deal_killer' ELSE 'PASS' END"
_VERDICTS = f"SELECT id, acres, {_COMPOSITE} AS composite, {_PRIMARY} AS primary_strategy, {_GATE} AS actionability FROM ({_FIT})"


def _fit() -> dict:
    return scoring.strategy_fit({k: F.col(k) for k in ("s1", "s4", "s5", "s6", "s8", "s9")}, F.col("acres"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = _fit()
    return _scores(spark, sf_dir).select("id", "acres", scoring.composite(_WEIGHTS).alias("composite"), scoring.primary_strategy(fit).alias("primary_strategy"), scoring.gates(F.col("block"), fit).alias("actionability"))


@query(f"SELECT id, bts, spec, land_bank, ground_lease, flip FROM ({_FIT})")
def strategy_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("id", *[c.alias(k) for k, c in _fit().items()])


@query(f"SELECT id, primary_strategy, actionability FROM ({_VERDICTS})")
def gates_first_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("id", "primary_strategy", "actionability")


@query(f"SELECT id, CASE WHEN coalesce(composite, -1) < 60 THEN 'PASS' WHEN actionability = 'PASS' THEN 'PURSUE' ELSE 'MONITOR' END AS recommendation FROM ({_VERDICTS})")
def recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("id", scoring.recommendation(F.col("composite"), F.col("actionability"), 60.0).alias("recommendation"))


@query(f"SELECT count(*) AS total, count(*) FILTER (actionability = 'PASS') AS passed, count(*) FILTER (composite >= 60) AS above, round(coalesce(avg(composite), 0), 4) AS mean FROM ({_VERDICTS})")
def pipeline_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    above = F.count_if(F.col("composite") >= 60)
    return _verdicts(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("actionability") == "PASS").alias("passed"), above.alias("above"), F.round(F.coalesce(F.avg("composite"), F.lit(0.0)), 4).alias("mean"))


@query(f"SELECT k AS strategy, count(v.id) AS n FROM (VALUES ('bts'), ('spec'), ('land_bank'), ('ground_lease'), ('flip')) x(k) LEFT JOIN ({_VERDICTS}) v ON k = primary_strategy AND actionability = 'PASS' GROUP BY k")
def composition_by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five strategies, with zeros."""
    passed = _verdicts(spark, sf_dir).where("actionability = 'PASS'")
    return passed.agg(*[F.count_if(F.col("primary_strategy") == k).alias(k) for k in scoring.PRIORITY]).unpivot([], list(scoring.PRIORITY), "strategy", "n")


@query(f"SELECT id, composite, actionability FROM ({_VERDICTS}) ORDER BY actionability = 'PASS' DESC, composite DESC NULLS LAST, id LIMIT 10")
def top_n_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _verdicts(spark, sf_dir).orderBy((F.col("actionability") == "PASS").desc(), F.col("composite").desc_nulls_last(), "id")
    return ranked.limit(10).select("id", "composite", "actionability")


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 5 AND date_diff('day', l_shipdate::DATE, {AS_OF}) BETWEEN 0 AND 720 THEN l_extendedprice / l_quantity WHEN l_quantity > 5 THEN l_extendedprice * l_discount * 2.5 / l_quantity END AS value FROM (SELECT l_orderkey, l_linenumber, l_shipdate, l_discount, l_extendedprice, CASE WHEN l_quantity > 5 THEN l_quantity END AS l_quantity FROM lineitem) WHERE l_discount > 0")
def basis_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").where("l_discount > 0").withColumn("acres", F.expr("CASE WHEN l_quantity > 5 THEN l_quantity END"))
    value = scoring.basis(F.col("l_extendedprice"), F.col("l_shipdate"), F.expr("l_extendedprice * l_discount"), F.col("acres"), F.expr(AS_OF), F.lit(2.5))
    return rows.select("l_orderkey", "l_linenumber", value["value"].alias("value"))


_OWNER = "CASE WHEN s_suppkey % 8 = 0 THEN '' ELSE list_extract(['Fulton County', 'Acme Corp', 'Oak LLC', 'Smith Family Trust', 'Estate of Ray', 'Ann Smith', 'Trump Jr', 'L L C Holdings'], (s_suppkey % 8 + 1)::INT) END"


@query(f"""SELECT s_suppkey, CASE WHEN n = '' THEN 'unknown' WHEN regexp_matches(u, 'COUNTY|CITY OF|STATE OF|UNITED STATES|BOARD OF') THEN 'government' WHEN regexp_matches(u, 'INC|CORP|CO |GROUP') THEN 'corporate'
  WHEN regexp_matches(u, 'LLC|L L C|LP|LTD') THEN 'llc' WHEN regexp_matches(u, 'TRUST|TR ') THEN 'trust' WHEN regexp_matches(u, 'ESTATE|DECD') THEN 'estate' ELSE 'individual' END AS owner FROM (SELECT s_suppkey, n, upper(n) AS u FROM (SELECT s_suppkey, {_OWNER} AS n FROM supplier))""")
def owner_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("Fulton County", "Acme Corp", "Oak LLC", "Smith Family Trust", "Estate of Ray", "Ann Smith", "Trump Jr", "L L C Holdings")])
    name = F.when(F.col("s_suppkey") % 8 == 0, "").otherwise(F.get(names, (F.col("s_suppkey") % 8).cast("int")))
    return t(spark, sf_dir, "supplier").select("s_suppkey", text.owner_type(name).alias("owner"))


@query("SELECT p_partkey, left(regexp_replace(regexp_replace(lower(trim(p_name || ' / #' || p_partkey)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 60) AS slug FROM part")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", text.slug(F.expr("p_name || ' / #' || p_partkey")).alias("slug"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name || ' ATTN: Unit ' || c_custkey END AS mail FROM customer")
def mailing_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'ATTN: ' WHEN 1 THEN ' c/o ' ELSE '' END")
    some = F.col("c_custkey") % 11 != 0
    return t(spark, sf_dir, "customer").select("c_custkey", text.mailing(F.when(some, F.concat(lead, F.col("c_name"))), F.lit("  "), F.when(some, F.expr("'ATTN: Unit ' || c_custkey"))).alias("mail"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN NULL ELSE o_custkey::DOUBLE END AS value, o_orderkey % 5 = 1 AS bad FROM orders")
def parse_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE o_orderkey % 5 WHEN 0 THEN ' n/a ' WHEN 1 THEN o_custkey || 'd' WHEN 2 THEN '$' || o_custkey WHEN 3 THEN o_custkey || '%' ELSE format_number(o_custkey, 0) END")
    out = text.number(raw)
    return t(spark, sf_dir, "orders").select("o_orderkey", out["value"].alias("value"), out["bad"].alias("bad"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate::DATE END AS day FROM orders")
def parse_date_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') || 'x' WHEN 1 THEN date_format(o_orderdate, 'yyyy-M-d') WHEN 2 THEN date_format(o_orderdate, 'M/d/yyyy') WHEN 3 THEN date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") ELSE date_format(o_orderdate, 'yyyy/MM/dd') END")
    return t(spark, sf_dir, "orders").select("o_orderkey", text.date(raw).alias("day"))


@query("SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.first_seen, b.first_seen) AS first_seen, CASE WHEN b.o_custkey IS NOT NULL THEN b.total ELSE a.total END AS total FROM (SELECT o_custkey, min(o_orderkey) AS first_seen, count(*) AS total FROM orders WHERE year(o_orderdate) < 1996 GROUP BY 1) a FULL JOIN (SELECT o_custkey, min(o_orderkey) AS first_seen, count(*) AS total FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1) b ON a.o_custkey = b.o_custkey")
def upsert_keep_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda w: t(spark, sf_dir, "orders").where(w).groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_seen"), F.count("*").alias("total"))
    return history.upsert(part("year(o_orderdate) < 1996"), part("year(o_orderdate) = 1996"), "o_custkey", ["first_seen"])


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 0) UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 0")
def keyed_replace_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return history.keyed_replace(rows.where("o_orderstatus <> 'F'"), rows.where("o_orderstatus = 'F' AND o_custkey % 3 = 0"), ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return history.insert_absent(rows.where("c_custkey % 2 = 0"), rows.where("c_custkey % 3 = 0").withColumn("c_name", F.upper("c_name")), "c_custkey")


@query("SELECT o_orderkey, x FROM (SELECT o_orderkey, nullif(o_custkey % 4, 0) AS x FROM orders) WHERE x IS DISTINCT FROM 2")
def purge_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.purge(t(spark, sf_dir, "orders").selectExpr("o_orderkey", "nullif(o_custkey % 4, 0) AS x"), "x", 2)


@query("WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY ALL) SELECT user_id, event_type, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS to_insert, least(coalesce(a.n, 0), coalesce(b.n, 0)) AS present, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS right_only FROM a FULL JOIN b USING (user_id, event_type)")
def bag_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return history.bag_difference(rows.where("event_id % 3 <> 0"), rows.where("event_id % 2 = 0"), ["user_id", "event_type"])


@query("SELECT field, round(avg(CASE WHEN value IS NULL OR value IN ('', 'Null', '<Null>', 'None') THEN 0.0 ELSE 1.0 END), 3) AS rate FROM (SELECT 'name' AS field, CASE c_custkey % 4 WHEN 0 THEN '<Null>' WHEN 1 THEN '' ELSE c_name END AS value FROM customer UNION ALL SELECT 'segment', CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END FROM customer) GROUP BY field")
def field_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "customer").selectExpr("CASE c_custkey % 4 WHEN 0 THEN '<Null>' WHEN 1 THEN '' ELSE c_name END AS name", "CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS segment")
    long = rows.unpivot([], ["name", "segment"], "field", "value")
    gone = F.col("value").isNull() | F.col("value").isin("", "Null", "<Null>", "None")
    return long.groupBy("field").agg(F.round(F.avg(F.when(gone, 0.0).otherwise(1.0)), 3).alias("rate"))


@query("SELECT class, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN 'empty' WHEN abs(x) > 180 OR abs(y) > 90 THEN 'out_of_range' WHEN x BETWEEN -85.5 AND -83.5 AND y BETWEEN 32.5 AND 34.5 THEN 'ok' ELSE 'out_of_box' END AS class FROM (SELECT c_custkey, -90.0 + (c_custkey * 17 % 1000) / 100.0 + CASE WHEN c_custkey % 13 = 0 THEN 500 ELSE 0 END AS x, 30.0 + (c_custkey * 29 % 600) / 100.0 AS y FROM customer)) GROUP BY class")
def bbox_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "customer").selectExpr("c_custkey", "-90.0D + (c_custkey * 17 % 1000) / 100.0D + CASE WHEN c_custkey % 13 = 0 THEN 500 ELSE 0 END AS x", "30.0D + (c_custkey * 29 % 600) / 100.0D AS y")
    inside = geometry.envelope(F.col("x"), F.col("y"), -85.5, 32.5, -83.5, 34.5)
    kind = F.when(F.col("c_custkey") % 10 == 0, "empty").when((F.abs("x") > 180) | (F.abs("y") > 90), "out_of_range").when(inside, "ok").otherwise("out_of_box")
    return rows.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, x + y <= 10 AND x >= 0 AND y >= 0 AS inside FROM (SELECT p_partkey, (p_partkey * 7 % 150) / 10.0 + 0.05 AS x, (p_partkey * 11 % 140) / 10.0 + 0.01 AS y FROM part)")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda a, b: F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y"))
    ring = F.array(point(0, 0), point(10, 0), point(0, 10), point(0, 0))
    rows = t(spark, sf_dir, "part").selectExpr("p_partkey", "(p_partkey * 7 % 150) / 10.0D + 0.05D AS x", "(p_partkey * 11 % 140) / 10.0D + 0.01D AS y")
    return rows.select("p_partkey", geometry.contains(ring, F.col("x"), F.col("y")).alias("inside"))


@query("SELECT s_suppkey, (s_suppkey % 9 + 1) * (s_suppkey % 5 + 2)::DOUBLE AS area, (s_suppkey % 9 + 1) / 2.0::DOUBLE AS cx FROM supplier")
def ring_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (F.col("s_suppkey") % 9 + 1).cast("double"), (F.col("s_suppkey") % 5 + 2).cast("double")
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    ring = F.array(p(F.lit(0.0), F.lit(0.0)), p(w, F.lit(0.0)), p(w, h), p(F.lit(0.0), h))
    return t(spark, sf_dir, "supplier").select("s_suppkey", geometry.signed_area(ring).alias("area"), geometry.vertex_centroid(ring)["x"].alias("cx"))


@query(f"SELECT id, CASE WHEN acres IS NULL OR acres < 5 OR acres > 15 THEN 'acreage' WHEN vacancy IS NULL OR vacancy > 9 THEN 'vacancy' END AS reject_reason, CASE WHEN acres BETWEEN 5 AND 15 AND vacancy <= 9 THEN (CASE WHEN block IS NOT NULL THEN 'blocked' ELSE '' END) || (CASE WHEN supply IS NULL THEN '|no_supply' ELSE '' END) ELSE '' END AS flags FROM ({_MEASURES})")
def hard_filter_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejects = [("acreage", ~F.col("acres").between(5, 15)), ("vacancy", F.col("vacancy") > 9)]
    out = filters.judged(_measures(spark, sf_dir), rejects, [("blocked", F.col("block").isNotNull()), ("|no_supply", F.col("supply").isNull())])
    return out.select("id", "reject_reason", F.array_join("flags", "").alias("flags"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+', '[EMAIL]', 'g'), '[+][0-9][ ().0-9-]{8,}[0-9]', '[PHONE]', 'g')) AS digest FROM documents")
def redact_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(text.redact(F.col("text"))).alias("digest"))


@query("SELECT user_id, event_id, CASE WHEN best IS NULL THEN 'baseline' WHEN value > best THEN 'keep' ELSE 'discard' END AS status FROM (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events)")
def decision_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With strict improvement the anchor is the running maximum, which the SQL uses; the fold is the general form."""
    return history.decisions(t(spark, sf_dir, "events"), "user_id", "event_id", "value", "status").select("user_id", "event_id", "status")


_ADDRESSES = (
    "CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN concat('OLD MILL ', CASE WHEN c_custkey % 2 = 0 THEN 'RD' ELSE 'FIELD' END) ELSE concat(cast(c_custkey AS string), ' Main St') END AS site",
    "CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'PO Box 7, Atlanta, GA 30303' WHEN 2 THEN 'P.O. BOX 7, XX 30303' WHEN 3 THEN 'Atlanta GA 30303' ELSE concat(cast(c_custkey AS string), ' Elm Rd, Macon, GA, 31201-0001') END AS mail",
)


@query(
    "SELECT round(s, 3) AS site_rate, round(m, 3) AS mailing_rate, least(s, m) < 0.8 AS failing FROM (SELECT "
    "coalesce(avg(CASE WHEN site <> '' THEN CASE WHEN regexp_matches(site, '^[0-9]+ |RD$') THEN 1.0 ELSE 0.0 END END), 1.0) AS s, "
    "coalesce(avg(CASE WHEN mail <> '' THEN CASE WHEN mail LIKE '%GA%' AND regexp_matches(mail, '^[0-9]+ |PO Box') THEN 1.0 WHEN mail LIKE 'Atlanta GA%' THEN 0.0 ELSE 0.0 END END), 1.0) AS m "
    f"FROM (SELECT {', '.join(_ADDRESSES).replace(' AS string', ' AS VARCHAR')} FROM customer))"
)
def address_parse_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "customer").selectExpr(*_ADDRESSES)
    return rows.agg(*address.rates(F.col("site"), F.col("mail")))


@query("SELECT p_partkey FROM (SELECT p_partkey, (p_partkey * 7 % 150) / 10.0 + 0.05 AS x, (p_partkey * 11 % 140) / 10.0 + 0.01 AS y FROM part) WHERE (x + y <= 10 AND x >= 0 AND y >= 0) OR (x BETWEEN 12 AND 14 AND y BETWEEN 3 AND 8)")
def points_in_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in any of several polygons, which overlap no grid line by chance."""
    points = t(spark, sf_dir, "part").selectExpr("p_partkey", "(p_partkey * 7 % 150) / 10.0D + 0.05D AS x", "(p_partkey * 11 % 140) / 10.0D + 0.01D AS y")
    rings = [([(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)],), ([(12.0, 3.0), (14.0, 3.0), (14.0, 8.0), (12.0, 8.0)],)]
    zones = spark.createDataFrame(rings, "ring array<struct<x: double, y: double>>").withColumn("box", geometry.box(F.col("ring")))
    return spatial.inside(points, zones, cell=0.7).select("p_partkey")


@query(
    "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'commit: wrong form' WHEN event_id % 7 = 0 THEN 'metric: not a count' WHEN NOT event_type IN ('click', 'view') THEN 'status: unknown' END AS error, "
    "printf('%.1f', (event_id % 50) / 2.0) AS wall_clock_min FROM events"
)
def ledger_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 11 = 0 THEN 'ABC' ELSE 'pending' END AS commit", "CASE WHEN event_id % 7 = 0 THEN -1L ELSE event_id END AS metric",
        "0.5D AS confidence", "0L AS api_calls", "(event_id % 50) / 2.0D AS wall_clock_min",
        "CASE event_type WHEN 'click' THEN 'keep' WHEN 'view' THEN ' discard ' ELSE event_type END AS status", "cast(event_id AS string) AS description",
    )
    return ledger.validated(rows).select(F.col("description").cast("long").alias("event_id"), "error", "wall_clock_min")


@query(
    "SELECT user_id AS source, CASE WHEN bool_or(event_type = 'error' AND bad) THEN 'failing' WHEN bool_or(bad) THEN 'degraded' ELSE 'healthy' END AS health, "
    "coalesce(string_agg(DISTINCT CASE WHEN bad THEN event_type END, ',' ORDER BY CASE WHEN bad THEN event_type END), '') AS failed FROM (SELECT user_id, event_type, event_id % 23 = 0 AS bad FROM events) GROUP BY user_id"
)
def health_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = t(spark, sf_dir, "events").selectExpr("user_id AS source", "event_type AS check", "CASE WHEN event_id % 23 = 0 THEN 'fail' ELSE 'pass' END AS status")
    return health.roll_up(checks, ["error"])
