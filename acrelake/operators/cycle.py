"""One scoring cycle as one plan: parcels meet the latest context, the land median and the newest block of their submarket by left
joins, all scores are column expressions, and rows and flags are projections of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelake.functions import scoring
from acrelake.operators import history

#: Names of the sub-scores in order, the fewest comparable sales, and the age in days at which a context is stale.
SUB_SCORES = ("s1", "s2", "s3", "s4", "s5", "s6", "s7", "s8", "s9", "s10", "s11", "s12")
LEAST_COMPS = 3
STALE_DAYS = 30


def latest_context(context: DataFrame, preferred: str) -> DataFrame:
    """One row per submarket: the ``preferred`` source before any other, then the newest date, an unknown date first."""
    return history.latest(context, ["submarket"], [F.when(F.col("source") == preferred, 0).otherwise(1), F.col("as_of").desc_nulls_first(), F.col("context_id")])


def land_medians(sales: DataFrame, as_of: Column, months: int = 36) -> DataFrame:
    """Rows (submarket, median_n, median): the exact interpolated median of known prices; a submarket's prices meet in one task."""
    recent = sales.where(F.col("price").isNotNull() & (F.col("sale_date") >= F.add_months(as_of, -months)))
    return recent.groupBy("submarket").agg(F.count("*").alias("median_n"), F.percentile("price", F.lit(0.5)).alias("median"))


def scored(parcels: DataFrame, context: DataFrame, sales: DataFrame, blocks: DataFrame, as_of: Column, weights: dict[str, int], preferred: str, medians: DataFrame | None = None) -> DataFrame:
    """``parcels`` (parcel_id, submarket, state, acres, sale_price, sale_date, assessed, centroid) with every score. An empty submarket is none,
    and a submarket without context or comps gives null scores, not a lost parcel. ``blocks`` has rows (parcel_id, block);
    ``preferred`` is the source of market figures that goes before others; ``medians``, rows as of :func:`land_medians`, may come from
    elsewhere, as from ``selection.quantiles`` where one submarket has very many sales."""
    key = F.nullif(F.col("submarket"), F.lit(""))
    out = parcels.withColumn("_key", key).join(latest_context(context, preferred).withColumnRenamed("submarket", "_key"), "_key", "left")
    out = out.join((land_medians(sales, as_of) if medians is None else medians).withColumnRenamed("submarket", "_key"), "_key", "left").join(blocks, "parcel_id", "left")
    basis = scoring.basis_by_state(F.col("sale_price"), F.col("sale_date"), F.col("assessed"), F.col("acres"), F.col("state"), as_of)
    out = out.withColumn("basis", basis).withColumn("median_n", F.coalesce("median_n", F.lit(0)))
    enough = F.col("median_n") >= LEAST_COMPS
    known = F.col("context_id").isNotNull()
    out = out.select(
        "*",
        scoring.vacancy(F.col("vacancy")).alias("s4"),
        scoring.absorption(F.col("absorbed")).alias("s5"),
        F.when(known, scoring.pipeline_supply(F.col("supply"))).alias("s6"),
        F.when(enough, scoring.land_basis(F.col("basis.value"), F.col("median"))).alias("s8"),
        F.lit(5).alias("s9"),
        F.when(F.col("in_zone").isNotNull(), F.when(F.col("in_zone"), 4).otherwise(0)).alias("s10"),
        *[F.lit(None).cast("int").alias(s) for s in ("s1", "s2", "s3", "s7", "s11", "s12")],
        F.datediff(as_of, "as_of").alias("stale_days"),
    )
    out = out.select("*", scoring.composite(weights).alias("composite"), scoring.confidence(list(SUB_SCORES)).alias("confidence"))
    fit = scoring.strategy_fit({k: F.col(k) for k in ("s1", "s4", "s5", "s6", "s8", "s9")}, F.col("acres"))
    rated = F.create_map(*[x for k, c in fit.items() for x in (F.lit(k), c)])
    verdict = scoring.gates(F.col("block"), fit)
    return out.select("*", rated.alias("strategy_fit"), scoring.primary_strategy(fit).alias("primary_strategy"), verdict.alias("actionability"), scoring.blockers(verdict, F.col("block")).alias("blockers"))


def flags(rows: DataFrame, cycle: str) -> DataFrame:
    """Rows (parcel_id, flag) of a scored table: each missing score, a stale context, scores of a coarser grain, too few sales."""
    gaps = [F.when(F.col(s).isNull(), F.concat(F.lit(s.upper()), F.lit(" missing"))) for s in SUB_SCORES]
    stale = F.when(F.col("stale_days") > STALE_DAYS, F.format_string("context stale by %dd", "stale_days"))
    coarse = F.when(F.col("s6").isNotNull(), "S6 at submarket grain")
    few = F.when((F.col("median_n") < LEAST_COMPS) & (F.coalesce("submarket", F.lit("")) != ""), F.format_string("S8 has only %d comps", "median_n"))
    return rows.select("parcel_id", F.explode(F.array_compact(F.array(*gaps, stale, coarse, few))).alias("flag")).withColumn("flag", F.concat(F.lit(f"cycle={cycle}; "), F.col("flag")))


def log_rows(rows: DataFrame, cycle: str, market: str) -> DataFrame:
    """The log of a scored table, rows (cycle_id, action_type, market, parcel_id, notes)."""
    composite = F.when(F.col("composite").isNull(), "none").otherwise(F.format_string("%.2f", "composite"))
    notes = F.concat(F.lit("composite="), composite, F.lit("; actionability="), F.coalesce("actionability", F.lit("PENDING")))
    return rows.select(F.lit(cycle).alias("cycle_id"), F.lit("scoring").alias("action_type"), F.lit(market).alias("market"), "parcel_id", notes.alias("notes"))
