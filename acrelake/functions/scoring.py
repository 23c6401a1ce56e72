"""Sub-scores, composites, strategy fit and gates as plain column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest site for build-to-suit, in acres, and the order in which strategies win.
BTS_MIN_ACRES = 8.609
PRIORITY = ("bts", "spec", "land_bank", "flip", "ground_lease")


def bands(value: Column, steps: list[tuple[str, float, int]], below: int) -> Column:
    """First step (operator, bound, score) that holds gives the score, else ``below``; null stays null."""
    test = {"<": value.__lt__, "<=": value.__le__, ">": value.__gt__, ">=": value.__ge__}
    out = F.lit(below)
    for op, bound, score in reversed(steps):
        out = F.when(test[op](F.lit(bound)), score).otherwise(out)
    return F.when(value.isNotNull(), out)


def vacancy(pct: Column) -> Column:
    return bands(pct, [("<", 3.0, 10), ("<", 5.0, 8), ("<", 7.0, 6), ("<=", 10.0, 3)], 0)


def absorption(sf: Column) -> Column:
    return bands(sf, [(">", 2e6, 10), (">=", 5e5, 7), (">=", -5e5, 4)], 0)


def pipeline_supply(sf: Column) -> Column:
    """No figure counts as no supply."""
    return F.coalesce(bands(sf, [("<=", 0.0, 10), ("<", 5e5, 7), ("<=", 1.5e6, 4)], 0), F.lit(10))


def land_basis(basis: Column, median: Column) -> Column:
    ratio = F.when(median > 0, basis / median)
    return bands(ratio, [("<", 0.95, 10), ("<=", 1.10, 7), ("<=", 1.25, 4)], 0)


def site_shape(area: Column, box: Column, aspect: Column) -> Column:
    fill = F.when((area != 0) & (box != 0), area / box)
    long = F.coalesce(F.when(aspect != 0, aspect), F.lit(99.0))
    best = (fill >= 0.92) & long.between(1.0, 2.0)
    return F.when(fill.isNull(), None).when(best, 10).when((fill >= 0.85) & (long <= 3.0), 7).when(fill >= 0.65, 4).otherwise(0)


def composite(weights: dict[str, int]) -> Column:
    """Weighted mean of the non-null scores, times ten, half-even at two digits; null if nothing weighs."""
    used = {c: w for c, w in weights.items() if w > 0}
    top = reduce(Column.__add__, [F.coalesce(F.col(c).cast("double") * w, F.lit(0.0)) for c, w in used.items()])
    base = reduce(Column.__add__, [F.when(F.col(c).isNotNull(), w).otherwise(0) for c, w in used.items()])
    return F.when(base > 0, F.bround(top / base * 10.0, 2))


def confidence(columns: list[str]) -> Column:
    return reduce(Column.__add__, [F.col(c).isNotNull().cast("int") for c in columns]) / len(columns)


def _at_least(c: Column, bound: int) -> Column:
    return F.coalesce(c >= bound, F.lit(False))


def strategy_fit(s: dict[str, Column], acres: Column) -> dict[str, Column]:
    """Rating of each strategy; ``s`` has s1, s4, s5, s6, s8 and s9."""
    ge = lambda name, bound: _at_least(s[name], bound)
    small = F.coalesce((acres == 0) | (acres < BTS_MIN_ACRES), F.lit(True))
    rate = lambda no, strong, moderate: F.when(no, "N/A").when(strong, "STRONG").when(moderate, "MODERATE").otherwise("WEAK")
    off_scale = ~F.coalesce(s["s8"].isin(10, 7, 4), F.lit(False))
    return {
        "bts": rate(small, ge("s9", 7) & ge("s4", 8) & ge("s5", 8), ge("s9", 4) & ge("s4", 6) & ge("s5", 7)),
        "spec": rate(F.coalesce(s["s4"] < 3, F.lit(False)), ge("s4", 8) & ge("s5", 7) & ge("s6", 7) & ge("s9", 7), ge("s4", 6) & ge("s5", 7) & ge("s9", 4)),
        "land_bank": rate(off_scale, s["s8"] == 10, s["s8"] == 7),
        "ground_lease": rate(small | F.coalesce(s["s1"] < 4, F.lit(False)), ge("s1", 8) & ge("s4", 8) & ge("s9", 7), ge("s1", 6) & ge("s4", 6)),
        "flip": rate(off_scale, (s["s8"] == 10) & ge("s4", 6), s["s8"].isin(10, 7)),
    }


def primary_strategy(fit: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(fit[k] == tier, k) for tier in ("STRONG", "MODERATE") for k in PRIORITY])


def gates(block: Column, fit: dict[str, Column]) -> Column:
    """First failing gate: entitlement, strategy, then any other block; PASS if none fails."""
    some = F.coalesce(block, F.lit("")) != ""
    entitlement = some & F.lower(block).contains("entitlement")
    fits = reduce(Column.__or__, [c.isin("STRONG", "MODERATE") for c in fit.values()])
    return F.when(entitlement, "FAIL:entitlement").when(~fits, "FAIL:strategy").when(some, "FAIL:deal_killer").otherwise("PASS")


def recommendation(score: Column, verdict: Column, threshold: float) -> Column:
    clears = F.coalesce(score, F.lit(-1.0)) >= threshold
    return F.when(~clears, "PASS").when(verdict == "PASS", "PURSUE").otherwise("MONITOR")


def basis(sale_price: Column, sale_date: Column, assessed: Column, acres: Column, as_of: Column, factor: Column) -> Column:
    """Price per acre and where it comes from: a sale of the last 720 days, else the assessment."""
    age = F.datediff(as_of, sale_date)
    recent = (sale_price > 0) & age.between(0, 720)
    known = F.coalesce(acres > 0, F.lit(False))
    row = lambda value, source: F.struct((value / acres).alias("value"), F.lit(source).alias("source"))
    none = F.struct(F.lit(None).cast("double").alias("value"), F.lit("unavailable").alias("source"))
    return F.when(known & recent, row(sale_price.cast("double"), "recent_sale")).when(known & (assessed > 0), row(assessed * factor, "assessed")).otherwise(none)


#: What an assessment counts for by state, and how old a sale may be in days.
INFLATION = {"GA": 2.5}
SALE_DAYS = 720


def basis_by_state(sale_price: Column, sale_date: Column, assessed: Column, acres: Column, state: Column, as_of: Column) -> Column:
    """struct(value, source): price per acre by a recent sale, else by the assessment, which states with a factor inflate."""
    factor = F.coalesce(F.create_map(*[x for k, v in INFLATION.items() for x in (F.lit(k), F.lit(v))])[F.upper(state)], F.lit(1.0))
    inflated = F.coalesce(F.upper(state).isin(*INFLATION), F.lit(False))
    plain = basis(sale_price, sale_date, assessed, acres, as_of, factor)
    source = F.when(plain["source"] != "assessed", plain["source"]).when(inflated, F.concat(F.lit("assessed_inflated_"), F.lower(state))).otherwise("assessed_raw")
    return F.struct(plain["value"].alias("value"), source.alias("source"))


def blockers(verdict: Column, block: Column, size: int = 160) -> Column:
    """map of the failing gate to its reason, at most ``size`` characters; empty where nothing fails."""
    gate = F.split_part(verdict, F.lit(":"), F.lit(2))
    reason = F.when(gate == "strategy", "no strategy is strong or moderate").otherwise(F.substring(block, 1, size))
    return F.when(verdict.startswith("FAIL:"), F.create_map(gate, reason)).otherwise(F.create_map().cast("map<string,string>"))


#: Gates in the order in which they are tried.
GATES = ("control", "entitlement", "strategy", "deal_killer")


def gate_statuses(verdict: Column) -> dict[str, Column]:
    """Display of each gate: those before the failing one pass, those after it are pending; all pass or all are pending otherwise."""
    failed = F.array_position(F.array(*[F.lit(g) for g in GATES]), F.coalesce(F.when(verdict.startswith("FAIL:"), F.substring(verdict, 6, 100)), F.lit("")))
    quiet = F.when(verdict == "PASS", "PASS").otherwise("PENDING")
    return {g: F.when(failed == 0, quiet).when(failed == i, "FAIL").when(failed > i, "PASS").otherwise("PENDING") for i, g in enumerate(GATES, 1)}


def overall_status(score: Column, verdict: Column, threshold: float) -> Column:
    return F.when(verdict == "PASS", "ACTIONABLE").when(score >= threshold, "QUALIFIED — NOT ACTIONABLE").otherwise("BELOW THRESHOLD")


def full_weight_composite(weights: dict[str, int]) -> Column:
    """The composite of reports: every weight counts, whether its score is known or not."""
    top = reduce(Column.__add__, [F.coalesce(F.col(c).cast("double") * w, F.lit(0.0)) for c, w in weights.items()])
    return top / float(sum(weights.values())) * 10.0


def strategies_listed(fit: Column) -> Column:
    """Keys of a map of ratings that are strong or moderate, joined by commas."""
    return F.array_join(F.map_keys(F.map_filter(fit, lambda _, v: v.isin("STRONG", "MODERATE"))), ",")
