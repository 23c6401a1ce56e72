"""What keeps scores and sources in order: moved scores, late exports, assemblages, health of markets, masked fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelake.operators.signals import touching

#: Points that a score must move to be logged; days late that warn and that alert.
LEAST_MOVE = 5.0
WARN_DAYS, ALERT_DAYS = 7, 14
#: Acres below which a parcel is undersized, acres of a site, neighbours that one may take.
UNDERSIZED, SITE_ACRES, NEIGHBOURS = 10.0, 15.0, 3
#: Texts that stand for masked ones, and the pattern of a person's name.
REDACTED, FAILSAFE = "[REDACTED]", "[REDACTION_FAILSAFE]"
PERSON = r"\b[A-Z][a-z]{1,}\s+[A-Z][a-z]{1,}\b|\b[A-Z]{2,}\s+[A-Z]{2,}(?:\s+[A-Z]{1,3})?\b"


def moved(scores: DataFrame, keys: list[str], order: list[Column], score: str, least: float = LEAST_MOVE) -> DataFrame:
    """The rows of ``scores`` whose score is ``least`` or more away from the key's last known score before them, with ``before`` and ``delta``."""
    earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = scores.withColumn("before", F.last(score, ignorenulls=True).over(earlier))
    return out.withColumn("delta", F.col(score) - F.col("before")).where(F.abs("delta") >= least)


def late(expected: Column, as_of: Column, what: str) -> Column:
    """A struct of the days that an export is late, its state (ok, warning, alert, missing where none was ever expected), the factor for the
    confidence in what depends on it (the days allowed over the days late), and the warning."""
    days = F.date_diff(as_of, expected)
    state = F.when(days.isNull(), "missing").when(days > ALERT_DAYS, "alert").when(days > WARN_DAYS, "warning").otherwise("ok")
    factor = F.when(days > WARN_DAYS, F.lit(float(WARN_DAYS)) / days).when(days.isNotNull(), 1.0)
    note = F.when(days > WARN_DAYS, F.format_string(f"{what} data is %d days stale", days))
    return F.struct(days.alias("days"), state.alias("state"), factor.alias("factor"), note.alias("note"))


def assemblages(sites: DataFrame, key: str, cell: float) -> DataFrame:
    """Rows (key, parts, acres): undersized boxes of ``sites`` (key, x0, y0, x1, y1, acres, owner) that make a site with their largest
    undersized neighbours of other owners, at most NEIGHBOURS of them; ``parts`` lists those, the largest first. A box whose owner isn't known
    is no part of any."""
    small = sites.where((F.col("acres") < UNDERSIZED) & F.col("owner").isNotNull())
    facts = lambda name, mark: small.select(F.col(key).alias(name), F.col("acres").alias(f"{mark}acres"), F.col("owner").alias(f"{mark}owner"))
    pairs = touching(small, small, key, cell).join(facts(key, "a_"), key).join(facts("other", "b_"), "other").where("a_owner <> b_owner")
    ranked = pairs.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("b_acres"), "other"))).where(F.col("_rn") <= NEIGHBOURS)
    out = ranked.groupBy(key).agg(F.first("a_acres").alias("own"), F.sum("b_acres").alias("more"), F.array_sort(F.collect_list(F.struct("_rn", "other"))).alias("p"))
    parts = F.array_join(F.transform("p", lambda x: x["other"].cast("string")), ",")
    return out.select(key, parts.alias("parts"), (F.col("own") + F.col("more")).alias("acres")).where(F.col("acres") >= SITE_ACRES)


def market_health(markets: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows (market, status) of ``markets`` (market) by ``sources`` (market, health): fail if a source is failing or couldn't be asked (null)
    or the market has none, warning if one is degraded, else ok."""
    rank = F.when(F.col("health").isNull() | (F.col("health") == "failing"), 2).when(F.col("health") == "degraded", 1).otherwise(0)
    worst = markets.join(sources.groupBy("market").agg(F.max(rank).alias("worst")), "market", "left")
    return worst.select("market", F.element_at(F.array(F.lit("ok"), F.lit("warning"), F.lit("fail")), F.coalesce("worst", F.lit(2)) + 1).alias("status"))


def mask_fields(df: DataFrame, private: list[str], texts: list[str]) -> DataFrame:
    """``df`` with its ``private`` columns redacted, null or not; of its ``texts``, those in which a name is left are masked too and their
    columns listed in ``residual``."""
    found = {c: (F.col(c) != REDACTED) & (F.col(c) != FAILSAFE) & F.col(c).rlike(PERSON) for c in texts}
    out = df.withColumn("residual", F.array_join(F.array_compact(F.array(*[F.when(hit, c) for c, hit in found.items()])), ","))
    return out.withColumns({c: F.when(hit, FAILSAFE).otherwise(F.col(c)) for c, hit in found.items()} | {c: F.lit(REDACTED) for c in private})
