"""Roll-up of check results per source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def roll_up(checks: DataFrame, critical: list[str]) -> DataFrame:
    """Rows (source, health, failed) of ``checks`` (source, check, status): failing if a critical check fails, degraded if
    another does, else healthy; ``failed`` lists the failed checks in order."""
    bad = F.col("status") == "fail"
    worst = F.coalesce(F.bool_or(bad & F.col("check").isin(critical)), F.lit(False))
    some = F.coalesce(F.bool_or(bad), F.lit(False))
    health = F.when(worst, "failing").when(some, "degraded").otherwise("healthy")
    return checks.groupBy("source").agg(health.alias("health"), F.array_join(F.array_sort(F.collect_set(F.when(bad, F.col("check")))), ",").alias("failed"))


def dashboard(rows: DataFrame) -> DataFrame:
    """Rows (source, mean_rate, response_ms, notes) of ``rows`` (source, place, rate, response_ms, warning, error): the mean rate of filled
    fields to two places, null where none was measured; the slowest response; warnings in order of place, or errors where there are none."""
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("place", c)))), lambda x: x[c]), "; ")
    out = rows.groupBy("source").agg(F.round(F.avg("rate"), 2).alias("mean_rate"), F.max("response_ms").alias("response_ms"), listed("warning").alias("w"), listed("error").alias("e"))
    return out.select("source", "mean_rate", "response_ms", F.when(F.col("w") != "", F.col("w")).otherwise(F.col("e")).alias("notes"))
