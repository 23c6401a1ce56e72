"""Ordered reject-or-flag filters: all are evaluated, the first reject wins, flags count only for accepted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judged(df: DataFrame, rejects: list[tuple[str, Column]], flags: list[tuple[str, Column]]) -> DataFrame:
    """Adds reject_reason (null if accepted) and flags (array<string>). A null condition of a reject rejects."""
    reason = F.coalesce(*[F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in rejects])
    raised = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in flags]))
    return df.withColumn("reject_reason", reason).withColumn("flags", F.when(F.col("reject_reason").isNull(), raised).otherwise(F.array().cast("array<string>")))
