"""Tab-separated experiment ledgers: tolerant reads and validated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelake.functions import text

#: Columns, states and the form of a commit.
COLUMNS = ["commit", "metric", "confidence", "api_calls", "wall_clock_min", "status", "description"]
STATUSES = ["baseline", "keep", "discard", "crash", "timeout", "halt"]
COMMIT = r"^([0-9a-f]{7,40}|pending)$"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all-string COLUMNS; a header line and lines of another width are left out."""
    schema = ", ".join(f"`{c}` string" for c in [*COLUMNS, "_bad"])
    rows = spark.read.schema(schema).option("sep", "\t").option("columnNameOfCorruptRecord", "_bad").csv(path)
    header = F.lit(True)
    for c in COLUMNS:
        header = header & F.col(c).eqNullSafe(F.lit(c))
    return rows.where(F.col("_bad").isNull() & ~header).select(*[F.coalesce(c, F.lit("")).alias(c) for c in COLUMNS])


def validated(rows: DataFrame) -> DataFrame:
    """Rows (metric and api_calls long, confidence and wall_clock_min double, the others string) as ledger strings, with
    ``error``, the first failure in the order of the columns (null if none)."""
    commit, status = text.strip(F.coalesce("commit", F.lit(""))), text.strip(F.coalesce("status", F.lit("")))
    finite = lambda c: F.coalesce((F.col(c) >= 0) & (F.col(c) < float("inf")), F.lit(False))
    checks = [
        (commit.rlike(COMMIT), "commit: wrong form"),
        (F.coalesce(F.col("metric") >= 0, F.lit(False)), "metric: not a count"),
        (finite("confidence"), "confidence: not finite and at least 0"),
        (F.coalesce("api_calls", F.lit(0)) >= 0, "api_calls: not a count"),
        (finite("wall_clock_min") | F.col("wall_clock_min").isNull(), "wall_clock_min: not finite and at least 0"),
        (status.isin(STATUSES), "status: unknown"),
    ]
    error = F.coalesce(*[F.when(~ok, why) for ok, why in checks])
    return rows.select(
        commit.alias("commit"),
        F.col("metric").cast("string").alias("metric"),
        F.format_string("%.2f", "confidence").alias("confidence"),
        F.coalesce("api_calls", F.lit(0)).cast("string").alias("api_calls"),
        F.format_string("%.1f", F.coalesce("wall_clock_min", F.lit(0.0))).alias("wall_clock_min"),
        status.alias("status"),
        description(F.col("description")).alias("description"),
        error.alias("error"),
    )


def description(c: Column, size: int = 200) -> Column:
    """White space collapsed, and cut to ``size`` characters with an ellipsis."""
    flat = text.strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\x00]+", " "))
    return F.when(F.char_length(flat) > size, F.concat(F.rtrim(F.substring(flat, 1, size - 1)), F.lit("…"))).otherwise(flat)


def append(rows: DataFrame, path: str) -> None:
    """Add the valid rows; all or none: one failing row raises ValueError."""
    checked = validated(rows)
    if bad := checked.where("error IS NOT NULL").select("error").limit(1).collect():
        raise ValueError(bad[0].error)
    checked.drop("error").write.mode("append").option("sep", "\t").option("header", True).csv(path)
