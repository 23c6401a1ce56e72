"""Latest rows, top rows, and the write semantics of append-only and keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelake.sources import scratch


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Exactly one row per key: the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_with_ties(df: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """All rows of a key that have its greatest non-null stamp."""
    w = Window.partitionBy(*keys).orderBy(F.col(stamp).desc())
    return df.where(F.col(stamp).isNotNull()).withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def needs_rescore(entities: DataFrame, scores: DataFrame, key: str, order: list[Column], pending: Column) -> DataFrame:
    """Entities without a score, or whose latest one is pending; one whose latest score has no status is neither."""
    last = latest(scores, [key], order).select(key, F.coalesce(pending, F.lit(False)).alias("_pending"), F.lit(True).alias("_scored"))
    return entities.join(last, key, "left").where("_scored IS NULL OR _pending").drop("_pending", "_scored")


def upsert(old: DataFrame, new: DataFrame, key: str, keep_first: list[str], frozen: list[str] = []) -> DataFrame:  # noqa: B006
    """``new`` replaces ``old`` by key; ``keep_first`` columns keep a first non-null value, ``frozen`` ones are never updated."""
    a, b = old.alias("a"), new.alias("b")
    cols = []
    for c in old.columns:
        first, last = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c == key or c in keep_first:
            value = F.coalesce(first, last)
        elif c in frozen:
            value = F.when(F.col(f"a.{key}").isNotNull(), first).otherwise(last)
        else:
            value = F.when(F.col(f"b.{key}").isNotNull(), last).otherwise(first)
        cols.append(value.alias(c))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*cols)


def keyed_replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose key occurs in ``new`` go; all rows of ``new`` come, duplicates too."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old, key, "left_anti"))


def purge(df: DataFrame, column: str, value: object) -> DataFrame:
    """All rows but those that equal ``value``; null rows stay."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def bag_difference(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
    """Per distinct row: how often on each side, to insert, present on both, on the right only."""
    n = left.groupBy(*cols).agg(F.count("*").alias("n_left"))
    m = right.groupBy(*cols).agg(F.count("*").alias("n_right"))
    both = n.join(m, cols, "full").fillna(0, ["n_left", "n_right"])
    return both.select(*cols, "n_left", "n_right", F.greatest(F.col("n_left") - F.col("n_right"), F.lit(0)).alias("to_insert"), F.least("n_left", "n_right").alias("present"), F.greatest(F.col("n_right") - F.col("n_left"), F.lit(0)).alias("right_only"))


def decisions(df: DataFrame, run: str, order: str, metric: str, status: str, confidence: str | None = None, state: str | None = None) -> DataFrame:
    """Keep or discard against the best kept so far. A greater metric is kept, an equal one if its confidence is greater by more than
    noise; rows whose ``state`` isn't ok pass their state on and change nothing. Where only the metric decides, the best so far is a running
    maximum; the tie-break needs a fold over the rows of one run, in order, in one task: a run is one ledger of experiments."""
    if confidence is None and state is None:
        best = F.max(metric).over(Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        return df.select(run, order, F.when(best.isNull(), "baseline").when(F.col(metric) > best, "keep").otherwise("discard").alias(status))
    conf = F.col(confidence).cast("double") if confidence else F.lit(0.0)
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(metric).cast("double").alias("m"), conf.alias("c"), (F.col(state) if state else F.lit("ok")).alias("s"))))
    start = F.struct(F.lit(None).cast("double").alias("m"), F.lit(None).cast("double").alias("c"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        near = F.abs(x["c"] - acc["c"]) <= F.greatest(1e-9 * F.greatest(F.abs(x["c"]), F.abs(acc["c"])), F.lit(1e-9))
        better = acc["m"].isNull() | (x["m"] > acc["m"]) | ((x["m"] == acc["m"]) & ~near & (x["c"] > acc["c"]))
        kept = (x["s"] == "ok") & better
        # only improvements enter the list, so it stays short
        return F.when(kept, F.struct(x["m"].alias("m"), x["c"].alias("c"), F.array_append(acc["kept"], x["o"].cast("bigint")).alias("kept"))).otherwise(acc)

    folded = df.groupBy(run).agg(rows.alias("_rows")).select(run, "_rows", F.aggregate("_rows", start, step, lambda a: a["kept"]).alias("_kept"))
    kept = folded.select(run, F.explode("_kept").alias(order)).withColumn("_at", F.min(order).over(Window.partitionBy(run)))
    verdict = F.when(F.col("r.s") != "ok", F.col("r.s")).when(F.col("_at").isNull(), "discard").when(F.col("_at") == F.col(order), "baseline").otherwise("keep")
    every = folded.select(run, F.explode("_rows").alias("r")).withColumn(order, F.col("r.o").cast("bigint"))
    return every.join(kept, [run, order], "left").select(run, order, verdict.alias(status))


def last_anchor(df: DataFrame, run: str, order: str, status: str, value: str) -> DataFrame:
    """Adds ``anchor``, the value of the last baseline or kept row before each row of its run."""
    before = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("anchor", F.last(F.when(F.col(status).isin("baseline", "keep"), F.col(value)), True).over(before))


def created(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` that don't exist yet, one for each key."""
    return new.dropDuplicates([key]).join(old, key, "left_anti")


def name_drift(old: DataFrame, new: DataFrame, key: str, name: str) -> DataFrame:
    """Rows (key, existing, incoming) of known keys that come with another name."""
    known = old.where(F.coalesce(name, F.lit("")) != "").select(key, F.col(name).alias("existing"))
    return new.select(key, F.col(name).alias("incoming")).distinct().join(known, key).where("existing <> incoming").select(key, "existing", "incoming")


def restore(mirror: DataFrame, ledger: DataFrame, order: str) -> DataFrame:
    """The mirror's rows in order, for an empty ledger only."""
    if not ledger.isEmpty():
        raise ValueError("the ledger isn't empty")
    return mirror.orderBy(order).drop(order)


def append_numbered(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``new`` under ``old`` with numbers after its greatest one. Numbers are dense and follow ``order``: ranges are sorted apart, counted,
    and offset by the counts before them.

    A row's range and its place there are written once and read twice: were the ranges planned for the counts and for the rows apart,
    adaptive execution could cut them differently and no partition number would mean the same on both sides."""
    top = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_n", place)
    ranged = scratch.written(ranged, "ranged")
    sizes = ranged.groupBy("_p").agg((F.max("_n") + 1).alias("_c"))
    offset = sizes.withColumn("_o", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).crossJoin(F.broadcast(top))
    numbered = ranged.join(F.broadcast(offset.select("_p", (F.col("_o") + F.col("_top") + 1).alias("_base"))), "_p")  # a row for each partition
    return old.unionByName(numbered.withColumn(key, F.col("_base") + F.col("_n")).drop("_p", "_n", "_base"), allowMissingColumns=True)
