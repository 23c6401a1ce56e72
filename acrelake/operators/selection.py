"""Exact quantiles of groups of any size by distributed selection.

A group's rank is narrowed between two of its values: sketches propose a pair around the rank, exact counts, summed map-side, tell on
which side the rank lies, and only where no proposal helps is the range halved. Once few rows lie between, those alone are fetched. So
no task sees more of a group than ``bin_rows`` values, and a group of all rows costs a few narrow passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrelake.sources import scratch

#: Values of a group that one task may sort.
BIN_ROWS = 50_000
#: Accuracy of the sketches; a proposal is this share of the range's rows, times two, away from the rank.
ACCURACY = 1000
#: Groups whose bounds may be broadcast.
BROADCAST_GROUPS = 100_000


def quantiles(df: DataFrame, keys: list[str], value: str, q: float = 0.5, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Rows (keys, n, value): the count of known values and the interpolated quantile ``q`` of each group that has any. NaN counts as
    greater than all numbers, null keys are a group."""
    rows = scratch.written(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")), "values")
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    ids = [f"_k{i}" for i in range(len(keys))]
    rows = rows.select(*named, "_v")
    state = rows.groupBy(*ids).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    rank = F.col("n").cast("double") - 1
    state = state.select(*ids, "n", "lo", "hi", F.floor(rank * q).alias("k"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    state = scratch.written(state, "ranks")
    while True:
        open_ = (F.col("inside") > bin_rows) & (F.col("lo") < F.col("hi"))
        wide = state.where(open_)
        n_open = wide.count()
        if not n_open:
            break
        state = scratch.written(_narrowed(rows, wide, ids, n_open).unionByName(state.where(~open_)), "ranks")
    least = _at_rank(rows, state, ids)
    last = _next(rows, least, ids)
    part = (F.col("n").cast("double") - 1) * q - F.col("k")
    out = F.when(part > 0, F.col("v") + (F.col("v1") - F.col("v")) * part).otherwise(F.col("v"))
    return last.select(*[F.col(i).alias(k) for i, k in zip(ids, keys)], "n", out.alias(value))


def _with(rows: DataFrame, state: DataFrame, ids: list[str], n: int) -> DataFrame:
    """``rows`` beside the state of their group."""
    s = state.select(*[F.col(i).alias(f"_s{i}") for i in ids], *[c for c in state.columns if c not in ids])
    on = [F.col(i).eqNullSafe(F.col(f"_s{i}")) for i in ids] or [F.lit(True)]
    return rows.join(F.broadcast(s) if n <= BROADCAST_GROUPS else s, on).drop(*[f"_s{i}" for i in ids])


def _narrowed(rows: DataFrame, state: DataFrame, ids: list[str], n: int) -> DataFrame:
    within = F.col("_v").between(F.col("lo"), F.col("hi"))
    at = (F.col("k") - F.col("below") + 0.5) / F.col("inside")
    grid = [i / ACCURACY for i in range(ACCURACY + 1)]
    first = lambda c: F.first(c).alias(c)
    kept = ["n", "lo", "hi", "k", "below", "inside"]
    sketch = _with(rows, state, ids, n).where(within).groupBy(*ids).agg(F.percentile_approx("_v", grid, 10 * ACCURACY).alias("_q"), *[first(c) for c in kept])
    pick = lambda shift: F.get("_q", F.least(F.greatest(F.round(at * ACCURACY + shift), F.lit(0)), F.lit(ACCURACY)).cast("int"))
    middle = F.col("lo") + (F.col("hi") - F.col("lo")) / 2
    proposed = sketch.select(*ids, *kept, pick(-2).alias("c0"), pick(2).alias("c1"))
    stuck = (F.col("c0") <= F.col("lo")) & (F.col("c1") >= F.col("hi"))
    # the middle itself may round to an end; the ends' own ties then decide
    proposed = proposed.withColumn("c0", F.when(stuck, middle).otherwise(F.col("c0"))).withColumn("c1", F.when(stuck, middle).otherwise(F.col("c1")))
    proposed = scratch.written(proposed, "cuts")
    count = lambda c: F.count_if(c)
    v, lo, hi, c0, c1 = (F.col(x) for x in ("_v", "lo", "hi", "c0", "c1"))
    told = _with(rows, proposed, ids, n).where(v.between(lo, hi)).groupBy(*ids).agg(
        *[first(c) for c in (*kept, "c0", "c1")],
        count(v < c0).alias("b0"), count(v <= c0).alias("e0"), count(v < c1).alias("b1"), count(v <= c1).alias("e1"),
        F.max(F.when(v < c0, v)).alias("p0"), F.min(F.when(v > c1, v)).alias("p1"),
    )
    r = F.col("k") - F.col("below")
    side = lambda low, high, before, n: F.struct(low.alias("lo"), high.alias("hi"), (F.col("below") + before).alias("below"), n.alias("inside"))
    zero = F.lit(0)
    to = (
        F.when(r < F.col("b0"), side(lo, F.col("p0"), zero, F.col("b0")))
        .when(r < F.col("e0"), side(c0, c0, F.col("b0"), F.col("e0") - F.col("b0")))
        .when(r >= F.col("e1"), side(F.col("p1"), hi, F.col("e1"), F.col("inside") - F.col("e1")))
        .when(r >= F.col("b1"), side(c1, c1, F.col("b1"), F.col("e1") - F.col("b1")))
        .otherwise(side(c0, c1, F.col("b0"), F.col("e1") - F.col("b0")))
    )
    return told.select(*ids, "n", "k", to.alias("to")).select(*ids, "n", "to.lo", "to.hi", "k", "to.below", "to.inside")


def _at_rank(rows: DataFrame, state: DataFrame, ids: list[str]) -> DataFrame:
    """``state`` with ``v``, the value of rank k: the one value between the bounds, or that of the few rows there."""
    few = state.where("lo < hi")
    n = few.count()
    own = _with(rows, few, ids, n).where(F.col("_v").between(F.col("lo"), F.col("hi")))
    sorted_ = own.groupBy(*ids).agg(F.first("n").alias("n"), F.first("k").alias("k"), F.first("below").alias("below"), F.sort_array(F.collect_list("_v")).alias("_all"))
    fetched = sorted_.select(*ids, "n", "k", F.get("_all", (F.col("k") - F.col("below")).cast("int")).alias("v"))
    return scratch.written(state.where("NOT (lo < hi)").select(*ids, "n", "k", F.col("lo").alias("v")).unionByName(fetched), "found")


def _next(rows: DataFrame, found: DataFrame, ids: list[str]) -> DataFrame:
    """``found`` with ``v1``, the value of rank k + 1: the same one where it has more rows, else the next greater one."""
    n = found.count()
    v = F.col("_v")
    told = _with(rows, found, ids, n).groupBy(*ids).agg(F.first("n").alias("n"), F.first("k").alias("k"), F.first("v").alias("v"), F.count_if(v <= F.col("v")).alias("upto"), F.min(F.when(v > F.col("v"), v)).alias("more"))
    return told.withColumn("v1", F.when(F.col("upto") > F.col("k") + 1, F.col("v")).otherwise(F.coalesce("more", "v")))


def medians(df: DataFrame, keys: list[str], value: str, n: str = "n", bin_rows: int = BIN_ROWS) -> DataFrame:
    return quantiles(df, keys, value, 0.5, bin_rows).withColumnRenamed("n", n)


