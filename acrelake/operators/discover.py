"""One discovery cycle: mapped features are judged by the filters, accepted ones go into the table of parcels, and the table, its log and
its flags change in one commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelake.operators import discovery, filters
from acrelake.operators.store import Store
from acrelake.sources import scratch

#: What became of a feature, filters' own outcomes beside them, and the note on parcels of several polygons.
FOUND, UNMAPPABLE = "discovery", "skip_unmappable"
REDUCED = "multi-polygon parcel reduced to largest outer ring"


def outcomes(rows: DataFrame, rejects: list[tuple[str, Column]], flags: list[tuple[str, Column]]) -> DataFrame:
    """``rows`` with reject_reason, flags and ``status``: unmappable where ``skip_reason`` is given or the key is null, the name of the
    first filter that rejects, else a discovery. Filters are named ``id: reason``; a null condition of a reject rejects."""
    judged = filters.judged(rows.withColumn("skip_reason", F.when(F.col("parcel_id").isNull(), F.coalesce("skip_reason", F.lit("no key"))).otherwise(F.col("skip_reason"))), rejects, flags)
    by = F.concat(F.lit("rejection_"), F.lower(F.split_part("reject_reason", F.lit(":"), F.lit(1))))
    return judged.withColumn("status", F.when(F.col("skip_reason").isNotNull(), UNMAPPABLE).when(F.col("reject_reason").isNotNull(), by).otherwise(FOUND))


def discover(
    store: Store, name: str, rows: DataFrame, market: str, rejects: list[tuple[str, Column]], flags: list[tuple[str, Column]],
    columns: list[str], newest: list[Column], keep_first: list[str] = [], frozen: list[str] = [], buckets: int = 64,
) -> DataFrame | None:  # fmt: skip  # noqa: B006
    """Cycle ``name`` over ``rows``, the ``columns`` of the table ``parcels`` beside skip_reason, multipolygon, corridor, acreage and
    owner_type_inferred: one per feature. Each feature has one row in ``log``; each flag of an accepted one, a row in ``flags``. Of several accepted
    features with one parcel_id the first by ``newest`` is stored, all are logged. Returns rows (corridor, a count of each status) and their
    total; None if the cycle was committed before, and then nothing is written."""
    one = store.cycle(name)
    if one is None:
        return None
    seen = scratch.written(outcomes(rows, rejects, flags), "outcomes")  # the table, its log and its flags come from the same rows
    found = seen.where(F.col("status") == FOUND)
    one.upsert("parcels", found, "parcel_id", newest, keep_first, frozen, buckets, columns)
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    lost = F.col("status") == UNMAPPABLE
    notes = F.when(lost, F.concat(F.lit("unmappable feature: "), "skip_reason")).when(F.col("status") != FOUND, F.col("reject_reason"))
    notes = F.coalesce(notes, F.concat(F.lit("corridor="), said("corridor"), F.lit("; acreage="), said("acreage"), F.lit("; owner_type="), said("owner_type_inferred")))
    kind = F.when(F.col("status") == FOUND, FOUND).otherwise("rejection")
    one.append("log", seen.select(F.lit(name).alias("cycle_id"), kind.alias("action_type"), F.lit(market).alias("market"), F.when(~lost, F.col("parcel_id")).alias("parcel_id"), notes.alias("notes")))
    raised = F.concat("flags", F.when(F.coalesce("multipolygon", F.lit(False)), F.array(F.lit(REDUCED))).otherwise(F.array().cast("array<string>")))
    one.append("flags", found.select(F.lit(name).alias("cycle_id"), "parcel_id", F.lit("data_gap").alias("flag_type"), F.explode(raised).alias("description")))
    one.commit()
    states = [FOUND, UNMAPPABLE, *dict.fromkeys(f"rejection_{n.split(':')[0].lower()}" for n, _ in rejects)]
    return discovery.totals(seen, "corridor", "status", states)
