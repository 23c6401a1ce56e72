"""Verdicts on sources with a lifetime: a good verdict is served for a while, a failing one never is, so recovery shows at once.

Rows (source, at, health) ask for a verdict; ``health`` is what a probe gives at that time. If the last probe of the source that was good is less
than ``lifetime`` seconds old, its verdict is served and the probe isn't needed; else the probe's own verdict is. Anything but healthy or
degraded, null too, counts as failing. Rows without a source or a time are left out; rows of one time are taken in order of their verdict's
name, null last. Extra columns are left out; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Verdicts that may be served again, and the one that all others count as.
GOOD = ("healthy", "degraded")
FAILING = "failing"
#: Times go through Python as microseconds, which no time zone of a session moves.
_OUT = "source string, us long, status string, served boolean"


def _asked(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("source").isNotNull() & F.col("at").isNotNull()).select(F.col("source").cast("string").alias("source"), F.unix_micros(F.col("at").cast("timestamp")).alias("us"), "health")


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("source", F.timestamp_micros("us").alias("at"), "status", "served")


def verdict_at(kept: tuple | None, us: int, health: str | None, lifetime: float) -> tuple[str, bool, tuple | None]:
    """The verdict at a time, whether it is a served one, and the (time, verdict) kept from now on. A clock that goes back serves what is kept."""
    if kept is not None and us - kept[0] < lifetime * 1_000_000:
        return kept[1], True, kept
    if health in GOOD:
        return health, False, (us, health)
    return FAILING, False, kept


def served_rows(rows: DataFrame, lifetime: float) -> DataFrame:
    """Rows (source, at, status, served) of a batch table. Which probe is kept depends on the one before it, so the rows of a source pass in
    order through one task, one kept verdict at a time in memory; tasks hold many sources."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, kept = None, None
        for frame in frames:
            status, served = [], []
            for name, us, health in zip(frame["source"], frame["us"], frame["health"]):
                if name != source:
                    source, kept = name, None
                given, again, kept = verdict_at(kept, us, health, lifetime)
                status.append(given)
                served.append(again)
            yield pd.DataFrame({"source": frame["source"], "us": frame["us"], "status": status, "served": served})

    return _shown(_asked(rows).repartition("source").sortWithinPartitions("source", "us", F.col("health").asc_nulls_last()).mapInPandas(scan, _OUT))


class Served(StatefulProcessor):
    """The same over a stream: one kept verdict per source, which the state store itself forgets after its lifetime. A row that comes before
    those of an earlier batch in time is served what is kept."""

    def __init__(self, lifetime: float) -> None:
        self.lifetime = lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", "us long, status string", ttlDurationMs=max(int(self.lifetime * 1000), 1))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        before = tuple(self.kept.get()) if self.kept.exists() else None
        kept = before
        for row in sorted(rows, key=lambda r: (r["us"], r["health"] is None, r["health"] or "")):
            status, again, kept = verdict_at(kept, row["us"], row["health"], self.lifetime)
            yield Row(source=key[0], us=row["us"], status=status, served=again)
        if kept != before:
            self.kept.update(kept)

    def close(self) -> None:
        pass


def served(stream: DataFrame, lifetime: float) -> DataFrame:
    """Rows (source, at, status, served) of a stream of requests; a batch's rows of one source are sorted in memory. Needs the state store
    provider with column families (RocksDB). Spark goes on looking for expired state, so a query with the trigger ``availableNow`` doesn't end."""
    return _shown(_asked(stream).groupBy("source").transformWithState(Served(lifetime), _OUT, "append", "processingTime"))
