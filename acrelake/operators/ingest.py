"""One ingestion cycle: checked rows of a delivery into their table, with a log row for each file and a flag for each bad row, all in one
commit; then files go to the archive, those that can't be read to quarantine."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelake.operators.store import Store
from acrelake.sources import exports, scratch


def ingest(store: Store, name: str, spec: exports.ExportSpec, path: str, as_of: datetime.date | None = None, buckets: int = 64) -> DataFrame | None:
    """Loads the files under ``path`` as cycle ``name``: tables ``spec.name``, ``log`` and ``flags`` of the store change together. Returns
    the files, rows (file, rows_loaded, rows_failed, error); None if the cycle was committed before, and then nothing is read."""
    one = store.cycle(name)
    if one is None:
        return None
    checked, failed = exports.read_export(store.spark, path, spec, as_of)
    checked = scratch.written(checked, "checked")  # rows are loaded, counted and flagged from it
    good, bad = exports.split(checked)
    one.replace_keyed(spec.name, good.drop("file", "line"), list(spec.keys), buckets)
    counts = checked.groupBy("file").agg(F.count_if(F.col("error").isNull()).alias("rows_loaded"), F.count_if(F.col("error").isNotNull()).alias("rows_failed"))
    none = [F.lit(0).cast("long").alias(c) for c in ("rows_loaded", "rows_failed")]
    files = scratch.written(counts.withColumn("error", F.lit(None).cast("string")).unionByName(failed.select("file", *none, "error")), "files")
    base = F.element_at(F.split("file", "/"), -1)
    notes = F.format_string(f"{spec.name}: file=%s rows_loaded=%d rows_failed=%d", base, "rows_loaded", "rows_failed")
    one.append("log", files.select(F.lit(name).alias("cycle_id"), F.lit("ingestion").alias("action_type"), F.coalesce("error", notes).alias("notes")))
    said = F.format_string(f"ingestion ({spec.name}): row-level validation failure in %s line %d: %s", base, "line", "error")
    one.append("flags", bad.select(F.lit(name).alias("cycle_id"), F.lit("data_gap").alias("flag_type"), said.alias("description")))
    one.commit()
    return files


def settle(spark: SparkSession, files: DataFrame, archive: str, quarantine: str) -> dict[str, str]:
    """Moves each file of a cycle where it belongs; the new places by file. A name that is taken gets a number, so no file is lost. A
    file that went there in an attempt before is left."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    out = {}
    for r in files.select("file", "error").collect():  # a row for each file of one delivery
        source = path(r.file)
        store = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        folder = (quarantine if r.error else archive).rstrip("/")
        if not store.exists(source):
            continue
        store.mkdirs(path(folder))
        to, n = f"{folder}/{source.getName()}", 0
        while store.exists(path(to)):
            n += 1
            to = f"{folder}/{source.getName()}.{n}"
        if not store.rename(source, path(to)):
            raise OSError(f"{r.file} can't be moved to {to}")
        out[r.file] = to
    return out
