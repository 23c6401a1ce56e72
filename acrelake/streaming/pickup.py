"""Periodic folder pickup of exports as a file stream, validated row by row and written by micro-batch."""

from __future__ import annotations

import csv
import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from acrelake.sources.exports import ExportSpec, file_day, header_errors, validated


def exports(spark: SparkSession, folder: str, spec: ExportSpec) -> DataFrame:
    """Whole files (path, content) as they come: a header counts for its own file, so columns are taken by name and not by place."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", f"{spec.name}_*.csv").load(folder).select("path", F.decode("content", "UTF-8").alias("content"))


def rows_of(files: DataFrame, spec: ExportSpec, as_of: datetime.date | None = None) -> tuple[DataFrame, DataFrame]:
    """Checked rows of all files, and files whose header doesn't fit, rows (path, error). A file is one row here, so this is for the
    exports of a week, of some megabytes each; ``exports.read_export`` splits larger ones."""
    schema = "path string, error string, cells map<string,string>"

    def parse(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                lines = csv.reader(content.splitlines(keepends=True))
                header = [h.removeprefix("\ufeff").strip().lower() for h in next(lines, [])]
                if errors := header_errors(header, spec):
                    out.append((path, "; ".join(errors), None))
                    continue
                out += [(path, None, dict(zip(header, row))) for row in lines if any(c.strip() for c in row)]
            yield pd.DataFrame(out, columns=["path", "error", "cells"])

    parsed = files.mapInPandas(parse, schema)
    good = parsed.where("error IS NULL").select("path", *[F.col("cells")[c].alias(c) for c in spec.columns])
    if spec.dated:
        good = good.withColumn(spec.dated, file_day(F.col("path"), spec))
    return validated(good, spec, as_of), parsed.where("error IS NOT NULL").select("path", "error")


def land(stream: DataFrame, spec: ExportSpec, good: str, bad: str, quarantine: str, checkpoint: str, as_of: datetime.date | None = None) -> StreamingQuery:
    """Valid rows, failed rows and failed files to a folder each, once for all files that are there. Each batch writes its own
    sub-folder anew, so that a batch that is run again replaces what it wrote before."""

    def publish(batch: DataFrame, number: int) -> None:
        rows, failed = rows_of(batch, spec, as_of)
        for df, where in ((rows.where("error IS NULL").drop("error"), good), (rows.where("error IS NOT NULL"), bad), (failed, quarantine)):
            df.write.mode("overwrite").parquet(f"{where}/batch={number}")

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
