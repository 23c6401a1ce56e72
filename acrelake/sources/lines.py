"""CSV files by splits, with the line that each record begins on.

A quoted field may hold line ends, so whether a line begins a record hangs on all quotes before it in its file. Each split counts its
lines, quotes and beginnings apart, for either state it may begin in; a prefix sum over the splits of a file, a row each, then tells the state,
the number and the record of every line. No file is read in one task. Lines are written once with their counts, as splits planned
twice need not be the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acrelake.sources import scratch

#: Records with these characters take a parser; others are cut at their commas.
_ODD = "[\"\r\n\\x00]"
_SCHEMA = "file string, split long, i long, quotes long, even long, odd long, open boolean, value string"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each line of a split: lines and quotes before it, beginnings up to it where the split begins outside of quotes (even) or
    inside (odd), and whether it has an odd number of quotes. Rows of a split come in order and after one another."""
    key, n, quotes, even, odd = None, 0, 0, 0, 0
    for batch in batches:
        files, starts = batch.column(0), batch.column(1).to_numpy()
        names = files.dictionary_encode()
        codes = names.indices.to_numpy()
        own = pc.count_substring(batch.column(2), '"').to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1
        for lo, hi in zip([0, *cut], [*cut, len(batch)]):
            if lo == hi:
                continue
            here = names.dictionary[int(codes[lo])].as_py(), int(starts[lo])
            if here != key:
                key, n, quotes, even, odd = here, 0, 0, 0, 0
            part = own[lo:hi]
            before = quotes + np.cumsum(part) - part
            first = before % 2 == 0
            evens, odds = even + np.cumsum(first), odd + np.cumsum(~first)
            cols = [files.slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), n + np.arange(hi - lo), before, evens, odds, part % 2 == 1, batch.column(2).slice(lo, hi - lo)]
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], [f.split(" ")[0] for f in _SCHEMA.split(", ")])
            n, quotes, even, odd = n + hi - lo, int(before[-1] + part[-1]), int(evens[-1]), int(odds[-1])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, record, line, value): the records of the files under ``path``, both numbers from 1 within their file. Line ends inside
    of quotes stay; a file that ends inside of quotes has its rest as one record."""
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    rows = scratch.written(raw.mapInArrow(_counted, _SCHEMA), "lines")
    sizes = rows.groupBy("file", "split").agg(F.count("*").alias("n"), F.max_by(F.struct((F.col("quotes") + F.col("open").cast("int")).alias("quotes"), "even", "odd"), "i").alias("last"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    state = sizes.withColumn("inside", F.coalesce(F.sum("last.quotes").over(before), F.lit(0)) % 2 == 1)
    begun = F.when(F.col("inside"), F.col("last.odd")).otherwise(F.col("last.even"))
    bases = state.select("file", "split", "inside", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines"), F.coalesce(F.sum(begun).over(before), F.lit(0)).alias("records"))
    at = rows.join(bases, ["file", "split"])
    within = (F.col("quotes") % 2 == 1) != F.col("inside")
    at = at.select("file", (F.col("records") + F.when(F.col("inside"), F.col("odd")).otherwise(F.col("even"))).alias("record"), (F.col("lines") + F.col("i") + 1).alias("line"), "value", within.alias("within"), "open")
    bare = lambda c: F.regexp_replace(c, "\r$", "")
    single = at.where("NOT within AND NOT open").select("file", "record", "line", bare(F.col("value")).alias("value"))
    parts = at.where("within OR open").groupBy("file", "record").agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("line", "value"))).alias("parts"))
    joined = parts.select("file", "record", "line", bare(F.array_join(F.transform("parts", lambda p: p["value"]), "\n")).alias("value"))
    return single.unionByName(joined)


def read_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows (file, line, cells array<string>) that hold anything, and headers (file, header array<string>), a row for each file. The
    widest header bounds the cells of a row."""
    records = read_records(spark, path)
    heads = scratch.written(records.where("record = 1").select("file", "value"), "heads")  # a row for each file, read again and again
    width = heads.agg(F.max(F.size(F.split("value", ",", -1)))).first()[0] or 1  # one number; commas inside of quotes only make it larger
    names = [f"c{i}" for i in range(width)]

    def cells(value: str):  # noqa: ANN202
        parsed = F.from_csv(value, ", ".join(f"{n} string" for n in names), {"escape": '"', "maxColumns": str(max(20480, width)), "multiLine": "true"})
        # a lambda's argument is parsed once, where fields of a parsed column are parsed each on their own
        quoted = F.transform(F.array(parsed), lambda p: F.array(*[p[n] for n in names]))[0]
        plain = F.transform(F.array(F.split(value, ",", -1)), lambda w: F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.nullif(F.get(w, i), F.lit(""))))[0]
        return F.when(F.col(value).rlike(_ODD), quoted).otherwise(plain)

    # the argument of a generator is computed once, not again in the filter
    body = records.where("record > 1").select("file", "line", F.explode(F.array(cells("value"))).alias("cells"))
    body = body.where(F.exists("cells", lambda c: F.btrim(c) != ""))
    return body, heads.select("file", F.array_compact(cells("value")).alias("header"))
