"""Token counts of documents in flat, unindexed token files, by a scan for the end-of-document identifier.

Files hold little-endian uint16 or uint32 ids and nothing else. They are cut into blocks of fixed size; each block is read on
its own and searched at once for the separator, giving its separators' places. A document may begin many blocks before its end:
a prefix scan over the blocks' summaries (separators before, place of the last one; a few numbers each) stitches the boundaries, so no task ever
needs more than a block's places or a group's summaries.

``write_tokens`` makes such files from id arrays: one file per task attempt under a temporary name, renamed when complete, so a
task that is run again replaces nothing half done; a manifest says which document is where.

Defined results: a document without ids counts 0; ids after a file's last separator are a document of their own if there are
any (``ended`` is false); an empty file has no documents; a file's trailing bytes that make no whole id are an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acrelake.llm.common import qualified, written

#: Ids in a block, and blocks in a group of the prefix scan.
BLOCK = 1 << 20
GROUP = 1 << 10


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path that the driver qualified; Hadoop spells local ones with one slash."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def write_tokens(tokens: DataFrame, folder: str, separator: int, id_col: str = "doc_id", ids_col: str = "ids", dtype: str = "uint16") -> DataFrame:
    """Writes the files when the result is computed; rows (id, file, place): the document's file and number in it.

    Keep the result as a table: only files that it names count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        name, place, out = f"{uuid.uuid4().hex}.bin", 0, None
        keys = []
        for batch in batches:
            if out is None:
                out = store.open_output_stream(f"{root}/_{name}")
            ids = batch.column(1)
            for row in range(len(ids)):
                values = ids[row].values
                if values is not None and len(values):
                    flat = values.to_numpy(zero_copy_only=False)
                    if flat.min() < 0 or flat.max() > np.iinfo(dtype).max or (flat == separator).any():
                        raise ValueError("an id doesn't fit the file or is the separator")
                    out.write(flat.astype(f"<{np.dtype(dtype).str[1:]}").tobytes())
                out.write(np.array([separator], f"<{np.dtype(dtype).str[1:]}").tobytes())
            n = len(ids)
            keys.append(pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * n, pa.string()), pa.array(np.arange(place, place + n), pa.int64())], [id_col, "file", "place"]))
            place += n
        if out is not None:
            out.close()
            store.move(f"{root}/_{name}", f"{root}/{name}")
        yield from keys

    folder = qualified(tokens.sparkSession, folder)
    rows = tokens.select(id_col, ids_col)
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, file string, place long")


def scan_tokens(spark: SparkSession, folder: str, separator: int, dtype: str = "uint16", block: int = BLOCK) -> DataFrame:
    """Rows (file, place, start, n_tokens, ended) for every document of every ``*.bin`` file in ``folder``."""
    width = np.dtype(dtype).itemsize
    # column pruning: the listing doesn't read the files
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_]*.bin").load(folder).select("path", "length")
    blocks = files.select("path", "length", F.explode(F.expr(f"sequence(0L, greatest(length - 1, 0L) div {block * width}L)")).alias("block")).where("length > 0")
    blocks = blocks.repartition(F.col("path"), F.col("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, object] = ("", None)
        for batch in batches:
            rows: dict[str, list] = {"path": [], "block": [], "size": [], "ends": []}
            for path, length, number in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if length % width:
                    raise ValueError(f"{path}: {length} bytes are no whole number of ids")
                if opened[0] != path:
                    store, name = _store(path)
                    opened = (path, store.open_input_file(name))
                raw = opened[1].read_at(min(block * width, length - number * block * width), number * block * width)
                ids = np.frombuffer(raw, f"<{np.dtype(dtype).str[1:]}")
                rows["path"].append(path)
                rows["block"].append(number)
                rows["size"].append(len(ids))
                rows["ends"].append(np.flatnonzero(ids == separator) + number * block)
            yield pa.RecordBatch.from_arrays([pa.array(rows["path"], pa.string()), pa.array(rows["block"], pa.int64()), pa.array(rows["size"], pa.int64()), pa.array(rows["ends"], pa.list_(pa.int64()))], list(rows))

    found = written(blocks.mapInArrow(run, "path string, block long, size long, ends array<long>"), "ends")
    # the prefix scan moves a few numbers for each block, in two levels: over the groups of a file, and inside each group
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    short = found.select("path", "block", F.expr(f"block div {GROUP}").alias("group"), F.size("ends").alias("n"), "size", last.alias("last"))
    upper = short.groupBy("path", "group").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max("last").alias("last"))
    files_in_order = Window.partitionBy("path").orderBy("group")
    before = files_in_order.rowsBetween(Window.unboundedPreceding, -1)
    upper = upper.select("path", "group", F.sum("n").over(before).alias("n0"), F.sum("size").over(before).alias("size0"), F.max("last").over(before).alias("last0"), F.lead("group").over(files_in_order).isNull().alias("final0"))
    in_order = Window.partitionBy("path", "group").orderBy("block")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    plus = lambda c: F.coalesce(F.col(f"{c}0"), F.lit(0)) + F.coalesce(F.sum(c).over(before), F.lit(0))
    scan = short.join(upper, ["path", "group"]).select("path", "block", plus("n").alias("count"), (plus("size") + F.col("size")).alias("upto"), F.coalesce(F.max("last").over(before), "last0", F.lit(-1)).alias("open"), (F.col("final0") & F.lead("block").over(in_order).isNull()).alias("final"))
    stitched = found.join(scan, ["path", "block"])
    tail = F.col("final") & (F.col("upto") - 1 > F.coalesce(last, F.col("open")))
    ends = F.concat(F.transform("ends", lambda e: F.struct(e.alias("at"), F.lit(True).alias("ended"))), F.when(tail, F.array(F.struct(F.col("upto").alias("at"), F.lit(False).alias("ended")))).otherwise(F.array().cast("array<struct<at:bigint,ended:boolean>>")))
    flat = stitched.select("path", "count", "open", "ends", F.posexplode(ends).alias("i", "e"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.get("ends", F.col("i") - 1)) + 1
    return flat.select(F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("count") + F.col("i")).alias("place"), start.alias("start"), (F.col("e.at") - start).alias("n_tokens"), F.col("e.ended").alias("ended"))


def count_tokens(tokens: DataFrame, folder: str, separator: int, id_col: str = "doc_id", ids_col: str = "ids", dtype: str = "uint16", block: int = BLOCK) -> DataFrame:
    """Rows (id, file, place, start, n_tokens): token counts by writing the files and scanning them."""
    manifest = written(write_tokens(tokens, f"{folder}/tokens", separator, id_col, ids_col, dtype), "manifest")
    if manifest.isEmpty():
        return manifest.selectExpr("*", "0L AS start", "0L AS n_tokens")
    found = scan_tokens(manifest.sparkSession, f"{folder}/tokens", separator, dtype, block)
    # the manifest packs into small files, from which its rows would be taken for few and broadcast
    return manifest.hint("merge").join(found, ["file", "place"]).select(id_col, "file", "place", "start", "n_tokens")
