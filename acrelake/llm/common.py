"""Shared plumbing: table access, written intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows, and of bytes of their files, that may be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20
#: While it is true, Spark removes a query's shuffle files as soon as the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset and all runs on this machine (tests), one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="acrelake-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the default file system where it has none, so that workers mean the store that Spark means."""
    target, store = _hadoop(spark, path)
    return store.makeQualified(target).toString()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's file system closes."""
    path = f"{shared_dir(spark)}/acrelake/{name}-{uuid.uuid4().hex}"
    target, store = _hadoop(spark, path)
    store.deleteOnExit(target)
    return path


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here and lost executors cost nothing, and the shuffle files of the write go
    with its end. Tables of text take zstd as ``codec``, a third of the room that they have otherwise."""
    return written_in_turns([df], name, codec)


def written_in_turns(parts: list[DataFrame], name: str, codec: str | None = None) -> DataFrame:
    """The union of ``parts``, of one schema, as such a table. Each part has a write of its own, so that the shuffle files of one part alone
    are on disk."""
    spark = parts[0].sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        for df in parts:
            df.write.mode("append").parquet(path, compression=codec)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(parts[0].schema).parquet(path)
    out._scratch = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Remove the files of tables made by :func:`written` that nothing needs any more."""
    for df in tables:
        target, store = _hadoop(df.sparkSession, df._scratch)
        store.delete(target, True)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more. It does so when the driver collects garbage, which a
    driver with room to spare may put off over many stages while the executors' disks fill."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def is_small(keys: DataFrame, rows: int | None = None) -> bool:
    """Whether the rows of ``keys``, a table made by :func:`written`, and the bytes of its files are few. Rows are counted from file
    footers unless their number is known."""
    target, store = _hadoop(keys.sparkSession, keys._scratch)
    return store.getContentSummary(target).getLength() <= BROADCAST_BYTES and (keys.count() if rows is None else rows) <= BROADCAST_ROWS


def maybe_broadcast(keys: DataFrame) -> DataFrame:
    """Broadcast ``keys`` only if it is small; beyond that a shuffle join is planned."""
    return F.broadcast(keys) if is_small(keys) else keys


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone; the cheap function serves wherever all characters are ASCII."""
    spelled = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(spelled)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value`` computed once. A plain column that a lambda uses is put in its place by the optimizer
    when projections collapse, and then computed anew for each element."""
    return F.transform(F.array(value), body)[0]


def prefix_sums(values: Column) -> Column:
    """Sums of all values before each place. By blocks of about the root of the length: a fold that appends copies its array each time."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x)

    def by_blocks(blocks: Column, sums: Column) -> Column:
        base = F.transform(sums, lambda _, j: total(F.slice(sums, F.lit(1), j)))
        return let(base, lambda at: F.flatten(F.transform(blocks, lambda part, j: F.transform(part, lambda _, i: F.get(at, j) + total(F.slice(part, F.lit(1), i))))))

    def cut(a: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(a))), F.lit(1)).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), width), lambda j: F.slice(a, j, width))
        return let(blocks, lambda b: let(F.transform(b, total), lambda sums: by_blocks(b, sums)))

    return let(values, cut)


def count_below(ordered: Column, bound: Column) -> Column:
    """How many values of an ascending array are below ``bound``, by bisection."""
    start = F.struct(F.lit(0).alias("lo"), F.size(ordered).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = F.get(ordered, middle) < bound
        step = F.when(right, F.struct((middle + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), middle.alias("hi")))
        return F.when(acc["lo"] < acc["hi"], step).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, halve, lambda acc: acc["lo"])


def sha256_joined(items: Column, sep: str = ",") -> Column:
    return F.sha2(F.array_join(items, sep), 256)
