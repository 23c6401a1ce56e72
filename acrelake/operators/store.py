"""Tables that change together: data is staged first, and one small manifest, put in place last, makes a cycle visible.

A store is a folder. ``data/`` holds what cycles wrote, each in a folder of its own; ``manifests/`` holds numbered files, each naming the whole
state: for every table its schema and its parts, and the cycles so far. Readers take the newest manifest and the
folders that it names, so they see all of a cycle or nothing of it, whatever is half written beside it. A cycle whose id is known is
a no-op. Two writers that build on the same manifest want the same number: the second one fails and may try anew. Nothing but the manifest passes
through the driver, a line for each part.

A table is a list of parts. Appending adds one, replacing leaves one, and a table with buckets has one for each bucket of its key,
of which an upsert reads and rewrites those alone that its new rows fall into.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from acrelake.operators import history

_BUCKET = "_bucket"


@dataclass
class Manifest:
    number: int = 0
    cycles: list[str] = field(default_factory=list)
    #: Per table its schema, its buckets (None if it has none) and its parts, a relative path by name.
    tables: dict[str, dict] = field(default_factory=dict)


class Conflict(RuntimeError):
    """Another writer's cycle came first."""


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # reading

    def manifest(self, number: int | None = None) -> Manifest:
        """The newest manifest, or that of a number; an empty one where there is none."""
        at = self._path(f"{self.root}/manifests")
        if number is None:
            names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
            number = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != "."), default=0)
        if not number:
            return Manifest()
        stream = self._fs.open(self._path(f"{self.root}/manifests/{number:012d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def read(self, table: str, at: int | None = None) -> DataFrame:
        """A table as of the newest manifest, or of manifest ``at``."""
        return self._parts(self.manifest(at), table)

    def _parts(self, known: Manifest, table: str, names: list[str] | None = None) -> DataFrame:
        entry = known.tables[table]
        schema = StructType.fromJson(entry["schema"])
        paths = [f"{self.root}/{p}" for n, p in entry["parts"].items() if names is None or n in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # writing

    def cycle(self, cycle: str) -> Cycle | None:
        """A cycle to fill and commit; None if it was committed before."""
        known = self.manifest()
        return None if cycle in known.cycles else Cycle(self, cycle, known)

    def _put(self, known: Manifest) -> None:
        """The manifest under its number, by a rename that fails where the number is taken."""
        jvm = self.spark.sparkContext._jvm
        folder = f"{self.root}/manifests"
        self._fs.mkdirs(self._path(folder))
        part = self._fs.makeQualified(self._path(f"{folder}/.{uuid.uuid4().hex}"))
        stream = self._fs.create(part, False)
        try:
            stream.write(bytearray(json.dumps(known.__dict__).encode()))
        finally:
            stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(part, self._fs.makeQualified(self._path(f"{folder}/{known.number:012d}.json")), none)
        except Exception as e:
            self._fs.delete(part, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"manifest {known.number} is another cycle's") from e
            raise

    def sweep(self, keep: int = 1) -> list[str]:
        """Removes the folders of cycles that none of the last ``keep`` manifests names, and older manifests. Only where no cycle is open."""
        last = self.manifest().number
        kept = [self.manifest(n) for n in range(max(1, last - keep + 1), last + 1)]
        named = {p.split("/")[1] for m in kept for entry in m.tables.values() for p in entry["parts"].values()}
        data, gone = self._path(f"{self.root}/data"), []
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if s.getPath().getName() not in named:
                gone.append(s.getPath().getName())
                self._fs.delete(s.getPath(), True)
        for n in range(1, last - keep + 1):
            self._fs.delete(self._path(f"{self.root}/manifests/{n:012d}.json"), False)
        return gone


class Cycle:
    """What one cycle writes. Every write goes to a folder that no manifest names until ``commit``."""

    def __init__(self, store: Store, name: str, known: Manifest) -> None:
        self.store, self.name, self._known = store, name, known
        self.folder = f"data/{known.number + 1:012d}-{uuid.uuid4().hex}"
        self.tables = json.loads(json.dumps(known.tables))

    def _stage(self, table: str, df: DataFrame, by: list[str] = []) -> str:  # noqa: B006
        where = f"{self.folder}/{table}"
        (df.write.partitionBy(*by) if by else df.write).parquet(f"{self.store.root}/{where}")
        return where

    def _plain(self, table: str, df: DataFrame) -> dict:
        entry = self.tables.setdefault(table, {"schema": df.schema.jsonValue(), "buckets": None, "parts": {}})
        if entry["buckets"] is not None:
            raise ValueError(f"{table} has buckets: it takes upserts")
        if [(f.name, f.dataType) for f in StructType.fromJson(entry["schema"])] != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError(f"{table} has other columns")
        return entry

    def append(self, table: str, df: DataFrame) -> None:
        entry = self._plain(table, df)
        entry["parts"][f"{self.name}-{len(entry['parts'])}"] = self._stage(table, df)

    def replace(self, table: str, df: DataFrame) -> None:
        entry = self._plain(table, df)
        entry["parts"] = {self.name: self._stage(table, df)}

    def upsert(self, table: str, df: DataFrame, key: str, newest: list[Column], keep_first: list[str] = [], frozen: list[str] = [], buckets: int = 64, columns: list[str] | None = None) -> list[int]:  # noqa: B006
        """Rows of ``df`` replace those with their key, by :func:`history.upsert`; of several with one key the first by ``newest`` counts,
        rows without a key are left out. ``columns`` are those of the table, all of ``df`` where none are named. Returns the buckets that were rewritten: others keep their files. ``buckets`` holds for a table's first cycle."""
        columns = columns or df.columns
        entry = self.tables.setdefault(table, {"schema": df.select(*columns).schema.jsonValue(), "buckets": buckets, "parts": {}})
        if not entry["buckets"]:
            raise ValueError(f"{table} has no buckets")
        one = history.latest(df.where(F.col(key).isNotNull()), [key], newest).select(*columns)
        bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(entry["buckets"])).cast("int")
        touched = sorted(r[0] for r in one.select(bucket).distinct().collect())  # at most as many numbers as there are buckets
        if not touched:
            return []
        old = self.store._parts(Manifest(tables=self.tables), table, [str(b) for b in touched])
        merged = history.upsert(old, one.select(old.columns), key, keep_first, frozen).withColumn(_BUCKET, bucket)
        where = self._stage(table, merged.hint("rebalance", _BUCKET), [_BUCKET])
        entry["parts"] |= {str(b): f"{where}/{_BUCKET}={b}" for b in touched}
        return touched

    def replace_keyed(self, table: str, df: DataFrame, keys: list[str], buckets: int = 64) -> list[int]:
        """All rows of ``df``, repeated ones too, in place of the table's rows that have their keys; only the buckets that they fall into
        are read and rewritten. Returns those."""
        entry = self.tables.setdefault(table, {"schema": df.schema.jsonValue(), "buckets": buckets, "parts": {}})
        if not entry["buckets"]:
            raise ValueError(f"{table} has no buckets")
        bucket = F.pmod(F.xxhash64(*keys), F.lit(entry["buckets"])).cast("int")
        touched = sorted(r[0] for r in df.select(bucket).distinct().collect())  # at most as many numbers as there are buckets
        if touched:
            old = self.store._parts(Manifest(tables=self.tables), table, [str(b) for b in touched])
            merged = history.keyed_replace(old, df.select(old.columns), keys).withColumn(_BUCKET, bucket)
            where = self._stage(table, merged.hint("rebalance", _BUCKET), [_BUCKET])
            entry["parts"] |= {str(b): f"{where}/{_BUCKET}={b}" for b in touched}
        return touched

    def commit(self) -> int:
        """Makes the cycle visible; the number of its manifest."""
        number = self._known.number + 1
        self.store._put(Manifest(number, [*self._known.cycles, self.name], self.tables))
        return number
