"""Divergence of sources within a language by two-dimensional tiling of groups.

``tally`` counts terms per group (language and source) with partial counts in each task. A language keeps the terms that enough
of its documents have; kept terms are dealt by hash into chunks of about CHUNK places, so no numbering passes through one task. A group's counts in
a chunk are packed into one row. Groups of a language are dealt into blocks, and each pair of blocks and slab of chunks
is a tile: its rows are sent there, sorted by chunk, and the task holds two dense blocks of one chunk and the submatrix of sums, whatever the
vocabulary's size. Terms of chunks that neither block has are alike for all and enter by their number.

All arithmetic is on whole numbers: shares are scaled by 10**9 and found by long division in base 1000, exact for sums below 9 * 10**15.

Defined results: null text, language and source read as ''; a group whose documents have no terms takes part with zero counts; a language
without kept terms has pairs of value 0 and no terms; a language of one source has no pairs; repeated rows count as often as they
come; extra columns are dropped; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelake.llm.common import drop_written, maybe_broadcast, written

#: Documents of a language that a kept term has at least.
LEAST_DOCS = 10
#: Scale of shares.
SCALE = 1_000_000_000
#: Terms of a chunk, groups of a block and chunks of a slab, on average.
CHUNK = 4096
BLOCK = 32
SLAB = 64
#: Ranks reported of a group's terms.
TOP_TERMS = 10
#: Terms and documents that a task counts before it hands its counts on.
HELD_TERMS = 1_500_000
HELD_DOCS = 1 << 20
#: Bytes that are part of no term become blanks.
_BLANK = bytes(c if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_BLANK).split()


def tally(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """Rows (lang, source, term, c, df): occurrences and documents per group, summed within tasks and then over all."""
    none = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(none(lang).alias("lang"), none(source).alias("source"), none(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = {}, 0, 0  # a count holds the documents above its lowest 40 bits
        for batch in batches:
            for lang, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                counts = held.setdefault((lang, source), {})
                before, seen = len(counts), seen + 1
                get = counts.get
                for term, c in Counter(terms_of(raw.as_py())).items():
                    counts[term] = get(term, 0) + c + (1 << 40)
                size += len(counts) - before
                if size > HELD_TERMS or seen > HELD_DOCS:
                    yield from handed(held)
                    held, size, seen = {}, 0, 0
        yield from handed(held)

    def handed(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in held.items():
            both = np.fromiter(counts.values(), np.int64, len(counts))
            terms = pa.array(list(counts), pa.binary()).view(pa.string())
            for at in range(0, len(counts), 50_000):
                part = both[at : at + 50_000]
                names = [pa.array([x] * len(part), pa.string()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*names, terms.slice(at, len(part)), pa.array(part & ((1 << 40) - 1)), pa.array(part >> 40)], ["lang", "source", "term", "c", "df"])

    parts = rows.mapInArrow(run, "lang string, source string, term string, c long, df long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("df").alias("df"))


def share(c: Column, total: Column) -> Column:
    """1 + floor(SCALE * c / total), digit by digit in base 1000, so that no product leaves a long."""
    whole, rest = F.lit(0).cast("long"), c
    for turn in range(4):
        digit = F.call_function("div", rest, total)
        whole, rest = whole * 1000 + digit, (rest % total) * (1000 if turn < 3 else 1)
    return whole + 1


def _shares(c: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``share`` for an array of counts (groups, terms) and the totals of the groups."""
    total = total[:, None]
    whole, rest = np.zeros_like(c), c
    for _ in range(4):
        digit, left = np.divmod(rest, total)
        whole, rest = whole * 1000 + digit, left * 1000
    return whole + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums over terms of floor((p - q)^2 / (p + q)) for each row of ``p`` with each of ``q``."""
    out = np.zeros((len(p), len(q)), np.int64)
    for i, row in enumerate(p):
        out[i] = ((row - q) ** 2 // (row + q)).sum(axis=1)
    return out


class _Tile:
    """The submatrix of one tile: the groups of its blocks, then chunk after chunk."""

    def __init__(self, key: tuple) -> None:
        self.key, self.names, self.totals, self.terms = key, ([], []), ([], []), 0
        self.chunk, self.width, self.cells, self.covered = None, 0, ([], []), 0
        self.sums = None

    def group(self, side: int, name: str, total: int, terms: int) -> None:
        self.names[side].append(name)
        self.totals[side].append(total)
        self.terms = terms

    def ready(self) -> None:
        if self.sums is None:
            self.place = tuple({n: i for i, n in enumerate(names)} for names in self.names)
            self.total = tuple(np.array(t, np.int64) for t in self.totals)
            self.sums = np.zeros((len(self.names[0]), len(self.names[1])), np.int64)

    def close_chunk(self) -> None:
        self.ready()
        if self.chunk is None:
            return
        p = []
        for side in (0, 1):
            c = np.full((len(self.names[side]), self.width), 2, np.int64)
            for name, at, n in self.cells[side]:
                c[self.place[side][name], at] += n
            p.append(_shares(c, self.total[side]))
        self.sums += _apart(*p)
        self.covered += self.width
        self.chunk, self.cells = None, ([], [])

    def vector(self, side: int, name: str, chunk: int, width: int, at: np.ndarray, n: np.ndarray) -> None:
        if chunk != self.chunk:
            self.close_chunk()
            self.chunk, self.width = chunk, width
        self.cells[side].append((name, at, n))

    def rows(self) -> Iterator[tuple]:
        self.close_chunk()
        left = self.terms - self.covered
        if left > 0:
            two = [np.full((len(t), 1), 2, np.int64) for t in self.total]
            self.sums += left * _apart(*[_shares(c, t) for c, t in zip(two, self.total)])
        lang, i, j = self.key[:3]
        for a, x in enumerate(self.names[0]):
            for b, y in enumerate(self.names[1]):
                if x != y:
                    yield lang, x, y, int(self.sums[a, b])
                    if i != j:
                        yield lang, y, x, int(self.sums[a, b])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile and chunk, a tile's groups (chunk -1) before its vectors; one tile is held at a time."""
    names = ["lang", "source", "item", "value"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    out, tile = [], None

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n != "cells"}
        lists = batch.column(batch.schema.names.index("cells"))
        ends, cells = lists.offsets.to_numpy(), lists.values
        at, n = (cells.field(k).to_numpy(zero_copy_only=False) for k in ("pos", "c"))
        for r in range(len(batch)):
            key = tuple(cols[k][r] for k in ("lang", "i", "j", "slab"))
            if tile is None or key != tile.key:
                out += tile.rows() if tile else []
                tile = _Tile(key)
                while len(out) > 20_000:
                    yield told(out[:20_000])
                    out = out[20_000:]
            # inside one block both sides are the same groups
            sides = (0, 1) if key[1] == key[2] else (int(cols["block"][r] == key[2]),)
            for side in sides:
                if cols["chunk"][r] < 0:
                    tile.group(side, cols["source"][r], cols["total"][r], cols["width"][r])
                else:
                    tile.vector(side, cols["source"][r], cols["chunk"][r], cols["width"][r], at[ends[r] : ends[r + 1]], n[ends[r] : ends[r + 1]])
    out += tile.rows() if tile else []
    for k in range(0, len(out), 20_000):
        yield told(out[k : k + 20_000])


def _pairs(cells: DataFrame, groups: DataFrame, placed: DataFrame, block: int, slab: int) -> DataFrame:
    """Rows (lang, source, item, value) of all pairs of groups of a language, both ways."""
    n = F.greatest(F.ceil(F.col("n_groups") / block), F.lit(1)).cast("int")
    blocks = groups.withColumn("n_blocks", n).withColumn("block", F.pmod(F.xxhash64("source"), n).cast("int"))
    blocks = written(blocks, "blocks")
    widths = placed.groupBy("lang", "chunk").agg(F.count("*").alias("width"))
    slabs = widths.groupBy("lang", F.floor(F.col("chunk") / slab).cast("int").alias("slab")).agg(F.sum("width").alias("width"))
    widths, slabs = written(widths, "widths"), written(slabs, "slabs")
    empty = F.array().cast("array<struct<pos:int,c:bigint>>")
    n_slabs = F.greatest(F.ceil(F.col("n_chunks") / slab), F.lit(1)).cast("int")
    roster = blocks.withColumn("slab", F.explode(F.sequence(F.lit(0), n_slabs - 1))).join(maybe_broadcast(slabs), ["lang", "slab"], "left")
    roster = roster.select("lang", "source", "block", "n_blocks", "slab", F.lit(-1).alias("chunk"), F.coalesce("width", F.lit(0)).cast("long").alias("width"), "total", empty.alias("cells"))
    packed = cells.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("pos", "c")).alias("cells"))
    packed = packed.join(maybe_broadcast(widths), ["lang", "chunk"]).join(maybe_broadcast(blocks).select("lang", "source", "block", "n_blocks"), ["lang", "source"])
    packed = packed.select("lang", "source", "block", "n_blocks", F.floor(F.col("chunk") / slab).cast("int").alias("slab"), "chunk", "width", F.lit(None).cast("long").alias("total"), "cells")
    rows = roster.unionByName(packed).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    rows = rows.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "slab", "chunk", "source", "block", "width", "total", "cells")
    tile = ["lang", "i", "j", "slab"]
    sums = rows.repartition(*tile).sortWithinPartitions(*tile, "chunk").mapInArrow(_tiles, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCS, top: int = TOP_TERMS, chunk: int = CHUNK, block: int = BLOCK, slab: int = SLAB) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): how far each other source of the language is, and the ``top`` terms by which a
    source stands out against its language."""
    counts = written(tally(docs, lang, source, text), "counts", "zstd")
    kept = counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("c").alias("all_c")).where(F.col("df") >= least).select("lang", "term", "all_c")
    kept = written(kept, "kept", "zstd")
    sizes = written(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_c").alias("all_n")), "sizes")
    n_chunks = F.greatest(F.ceil(F.col("v") / chunk), F.lit(1)).cast("int")
    place = F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    placed = kept.join(maybe_broadcast(sizes).select("lang", "v"), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), n_chunks).cast("int"))
    placed = written(placed.select("lang", "term", "all_c", "chunk", place.alias("pos")), "placed", "zstd")
    cells = written(counts.select("lang", "source", "term", "c").join(placed, ["lang", "term"]), "cells", "zstd")
    drop_written(counts, kept)

    none = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    names = written(docs.select(none(lang).alias("lang"), none(source).alias("source")).distinct(), "names")
    own = cells.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    per_lang = names.groupBy("lang").agg(F.count("*").alias("n_groups"))
    groups = names.join(own, ["lang", "source"], "left").join(per_lang, "lang").join(maybe_broadcast(sizes), "lang", "left")
    v = F.coalesce("v", F.lit(0))
    # where nothing is kept no share is looked at, so any total does
    groups = groups.select("lang", "source", "n_groups", F.greatest(F.coalesce("n", F.lit(0)) + 2 * v, F.lit(1)).alias("total"), F.ceil(v / chunk).cast("int").alias("n_chunks"), (F.col("all_n") + 2 * v).alias("all_total"))
    groups = written(groups, "groups")

    pairs = _pairs(cells, groups, placed, block, slab)
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", ranked)

    near = cells.join(maybe_broadcast(groups).select("lang", "source", "total", "all_total"), ["lang", "source"])
    near = near.select("lang", "source", F.col("term").alias("item"), share(F.col("c") + 2, F.col("total")).alias("p"), share(F.col("all_c") + 2, F.col("all_total")).alias("q")).where("p > q")
    near = near.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    return pairs.unionByName(near.select("*", ranked).where(F.col("rank") <= top))
