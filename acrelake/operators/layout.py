"""Tables laid out by place: a folder for each tile and rows in the order of a curve within, in place of an index of geometry.

A query by box names the tiles that it can touch, so the folders of all others are never listed for reading, and within a file the
row groups that the box misses are skipped by their bounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Halvings of a tile that the curve tells apart.
BITS = 10
_TILE = ("tile_x", "tile_y")


def curve(x: Column, y: Column, width: float, bits: int = BITS) -> Column:
    """The place of a point of a tile on a curve that takes its quarters one after the other, and theirs in the same way."""
    cells = 1 << bits
    within = lambda c: F.least(F.floor(F.pmod(c, F.lit(width)) / width * cells), F.lit(cells - 1)).cast("long")
    out = F.lit(0).cast("long")
    for b in range(bits):
        for shift, c in ((0, within(x)), (1, within(y))):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1)), 2 * b + shift))
    return out


def write_tiles(df: DataFrame, path: str, x: str, y: str, width: float) -> None:
    """Writes ``df`` by tiles of ``width``; large tiles are spread over several files, rows without a place go to a tile of their own."""
    tiled = df.select("*", *[F.floor(F.col(c) / width).cast("long").alias(t) for c, t in zip((x, y), _TILE)], curve(F.col(x), F.col(y), width).alias("_at"))
    # each task's rows in the order of tiles, as files are written one after the other, and of the curve within
    tiled.hint("rebalance", *_TILE).sortWithinPartitions(*_TILE, "_at").drop("_at").write.partitionBy(*_TILE).parquet(path)


def read_box(spark: SparkSession, path: str, x: str, y: str, width: float, box: tuple[float, float, float, float], reach: float = 0.0) -> DataFrame:
    """Rows with their place in the closed box (x0, y0, x1, y1). Where rows are more than points and stand at their lower corners, ``reach``
    is the greatest extent of one, and rows that may meet the box are given."""
    x0, y0, x1, y1 = box
    lo, hi = (lambda v: math.floor(v / width)), (lambda v: math.floor(v / width))
    tiles = F.col("tile_x").between(lo(x0 - reach), hi(x1)) & F.col("tile_y").between(lo(y0 - reach), hi(y1))
    return spark.read.parquet(path).where(tiles).where(F.col(x).between(x0 - reach, x1) & F.col(y).between(y0 - reach, y1)).drop(*_TILE)
