"""Points in polygons by a grid: an equi-join on cells, then the exact test."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelake.functions import geometry


def inside(points: DataFrame, polygons: DataFrame, x: str = "x", y: str = "y", cell: float = 0.1) -> DataFrame:
    """The rows of ``points`` that lie in any of ``polygons`` (ring, box); rows without coordinates lie in none.

    Each point has one cell, a polygon those of its box, so the work grows with the points near a polygon and not with
    points times polygons. As a semi-join, a point in several polygons comes once.
    """
    step = lambda c: F.floor(c / cell)
    tiles = polygons.select("ring", "box", F.explode(F.sequence(step(F.col("box.x0")), step(F.col("box.x1")))).alias("_cx"))
    tiles = tiles.select("ring", "box", "_cx", F.explode(F.sequence(step(F.col("box.y0")), step(F.col("box.y1")))).alias("_cy")).alias("t")
    p = points.alias("p")
    px, py = F.col(f"p.{x}"), F.col(f"p.{y}")
    near = (step(px) == F.col("t._cx")) & (step(py) == F.col("t._cy")) & px.between(F.col("t.box.x0"), F.col("t.box.x1")) & py.between(F.col("t.box.y0"), F.col("t.box.y1"))
    return p.join(tiles, near & geometry.contains(F.col("t.ring"), px, py), "left_semi")


def within_miles(left: DataFrame, right: DataFrame, limit: float) -> DataFrame:
    """The rows of ``left`` (x, y in degrees) with a row of ``right`` within ``limit`` miles. Places are points of the unit sphere in
    space and cells are cubes as wide as the limit's chord, so the join is on cells and exact at any latitude and across the date line.
    A crowded cell of ``left`` is split as a skewed key."""
    width = 2 * math.sin(min(limit / geometry.RADIUS_MILES, math.pi) / 2) * (1 + 1e-9) + 1e-12
    axes = ("a", "b", "c")

    def cells(lng: Column, lat: Column) -> list[Column]:
        flat, up = F.radians(lng), F.radians(lat)
        return [F.floor(v / width) for v in (F.cos(up) * F.cos(flat), F.cos(up) * F.sin(flat), F.sin(up))]

    near = F.sequence(F.lit(-1), F.lit(1))
    tiles = right.select("x", "y", *[c.alias(f"_{n}") for n, c in zip(axes, cells(F.col("x"), F.col("y")))]).where("_a IS NOT NULL AND _c IS NOT NULL")
    for n in axes:
        tiles = tiles.withColumn(f"_{n}", F.explode(F.transform(near, lambda d: F.col(f"_{n}") + d)))  # noqa: B023
    tiles = tiles.alias("r")
    l = left.alias("l")
    on = geometry.miles(F.col("l.x"), F.col("l.y"), F.col("r.x"), F.col("r.y")) <= limit
    for n, c in zip(axes, cells(F.col("l.x"), F.col("l.y"))):
        on = on & (c == F.col(f"r._{n}"))
    return l.join(tiles, on, "left_semi")
