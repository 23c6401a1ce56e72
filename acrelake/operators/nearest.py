"""Nearest neighbours on the sphere by descending a tree of cells.

Places become points of the unit sphere in space, so neither the date line nor the poles are borders and chords grow with great-circle
distances. The points searched are dealt into nested cubes; each cube knows the box of the points in it. From the whole sphere down, each row keeps
those cubes that may hold its nearest point: whose nearest possible point is no further than the furthest possible one of another cube.
What is left at the finest cubes is a few points for each row, however far its neighbour is and however crowded a place is, and no radius
is fixed beforehand. Every step is a join by cube; a crowded cube is split by AQE as a skewed key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelake.functions import geometry
from acrelake.sources import scratch

#: Halvings of the sphere's cube down to the finest cells, which are some 12 metres wide, and halvings in one step.
DEPTH = 20
STEP = 2
#: Chords closer than this are told apart by the final distance alone.
SLACK = 1e-12
_AXES = ("x", "y", "z")


def _space(lng: Column, lat: Column) -> list[Column]:
    flat, up = F.radians(lng), F.radians(lat)
    return [(F.cos(up) * F.cos(flat)).alias("x"), (F.cos(up) * F.sin(flat)).alias("y"), F.sin(up).alias("z")]


def _cell(level: int) -> list[Column]:
    """The numbers of a point's cube at a level."""
    return [F.least(F.floor((F.col(a) + 1) / 2 * (1 << level)), F.lit((1 << level) - 1)).alias(f"c{a}") for a in _AXES]


def _known(lng: Column, lat: Column) -> Column:
    return F.coalesce(lng.between(-180, 180) & lat.between(-90, 90), F.lit(False))


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, x: str = "x", y: str = "y", depth: int = DEPTH) -> DataFrame:
    """Rows (left_id, right_id, miles): for each row of ``left`` (ids unique, x and y in degrees) the nearest row of ``right``, of equally
    near ones the smallest id. Rows without coordinates in degrees have none and are none; an empty ``right`` gives an empty result."""
    a = scratch.written(left.where(_known(F.col(x), F.col(y))).select(F.col(left_id).alias("_l"), *_space(F.col(x), F.col(y)), F.col(x).alias("_x"), F.col(y).alias("_y")), "places")
    places = right.where(_known(F.col(x), F.col(y))).groupBy(F.col(x).cast("double").alias("_u"), F.col(y).cast("double").alias("_v")).agg(F.min(right_id).alias("_r"))
    points = scratch.written(places.select("_r", "_u", "_v", *_space(F.col("_u"), F.col("_v"))), "points")

    kept, level = a.select("_l", *_AXES, *[F.lit(0).cast("long").alias(f"c{c}") for c in _AXES]), 0
    while level < depth:
        step = min(STEP, depth - level)
        level += step
        boxes = points.groupBy(*_cell(level)).agg(*[f(c).alias(f"{n}{c}") for c in _AXES for n, f in (("lo", F.min), ("hi", F.max))])
        boxes = boxes.select("*", *[F.shiftright(F.col(f"c{c}"), step).alias(f"p{c}") for c in _AXES])
        on = [F.col(f"k.c{c}") == F.col(f"b.p{c}") for c in _AXES]
        met = kept.alias("k").join(boxes.alias("b"), on)
        low, high = F.lit(0.0), F.lit(0.0)
        for c in _AXES:
            at, lo, hi = F.col(f"k.{c}"), F.col(f"b.lo{c}"), F.col(f"b.hi{c}")
            low = low + F.pow(F.greatest(lo - at, at - hi, F.lit(0.0)), F.lit(2.0))
            high = high + F.pow(F.greatest(at - lo, hi - at), F.lit(2.0))
        met = met.select("k._l", *[f"k.{c}" for c in _AXES], *[f"b.c{c}" for c in _AXES], F.sqrt(low).alias("_near"), F.sqrt(high).alias("_far"))
        met = scratch.written(met, "met")
        bound = met.groupBy("_l").agg(F.min("_far").alias("_most"))
        kept = scratch.written(met.join(bound, "_l").where(F.col("_near") <= F.col("_most") + SLACK).drop("_near", "_far", "_most"), "kept")
    held = points.select("_r", "_u", "_v", *_cell(depth)).alias("b")
    pairs = kept.alias("k").join(held, [F.col(f"k.c{c}") == F.col(f"b.c{c}") for c in _AXES]).join(a.select(F.col("_l").alias("_a"), "_x", "_y"), F.col("k._l") == F.col("_a"))
    far = geometry.miles(F.col("_x"), F.col("_y"), F.col("_u"), F.col("_v"))
    best = pairs.groupBy(F.col("k._l").alias("_l")).agg(F.min(F.struct(far.alias("miles"), F.col("_r").alias("r"))).alias("m"))
    return best.select(F.col("_l").alias(left_id), F.col("m.r").alias(right_id), F.col("m.miles").alias("miles"))
