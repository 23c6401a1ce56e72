"""Planar geometry over rings, array<struct<x, y>>, as higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth.
RADIUS_MILES = 3958.7613


def signed_area(ring: Column) -> Column:
    """Shoelace formula, positive when counter-clockwise; fewer than three points have none."""
    n = F.size(ring)
    term = lambda i: F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"]
    return F.when(n >= 3, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + term(i)) / 2).otherwise(0.0)


def vertex_centroid(ring: Column) -> Column:
    mean = lambda f: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[f]) / F.size(ring)
    return F.when(F.size(ring) > 0, F.struct(mean("x").alias("x"), mean("y").alias("y")))


def box(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule by a ray to the right."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + n - 1) % n)
        run = F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"])
        return ((a["y"] > y) != (b["y"] > y)) & F.coalesce(x < run + a["x"], F.lit(False))

    return F.when(n >= 3, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), lambda odd, i: odd != crosses(i))).otherwise(False)


def envelope(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Closed box; a missing coordinate is outside."""
    return F.coalesce(x.between(x0, x1) & y.between(y0, y1), F.lit(False))


def largest_outer(rings: Column, orientation: str = "reference") -> Column:
    """struct(ring, reduced) of an array of rings: the outer ring of greatest area, the first of equal ones; ``reduced`` if there were several.
    Outer rings run counter-clockwise for ``reference`` (which is what its files hold) and clockwise for ``esri``; where none does, all are taken."""
    sign = 1 if orientation == "reference" else -1
    sized = F.transform(rings, lambda r, i: F.struct(F.abs(signed_area(r)).alias("size"), (-i).alias("place"), (sign * signed_area(r) >= 0).alias("outer"), r.alias("ring")))
    outer = F.filter(sized, lambda s: s["outer"])
    chosen = F.when(F.size(outer) > 0, outer).otherwise(sized)
    return F.struct(F.array_max(chosen)["ring"].alias("ring"), (F.size(outer) > 1).alias("reduced"))


def wkt(ring: Column) -> Column:
    return F.concat(F.lit("POLYGON(("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", "), F.lit("))"))


def in_degrees(x: Column, y: Column) -> Column:
    return F.coalesce(x.between(-180, 180) & y.between(-90, 90), F.lit(False))


def miles(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Great-circle distance by the haversine."""
    rad = lambda c: F.radians(c)
    h = F.pow(F.sin((rad(y1) - rad(y0)) / 2), F.lit(2.0)) + F.cos(rad(y0)) * F.cos(rad(y1)) * F.pow(F.sin((rad(x1) - rad(x0)) / 2), F.lit(2.0))
    return 2 * RADIUS_MILES * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


#: Half axes of the ellipsoid WGS 84 in metres.
MAJOR, MINOR = 6378137.0, 6356752.314245179
_ECCENTRICITY = (1 - (MINOR / MAJOR) ** 2) ** 0.5


def _authalic(lat: Column) -> Column:
    """The area between the equator and a latitude for each radian of longitude, over half the square of the minor axis."""
    s = F.sin(F.radians(lat))
    return s / (1 - _ECCENTRICITY**2 * s * s) + F.atanh(_ECCENTRICITY * s) / _ECCENTRICITY


def ellipsoid_area(ring: Column) -> Column:
    """Signed area in square metres on the ellipsoid of a ring in degrees, positive when counter-clockwise. Edges are straight in
    longitude and latitude, and their areas come by Simpson's rule from the latitude of the first point, so that small rings lose no
    digits; an edge goes the short way around, and no ring goes around a pole."""
    n = F.size(ring)

    def under(i: Column, base: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        wide = b["x"] - a["x"]
        turn = F.radians(wide - 360.0 * F.round(wide / 360.0))
        mean = (_authalic(a["y"]) - base) + 4 * (_authalic((a["y"] + b["y"]) / 2) - base) + (_authalic(b["y"]) - base)
        return turn * mean / 6

    total = F.transform(F.array(_authalic(F.get(ring, F.lit(0))["y"])), lambda base: F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc - under(i, base)))[0]
    return F.when(n >= 3, total * (MINOR**2 / 2)).otherwise(0.0)
