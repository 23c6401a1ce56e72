"""Scores by documented cuts for measures beyond those of the scoring cycle.

A null measure has a null score; a value on a border belongs to the better band.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (limit, score) by the first limit that isn't exceeded; 0 beyond all.
INTERCHANGE_MILES = ((1, 10), (3, 8), (5, 5), (10, 2))
GRADE_FEET = ((3, 10), (8, 7), (15, 4))
GENERATOR_MILES = ((5, 10), (10, 7), (20, 3))
#: Scores of the ways to an entitlement, and by the number of incentives.
ENTITLEMENT = {"by_right": 10, "minor_variance": 7, "rezoning_with_precedent": 4, "rezoning": 1}
INCENTIVES = (0, 4, 7, 10)


def up_to(value: Column, bands: tuple[tuple[float, int], ...]) -> Column:
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for limit, score in bands:
        out = out.when(value <= limit, score)
    return out.otherwise(0)


def labor(workers: Column) -> Column:
    return F.when(workers > 200_000, 10).when(workers >= 100_000, 7).when(workers >= 50_000, 4).when(workers.isNotNull(), 0)


def entitlement(way: Column) -> Column:
    """Null for a way that isn't known."""
    out = F.lit(None).cast("int")
    for name, score in ENTITLEMENT.items():
        out = F.when(way == name, score).otherwise(out)
    return out


def incentives(count: Column) -> Column:
    place = F.greatest(F.lit(0), F.least(count, F.lit(len(INCENTIVES) - 1))).cast("int")
    return F.when(count.isNotNull(), F.get(F.array(*[F.lit(s) for s in INCENTIVES]), place))


def rail(access: Column, miles: Column) -> Column:
    """``access`` is spur, adjacent or another text; ``miles`` to the next line. Null where neither is known."""
    return F.when(access == "spur", 10).when(access == "adjacent", 7).when(miles <= 1, 3).when(access.isNotNull() | miles.isNotNull(), 0)
