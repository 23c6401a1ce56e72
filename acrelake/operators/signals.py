"""Signals of land whose use doesn't match its place, and the neighbour joins behind them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelake.operators import spatial

#: Fixed value: so many signals make a parcel one to approach.
LEAST_SIGNALS = 3
#: Fixed value: years of one owner that count as a long hold.
LONG_HOLD_YEARS = 15
#: Fixed value: neighbours developed that surround a parcel.
SURROUNDED = 3
#: Miles within which a sale or a project counts, and months for which a sale does.
NEAR_MILES, SALE_MONTHS = 1.0, 12


def touching(left: DataFrame, right: DataFrame, key: str, cell: float) -> DataFrame:
    """Rows (key, other): boxes (x0, y0, x1, y1) of ``left`` and ``right`` that share points of their borders but none inside.

    Each box goes to the cells that it covers and boxes meet by cell; a pair is kept in the cell of the lower corner of what they
    share alone, so it comes out once without a distinct. Cells should be about as wide as the boxes. A box with a null side touches
    nothing; one box doesn't touch itself."""
    step = lambda c: F.floor(c / cell)
    span = lambda lo, hi: F.sequence(step(F.col(lo)), step(F.col(hi)))

    def tiles(boxes: DataFrame, name: str) -> DataFrame:
        boxes = boxes.select(F.col(key).alias("k"), "x0", "y0", "x1", "y1").where("x0 <= x1 AND y0 <= y1")
        return boxes.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1"))).alias(name)

    a, b = tiles(left, "a"), tiles(right, "b")
    meet = F.expr("a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
    overlap = F.expr("a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1")
    here = (step(F.greatest("a.x0", "b.x0")) == F.col("a.cx")) & (step(F.greatest("a.y0", "b.y0")) == F.col("a.cy"))
    pairs = a.join(b, F.expr("a.cx = b.cx AND a.cy = b.cy AND a.k <> b.k") & meet & ~overlap & here)
    return pairs.select(F.col("a.k").alias(key), F.col("b.k").alias("other"))


def absentee(mailing: Column, state: str = "GA") -> Column:
    """An address that ends in some state's code and five digits but isn't in ``state``; null where there is none."""
    return ~mailing.contains(f"{state} ") & mailing.rlike(r"[A-Z]{2} \d{5}")


def long_hold(since: Column, as_of: Column) -> Column:
    return since < F.add_months(as_of, -12 * LONG_HOLD_YEARS)


def recent_sale(sold: Column, price: Column, acres: Column, industrial: Column, as_of: Column) -> Column:
    """A sale of the last SALE_MONTHS, none to come, at or above what an acre of industrial land costs."""
    return sold.between(F.add_months(as_of, -SALE_MONTHS), as_of) & (acres > 0) & (F.try_divide(price, acres) >= industrial)


def with_near(sites: DataFrame, key: str, places: dict[str, DataFrame], limit: float = NEAR_MILES) -> DataFrame:
    """``sites`` (key, x, y in degrees) with a column for each of ``places`` (x, y) that says whether one of them is within ``limit`` miles; a
    site without coordinates has none near. Each costs one join on cells and one on the key, whatever lies close together."""
    for name, rows in places.items():
        met = spatial.within_miles(sites.select(key, "x", "y"), rows, limit).select(key, F.lit(True).alias(name)).dropDuplicates([key])
        sites = sites.join(met, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return sites


def counted(df: DataFrame, signals: list[str]) -> DataFrame:
    """``df`` with ``n_signals``, the columns of ``signals`` that are true, and ``outreach``; an unknown signal isn't one."""
    n = reduce(Column.__add__, [F.coalesce(F.col(s), F.lit(False)).cast("int") for s in signals])
    return df.withColumn("n_signals", n).withColumn("outreach", n >= LEAST_SIGNALS)
