import datetime
import os

import pytest
from pyspark.sql import functions as F

from acrelake.operators import discovery, layout


def files_read(df):
    """The files that the scan of ``df`` took after it ran."""
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_a_box_reads_few_files(spark, tmp_path):
    rows = spark.range(20_000).select("id", (F.rand(1) * 10 - 5).alias("x"), (F.rand(2) * 10 - 5).alias("y")).union(spark.createDataFrame([(-1, None, 1.0)], "id long, x double, y double"))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    layout.write_tiles(rows, str(tmp_path / "t"), "x", "y", 1.0)
    every = spark.read.parquet(str(tmp_path / "t"))
    assert every.drop("tile_x", "tile_y").exceptAll(rows).count() == 0 and every.count() == 20_001
    box = (0.2, -0.7, 1.1, 0.4)
    got = layout.read_box(spark, str(tmp_path / "t"), "x", "y", 1.0, box)
    want = {r.id for r in rows.where(F.col("x").between(0.2, 1.1) & F.col("y").between(-0.7, 0.4)).collect()}
    assert {r.id for r in got.collect()} == want and len(want) > 100
    total = len(every.inputFiles())
    got = layout.read_box(spark, str(tmp_path / "t"), "x", "y", 1.0, box)
    got._jdf.queryExecution().executedPlan().execute().count()
    assert 0 < files_read(got) <= total * 6 / 100 + 4
    wide = layout.read_box(spark, str(tmp_path / "t"), "x", "y", 1.0, (3.0, 3.0, 3.0, 3.0), reach=0.5)
    assert {r.id for r in wide.collect()} == {r.id for r in rows.where("x BETWEEN 2.5 AND 3 AND y BETWEEN 2.5 AND 3").collect()}


def test_the_curve_keeps_near_places_together(spark):
    df = spark.range(16).select((F.col("id") % 4 + 0.5).alias("x"), (F.floor(F.col("id") / 4) + 0.5).alias("y"))
    got = [(r.x, r.y) for r in df.orderBy(layout.curve(F.col("x"), F.col("y"), 4.0, 2)).collect()]
    assert got[:4] == [(0.5, 0.5), (1.5, 0.5), (0.5, 1.5), (1.5, 1.5)] and got[-1] == (3.5, 3.5)


def test_registry_and_freshness(spark, tmp_path):
    sources = spark.createDataFrame([("a", 1), ("b", 2), ("_note", 3)], "name string, layer int")
    overlay = spark.createDataFrame([("a", "m1"), ("_x", "m2")], "name string, market string")
    got = discovery.merged_registry(sources, overlay, "name", {"market": "m0"}).collect()
    assert sorted(tuple(r) for r in got) == [("a", 1, "m1"), ("b", 2, "m0")]
    with pytest.raises(ValueError, match="c"):
        discovery.merged_registry(sources, overlay.union(spark.createDataFrame([("c", "m")], overlay.schema)), "name", {})
    now = datetime.datetime(2026, 6, 1, 12)
    for name, days in (("in/new.csv", 2), ("in/old.csv", 40), ("in/x.txt", 1), ("in/done/new.csv", 1), ("top.csv", 1)):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("x")
        stamp = (now - datetime.timedelta(days=days)).replace(tzinfo=datetime.timezone.utc).timestamp()
        os.utime(at, (stamp, stamp))
    assert [r.path.rsplit("/", 2)[1:] for r in discovery.fresh_exports(spark, str(tmp_path), now.replace(tzinfo=datetime.timezone.utc)).collect()] == [["in", "new.csv"]]
    assert discovery.fresh_exports(spark, str(tmp_path / "none"), now).count() == 0
