"""A discovery cycle: all or nothing, once, on empty and repeated features."""

import pytest
from pyspark.sql import functions as F

from acrelake.operators.discover import REDUCED, discover
from acrelake.operators.store import Store

SCHEMA = "parcel_id string, skip_reason string, multipolygon boolean, corridor string, acreage double, owner_type_inferred string, zoning string, status string"
COLUMNS = ["parcel_id", "acreage", "zoning"]
ROWS = [
    ("a", None, True, "x", 20.0, "llc", None, ""),
    ("a", None, False, "x", 30.0, None, "M-1", ""),
    ("b", None, None, None, None, None, None, ""),
    (None, None, None, "y", 20.0, None, None, ""),
    ("c", "no geometry", None, "y", 20.0, None, None, ""),
]


def run(spark, store, name, rows):
    frame = spark.createDataFrame(rows, SCHEMA).drop("status")
    return discover(store, name, frame, "m", [("H1: too small", F.col("acreage") < 12)], [("H5: no zone", F.col("zoning").isNull())], COLUMNS, [F.col("acreage").desc()], buckets=4)


def test_cycle_with_repeats_and_nulls(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    counts = {r.corridor: r for r in run(spark, store, "d1", ROWS).collect()}
    assert (counts["total"].discovery, counts["total"].skip_unmappable, counts["total"].rejection_h1) == (2, 2, 1)
    assert counts["x"].discovery == 2 and counts[None].rejection_h1 == 1
    assert [tuple(r) for r in store.read("parcels").collect()] == [("a", 30.0, "M-1")]
    said = sorted((r.action_type, r.parcel_id or "", r.notes) for r in store.read("log").collect())
    assert said == [
        ("discovery", "a", "corridor=x; acreage=20.0; owner_type=llc"),
        ("discovery", "a", "corridor=x; acreage=30.0; owner_type=None"),
        ("rejection", "", "unmappable feature: no geometry"),
        ("rejection", "", "unmappable feature: no key"),
        ("rejection", "b", "H1: too small"),
    ]
    assert sorted(r.description for r in store.read("flags").collect()) == ["H5: no zone", REDUCED]


def test_known_cycle_is_a_no_op_and_empty_one_counts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    run(spark, store, "d1", ROWS)
    before = store.manifest()
    assert run(spark, store, "d1", ROWS[:1]) is None
    assert store.manifest() == before
    assert run(spark, store, "d2", []).collect() is not None
    assert store.manifest().cycles == ["d1", "d2"]
    assert store.read("parcels").count() == 1 and store.read("log").count() == 5


def test_a_cycle_that_fails_shows_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    run(spark, store, "d1", ROWS)
    monkeypatch.setattr("acrelake.operators.store.Cycle.commit", lambda self: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        run(spark, store, "d2", [("z", None, None, "x", 99.0, None, None, "")])
    assert store.read("parcels").count() == 1 and store.read("log").count() == 5
    monkeypatch.undo()
    run(spark, store, "d2", [("z", None, None, "x", 99.0, None, None, "")])
    assert store.read("parcels").count() == 2
