import hashlib
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from acrelake.operators import ingest, nearest, selection, spatial, store
from acrelake.sources import exports


def files_of(root):
    return {str(p.relative_to(root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(root).rglob("*.parquet")}


def test_a_cycle_is_seen_whole_or_not_at_all(spark, tmp_path):
    to = store.Store(spark, str(tmp_path / "s"))
    rows = lambda n: spark.range(n).select("id", F.lit("x").alias("v"))
    first = to.cycle("one")
    first.append("a", rows(3))
    first.append("b", rows(4))
    assert to.manifest().number == 0
    first.commit()
    dead = to.cycle("two")  # ends between two tables
    dead.append("a", rows(5))
    with pytest.raises(Exception, match="."):
        dead.append("b", rows(2).withColumn("v", F.raise_error(F.lit("lost"))))
    del dead
    assert (to.read("a").count(), to.read("b").count(), to.manifest().cycles) == (3, 4, ["one"])
    again = store.Store(spark, str(tmp_path / "s"))
    assert again.cycle("one") is None
    second = again.cycle("two")
    second.append("a", rows(5))
    second.replace("b", rows(1))
    assert second.commit() == 2
    assert (to.read("a").count(), to.read("b").count()) == (8, 1)
    assert (to.read("a", at=1).count(), to.read("b", at=1).count()) == (3, 4)
    assert len(again.sweep(keep=2)) == 1 and again.sweep(keep=2) == []
    assert to.read("b", at=1).count() == 4
    again.sweep()
    assert (to.read("a").count(), to.read("b").count()) == (8, 1)


def test_of_two_writers_the_second_fails(spark, tmp_path):
    to = store.Store(spark, str(tmp_path / "s"))
    a, b = to.cycle("a"), to.cycle("b")
    a.append("t", spark.range(2).toDF("id"))
    b.append("t", spark.range(3).toDF("id"))
    b.commit()
    with pytest.raises(store.Conflict):
        a.commit()
    assert to.read("t").count() == 3 and to.manifest().cycles == ["b"]
    assert not [p for p in (tmp_path / "s" / "manifests").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    with pytest.raises(ValueError, match="columns"):
        to.cycle("c").append("t", spark.range(1).toDF("other"))


def test_an_upsert_leaves_other_buckets_alone(spark, tmp_path):
    to = store.Store(spark, str(tmp_path / "s"))
    rows = spark.range(2000).select(F.col("id").alias("k"), F.lit("old").alias("v"), F.lit("seen").alias("first"), F.lit("GA").alias("state"))
    one = to.cycle("one")
    assert len(one.upsert("t", rows, "k", [F.lit(1)], ["first"], ["state"], buckets=32)) == 32
    one.commit()
    before, parts = files_of(tmp_path), to.manifest().tables["t"]["parts"]
    new = spark.createDataFrame([(5, "new", "late", "FL", 2), (5, "older", "late", "FL", 1), (9000, "added", None, "FL", 1), (None, "no key", None, None, 1)], "k long, v string, first string, state string, turn int")
    two = to.cycle("two")
    touched = two.upsert("t", new, "k", [F.col("turn").desc()], ["first"], ["state"], columns=["k", "v", "first", "state"])
    two.commit()
    after, now = files_of(tmp_path), to.manifest().tables["t"]["parts"]
    assert 1 <= len(touched) <= 2 and {b for b in parts if parts[b] != now[b]} == set(map(str, touched))
    assert {f: h for f, h in after.items() if f in before} == before
    got = {r.k: (r.v, r.first, r.state) for r in to.read("t").collect()}
    assert len(got) == 2001 and got[5] == ("new", "seen", "GA") and got[9000] == ("added", None, "FL") and got[6] == ("old", "seen", "GA")
    plan = to.read("t").where("k = 5")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,5)]" in plan
    none = to.cycle("three")
    assert none.upsert("t", new.where("k IS NULL"), "k", [F.lit(1)], columns=["k", "v", "first", "state"]) == []


def exact(values, q):
    values = sorted(values)
    at = (len(values) - 1) * q
    lo = math.floor(at)
    return values[lo] + (values[min(lo + 1, len(values) - 1)] - values[lo]) * (at - lo)


@pytest.mark.parametrize("q", [0.5, 0.0, 0.37, 1.0])
def test_selection_is_exact(spark, q):
    rng = random.Random(4)
    groups = {
        "hot": [rng.gauss(0, 1) for _ in range(6000)],
        "ties": [0.0] * 1500 + [1.0] * 1500,
        "ends": [0.0] * 1400 + [rng.random() for _ in range(200)] + [1.0] * 1401,
        "wide": [10.0 ** rng.randint(-300, 300) * rng.choice((-1, 1)) for _ in range(2001)],
        "equal": [7.0] * 3000,
        "one": [3.0],
        None: [1.0, 2.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("nulls", None), ("one", None)]
    got = {r.g: (r.n, r.v) for r in selection.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", q, bin_rows=50).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g][0] == len(vs) and got[g][1] == pytest.approx(exact(vs, q), rel=1e-12, abs=1e-300), g
    assert selection.quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v").count() == 0


def test_no_task_sorts_more_than_a_bin(spark):
    rows = spark.range(300_000).select(F.lit("g").alias("g"), F.rand(3).alias("v"))
    seen = []
    at_rank = selection._at_rank
    selection._at_rank = lambda rows, state, ids: seen.append(state.agg(F.max("inside")).first()[0]) or at_rank(rows, state, ids)
    try:
        got = selection.medians(rows, ["g"], "v", bin_rows=2000).first()
    finally:
        selection._at_rank = at_rank
    assert seen[0] <= 2000 and got.v == rows.agg(F.percentile("v", F.lit(0.5))).first()[0]


def miles(a, b):
    x0, y0, x1, y1 = map(math.radians, (*a, *b))
    h = math.sin((y1 - y0) / 2) ** 2 + math.cos(y0) * math.cos(y1) * math.sin((x1 - x0) / 2) ** 2
    return 2 * 3958.7613 * math.asin(math.sqrt(min(h, 1.0)))


def places(n, seed):
    rng = random.Random(seed)
    out = [(rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(n)]
    out += [(rng.uniform(-84.5, -84.4), rng.uniform(33.7, 33.8)) for _ in range(n)]  # a crowded place
    return out + [(-179.9999, 10.0), (179.9999, 10.0), (0.0, 89.999), (180.0, 89.999), (45.0, -90.0), (-84.45, 33.75), (-84.45, 33.75), (12.0, 75.0), (12.5, 75.0)]


def test_nearest_is_brute_force(spark):
    a, b = places(60, 1), places(150, 2)
    schema = "id long, x double, y double"
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(a)] + [(1000, None, 1.0), (1001, 400.0, 1.0)], schema)
    right = spark.createDataFrame([(i, *p) for i, p in enumerate(b)] + [(2000, 1.0, None)], schema).withColumnRenamed("id", "to")
    got = {r.id: (r.to, r.miles) for r in nearest.nearest(left, right, "id", "to").collect()}
    assert sorted(got) == list(range(len(a)))
    for i, p in enumerate(a):
        best = min(miles(p, x) for x in b)
        assert got[i][1] == pytest.approx(best, abs=1e-6) and miles(p, b[got[i][0]]) == pytest.approx(best, abs=1e-6)
    assert got[len(a) - 4][0] == len(b) - 4  # of two at one place the smaller id
    assert nearest.nearest(left, right.limit(0), "id", "to").count() == 0


def test_within_miles_is_brute_force(spark):
    a, b = places(80, 3), places(80, 4)
    schema = "id long, x double, y double"
    left, right = (spark.createDataFrame([(i, *p) for i, p in enumerate(x)] + [(999, None, 0.0)], schema) for x in (a, b))
    for limit in (0.5, 20.0, 3000.0):
        got = {r.id for r in spatial.within_miles(left, right, limit).collect()}
        assert got == {i for i, p in enumerate(a) if min(miles(p, q) for q in b) <= limit}
    line = spatial.within_miles(left.where("id = 160"), spark.createDataFrame([(0, 179.9999, 10.0)], schema), 0.1)
    assert line.count() == 1


def test_an_ingestion_cycle(spark, tmp_path):
    """A delivery with bad rows and a bad file; its flags name lines, its files move, and the same cycle again does nothing."""
    spec = exports.LAND_SALES
    (tmp_path / "in").mkdir()
    row = lambda address, price: ",".join({"address": f'"{address}"', "submarket": "m", "acres": "5", "sale_date": "2026-01-02", "sale_price": price}.get(c, "") for c in spec.columns)
    head = ",".join(spec.columns)
    (tmp_path / "in" / "land_sales_comps_202601.csv").write_text("\n".join([head, row("1\nMain", "10"), row("2 Main", "0"), row("3 Main", "x"), row("4 Main", "40"), row("4 Main", "41")]))
    (tmp_path / "in" / "land_sales_comps_202602.csv").write_text("address,x\n1,2\n")
    to = store.Store(spark, str(tmp_path / "s"))
    files = ingest.ingest(to, "c1", spec, str(tmp_path / "in"), buckets=4)
    got = {r.file.rsplit("/", 1)[1]: (r.rows_loaded, r.rows_failed, (r.error or "")[:14]) for r in files.collect()}
    assert got == {"land_sales_comps_202601.csv": (3, 2, ""), "land_sales_comps_202602.csv": (0, 0, "missing column")}
    assert sorted((r.address, r.sale_price) for r in to.read("land_sales_comps").collect()) == [("1\nMain", 10), ("4 Main", 40), ("4 Main", 41)]
    assert sorted(r.description.split("202601.csv ")[1] for r in to.read("flags").collect()) == ["line 4: sale_price: out of range", "line 5: sale_price: not a number"]
    assert "file=land_sales_comps_202601.csv rows_loaded=3 rows_failed=2" in " ".join(r.notes for r in to.read("log").collect())
    (tmp_path / "done").mkdir()
    (tmp_path / "done" / "land_sales_comps_202601.csv").write_text("before")
    moved = ingest.settle(spark, files, str(tmp_path / "done"), str(tmp_path / "bad"))
    assert sorted(p.rsplit("/", 2)[1] + "/" + p.rsplit("/", 1)[1] for p in moved.values()) == ["bad/land_sales_comps_202602.csv", "done/land_sales_comps_202601.csv.1"]
    assert not [p for p in (tmp_path / "in").iterdir() if p.suffix == ".csv" and not p.name.startswith(".")] and ingest.settle(spark, files, str(tmp_path / "done"), str(tmp_path / "bad")) == {}
    assert ingest.ingest(to, "c1", spec, str(tmp_path / "nowhere")) is None
    (tmp_path / "in" / "land_sales_comps_202603.csv").write_text("\n".join([head, row("4 Main", "50")]))
    ingest.ingest(to, "c2", spec, str(tmp_path / "in" / "land_sales_comps_202603.csv"))
    assert sorted((r.address, r.sale_price) for r in to.read("land_sales_comps").collect()) == [("1\nMain", 10), ("4 Main", 50)]
