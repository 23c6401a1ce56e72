"""Verdicts with a lifetime, in batches and as a stream; sections of snapshots; signals of what lies near."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from acrelake.functions import snapshot
from acrelake.operators import signals
from acrelake.streaming import verdicts

START = datetime.datetime(2026, 1, 1)
SCHEMA = "source string, at timestamp, health string, status string"


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def expected(rows, lifetime):
    kept, out = {}, []
    for source, when, health in sorted(rows, key=lambda r: (r[0], r[1], r[2] is None, r[2] or "")):
        if source in kept and (when - kept[source][0]).total_seconds() < lifetime:
            out.append((source, when, kept[source][1], True))
        elif health in ("healthy", "degraded"):
            kept[source] = (when, health)
            out.append((source, when, health, False))
        else:
            out.append((source, when, "failing", False))
    return out


def test_batch_against_brute_force(spark):
    dice = random.Random(3)
    rows = [(dice.choice("aaaaaab") if i % 3 else f"s{i % 40}", at(dice.randrange(4000)), dice.choice(["healthy", "degraded", "failing", "odd", None])) for i in range(3000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows] + [(None, at(1), "healthy", ""), ("a", None, "healthy", "")], SCHEMA)
    got = [tuple(r) for r in verdicts.served_rows(frame, 90).collect()]
    assert sorted(got) == sorted(expected(rows, 90))
    assert verdicts.served_rows(frame.limit(0), 90).collect() == []


def test_lifetime_ends_at_its_second_and_failing_is_never_served(spark):
    rows = [("a", at(0), "failing"), ("a", at(1), "healthy"), ("a", at(10), "failing"), ("a", at(11), "failing"), ("a", at(12), "degraded")]
    got = verdicts.served_rows(spark.createDataFrame([(*r, "") for r in rows], SCHEMA), 10).orderBy("at").collect()
    assert [(r.status, r.served) for r in got] == [("failing", False), ("healthy", False), ("healthy", True), ("failing", False), ("degraded", False)]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_stream_keeps_verdicts_over_batches_and_a_restart(spark, rocks, tmp_path):
    steps = [
        [("a", at(0), "healthy"), ("b", at(0), "failing"), ("c", at(5), None)],
        [("a", at(3000), "failing"), ("b", at(1), "degraded"), ("b", at(2), "failing")],
        [("a", at(3600), "failing"), ("b", at(3600), "failing"), ("b", at(3601), "failing")],
    ]
    for rows in steps:
        spark.createDataFrame([(*r, "") for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = verdicts.served(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), 3600)
        job = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
        try:
            end = time.time() + 60
            while sum(p.numInputRows for p in job.recentProgress) < len(rows) and time.time() < end:
                assert job.exception() is None
                time.sleep(0.2)
        finally:
            job.stop()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(expected([r for rows in steps for r in rows], 3600))


def test_snapshot_of_nothing_known(spark):
    none = F.lit(None).cast("string")
    weights = {"s1": 60, "s2": 40}
    head = snapshot.heading(none, none, F.lit(" "), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit("BELOW THRESHOLD"))
    blockers = F.create_map().cast("map<string,string>")
    sections = {"Scores": snapshot.breakdown(weights), "Gates": snapshot.gates(none, blockers), "Flags": snapshot.open_flags(F.array().cast("array<struct<kind:string,text:string>>")), "Left out": none}
    said = snapshot.recommendation(F.lit(None).cast("double"), none, 65, none, blockers)
    row = spark.range(1).select(F.lit(None).cast("int").alias("s1"), F.lit(7).alias("s2")).select(snapshot.document(head, sections).alias("text"), said.alias("said")).first()
    assert row.text.startswith("# Site Snapshot: —\n## — — — | — | Score: —/100 | BELOW THRESHOLD\n\n### Scores\n")
    assert "| interstate proximity | — | 60 | 0.00 |\n| parcel geometry | 7/10 | 40 | 280.00 |\n| **Composite** |  |  | **28.0/100** |" in row.text
    assert row.text.endswith("**Overall actionability**: PENDING\n\n### Flags\n- (no open flags)\n")
    assert row.said == "**PASS** — Composite score -1.0 is below the 65 qualification threshold."


def test_cells_are_one_line_and_cut(spark):
    long = "x" * 200
    row = spark.createDataFrame([("a|b\r\n\t c`d", long, "  ", None)], "a string, b string, c string, d string").select(*[snapshot.cell(F.col(c)).alias(c) for c in "abcd"]).first()
    assert tuple(row) == ("a\\|b cd", "x" * (snapshot.CELL - 1) + "…", "—", "—")


def test_near_places_over_the_date_line_and_without_coordinates(spark):
    sites = spark.createDataFrame([(1, 179.999, 10.0), (2, 170.0, 10.0), (3, None, 10.0)], "k int, x double, y double")
    places = spark.createDataFrame([(-179.999, 10.0), (-179.9989, 10.0), (None, None)], "x double, y double")
    got = signals.with_near(sites, "k", {"sale": places, "works": places.limit(0)}).orderBy("k").collect()
    assert [(r.k, r.sale, r.works) for r in got] == [(1, True, False), (2, False, False), (3, False, False)]


def test_recent_sale_bounds(spark):
    as_of = datetime.date(2001, 11, 4)
    rows = [(datetime.date(2000, 11, 4), 100, 1, True), (datetime.date(2000, 11, 3), 100, 1, False), (datetime.date(2001, 11, 5), 100, 1, False), (as_of, 99, 1, False), (as_of, 100, 0, False), (None, 100, 1, None)]
    frame = spark.createDataFrame(rows, "sold date, price int, acres int, want boolean")
    got = frame.select("want", signals.recent_sale(F.col("sold"), F.col("price"), F.col("acres"), F.lit(100), F.lit(as_of)).alias("got")).collect()
    assert [bool(r.got) for r in got] == [bool(r.want) for r in got]
