import csv
import datetime
import io

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from acrelake.functions import geometry, scoring, text
from acrelake.operators import history, spatial
from acrelake.sources import exports, ledger, lines, polygons
from acrelake.streaming import pickup

HEADER = ",".join(exports.SUBMARKET_STATS.columns)
GOOD = 'Airport / South,Atlanta,"28,500,000",5.4%,6.1%,-1000,0,,$7.85,04/27/2026'


def test_header_errors():
    spec = exports.SUBMARKET_STATS
    assert exports.header_errors(["﻿Submarket_Name ", *spec.columns[1:]], spec) == []
    assert exports.header_errors(spec.columns[:-1], spec) == ["missing column report_date"]
    assert exports.header_errors([*spec.columns, "market"], spec) == ["duplicate column market"]
    assert exports.header_errors([], spec) == ["empty header"]


def test_read_export(spark, tmp_path):
    rows = [GOOD, GOOD.replace("5.4%", "150"), GOOD.replace("04/27/2026", "soon"), GOOD.replace("Atlanta", " ")]
    (tmp_path / "a.csv").write_text("﻿" + HEADER + "\n" + "\n".join(rows) + "\n")
    rows, failed = exports.read_export(spark, str(tmp_path / "a.csv"), exports.SUBMARKET_STATS)
    got = sorted(rows.collect(), key=lambda r: r.line)
    assert failed.count() == 0 and [r.line for r in got] == [2, 3, 4, 5]
    assert [r.error for r in got] == [None, "vacancy_rate_pct: out of range", "report_date: not a date", "market: required"]
    assert (got[0].total_inventory_sf, got[0].asking_rent_nnn_psf, got[0].report_date, got[0].proposed_sf) == (28_500_000, 7.85, datetime.date(2026, 4, 27), None)
    (tmp_path / "b.csv").write_text(HEADER.replace("market,", "", 1) + "\nx\n")
    rows, failed = exports.read_export(spark, str(tmp_path / "b.csv"), exports.SUBMARKET_STATS)
    assert rows.count() == 0 and [r.error for r in failed.collect()] == ["missing column market"]


def test_pickup_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "submarket_stats_20260427.csv").write_text(HEADER + "\n" + GOOD + "\n" + GOOD.replace("Atlanta", "") + "\n")
    (tmp_path / "in" / "other.csv").write_text("x\n1\n")
    swapped = HEADER.replace("submarket_name,market", "market,submarket_name")
    (tmp_path / "in" / "submarket_stats_20260428.csv").write_text(swapped + "\n" + GOOD.replace("Airport / South,Atlanta", "Macon,North") + "\n")
    (tmp_path / "in" / "submarket_stats_20260429.csv").write_text("market,x\n1,2\n")
    spec = exports.SUBMARKET_STATS
    out = [str(tmp_path / x) for x in ("good", "bad", "failed", "cp")]
    pickup.land(pickup.exports(spark, str(tmp_path / "in"), spec), spec, *out).awaitTermination(120)
    assert {(r.market, r.submarket_name) for r in spark.read.parquet(out[0]).collect()} == {("Atlanta", "Airport / South"), ("Macon", "North")}
    assert spark.read.parquet(out[1]).count() == 1
    assert [r.path.rsplit("/", 1)[1] for r in spark.read.parquet(out[2]).collect()] == ["submarket_stats_20260429.csv"]


def test_null_order_and_ties(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("b", 5, 1), ("b", 5, 2)], "k string, ts int, id int")
    order = [F.col("ts").desc_nulls_first(), F.col("id").desc()]
    assert {(r.k, r.id) for r in history.latest(df, ["k"], order).collect()} == {("a", 1), ("b", 2)}
    assert {(r.k, r.id) for r in history.latest_with_ties(df, ["k"], "ts").collect()} == {("a", 2), ("b", 1), ("b", 2)}


def test_scores_at_their_cuts(spark):
    df = spark.createDataFrame([(10.0, 2e6, 0.85, 1.0, 3.0), (None, None, 0.92, 1.0, 2.0)], "v double, a double, area double, box double, asp double")
    rows = df.select(scoring.vacancy(F.col("v")), scoring.absorption(F.col("a")), scoring.pipeline_supply(F.col("a")), scoring.site_shape(F.col("area"), F.col("box"), F.col("asp"))).collect()
    assert [tuple(r) for r in rows] == [(3, 7, 0, 7), (None, None, 10, 10)]


def test_rings(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)],), ([(0.0, 0.0)],)], "ring array<struct<x:double,y:double>>")
    rows = df.select(geometry.signed_area(F.col("ring")), geometry.contains(F.col("ring"), F.lit(1.0), F.lit(1.0)), geometry.box(F.col("ring"))["x1"]).collect()
    assert [tuple(r) for r in rows] == [(-16.0, True, 4.0), (0.0, False, 0.0)]


def test_owner_words(spark):
    df = spark.createDataFrame([("TRUMP LTD",), ("Jane TR ",), ("Trump",), (None,)], "n string")
    assert [r[0] for r in df.select(text.owner_type(F.col("n"))).collect()] == ["llc", "trust", "individual", "unknown"]


def test_other_exports(spark, tmp_path):
    spec = exports.LEASING
    head = [c for c in spec.columns if c != "naics_code"]
    row = {c: "x" for c in head} | {"lease_start_date": "2026-01-02", "lease_term_months": "60", "building_sf_leased": "1,000.5", "starting_rent_psf_nnn": "$9", "rent_escalation_pct": ""}
    late = row | {"lease_term_months": "0"}
    (tmp_path / "a.csv").write_text("\n".join([",".join(head)] + [",".join(f'"{r[c]}"' for c in head) for r in (row, late)]) + "\n")
    got = sorted(exports.read_export(spark, str(tmp_path / "a.csv"), spec)[0].collect(), key=lambda r: r.line)
    assert [(r.error, r.lease_term_months, r.naics_code) for r in got] == [(None, 60, None), ("lease_term_months: out of range", 0, None)]
    assert got[0].building_sf_leased == 1000.5
    for s in exports.SPECS.values():
        assert sorted(s.columns) == sorted(f.name for f in s.fields)
        assert exports.header_errors(s.needed, s) == []


def test_polygons(spark, tmp_path):
    square = [[[0, 0], [4, 0], [4, 4], [0, 4]], [[1, 1], [2, 1], [2, 2]]]
    features = [{"type": "Feature", "geometry": {"type": k, "coordinates": c}, "properties": {"id": "z"}} for k, c in (("Polygon", square), ("Point", [1, 2]), ("Polygon", []))]
    import json

    (tmp_path / "z.json").write_text(json.dumps({"type": "FeatureCollection", "features": features + [{"type": "Feature", "geometry": None}]}, indent=1))
    zones = polygons.read_polygons(spark, str(tmp_path / "z.json"))
    assert [(len(r.ring), r.box.x1, r.properties["id"]) for r in zones.collect()] == [(4, 4.0, "z")]
    points = spark.createDataFrame([(1, 1.5, 1.2), (2, 5.0, 1.0), (3, None, 1.0)], "id int, x double, y double")
    assert [r.id for r in spatial.inside(points, zones.union(zones)).collect()] == [1]


def test_ledger(spark, tmp_path):
    rows = spark.createDataFrame([("abcdef0", 3, 0.5, None, 1.25, "keep", " a\tb\n" + "c" * 300)], "commit string, metric long, confidence double, api_calls long, wall_clock_min double, status string, description string")
    where = str(tmp_path / "log")
    ledger.append(rows, where)
    (tmp_path / "log" / "more.csv").write_text("pending\t1\t0.10\n" + "pending\t1\t0.10\t0\t0.0\tbaseline\t\n" + "a\tb\tc\td\te\tf\tg\th\n")
    got = sorted(ledger.read_ledger(spark, where).collect())
    assert [(r.commit, r.metric, r.confidence, r.api_calls, r.status) for r in got] == [("abcdef0", "3", "0.50", "0", "keep"), ("pending", "1", "0.10", "0", "baseline")]
    assert got[0].description.startswith("a b ccc") and got[0].description.endswith("c…") and len(got[0].description) == 200
    with pytest.raises(ValueError, match="status"):
        ledger.append(rows.withColumn("status", F.lit("done")), where)


@pytest.fixture
def splits(spark):
    """Sets the size of splits, and back."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}
    yield lambda size: [spark.conf.set(n, v) for n, v in zip(names, (size, "0"))]
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", ["37", "200", "128m"])
def test_records_know_their_line(spark, tmp_path, splits, size):
    """Any size of splits gives what one reader of the whole file gives, quoted line ends included."""
    rows = [["k", "v"], ["1", "plain"], ["2", 'two\nlines, "said"'], ["3", ""], ["4", "\n\n"], ["5", "x" * 90 + '"\n"' + "y" * 90], ["", ""], ["7", "é😀"], ["8", "a\r\nb"]]
    for name, end in (("a.csv", "\n"), ("b.csv", "\r\n")):
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator=end).writerows(rows)
        (tmp_path / name).write_bytes(out.getvalue().removesuffix(end).encode())
    splits(size)
    want = []
    with open(tmp_path / "a.csv", newline="") as f:
        reader, at = csv.reader(f), 1
        for row in reader:
            want.append((at, row))
            at = reader.line_num + 1
    body, heads = lines.read_rows(spark, str(tmp_path))
    got = sorted((r.file[-5:], r.line, [c or "" for c in r.cells]) for r in body.collect())
    lined = [(at, row) for at, row in want[1:] if any(c.strip() for c in row)]
    assert [(n, r) for f, n, r in got if f == "a.csv"] == lined
    assert [[c.replace("\r\n", "\n") for c in r] for f, _, r in got if f == "b.csv"] == [[c.replace("\r\n", "\n") for c in r] for _, r in lined]
    assert sorted(r.header for r in heads.collect()) == [["k", "v"], ["k", "v"]]


def test_listings_of_two_snapshots_both_stay(spark, tmp_path):
    spec = exports.LAND_LISTINGS
    row = {c: "x" for c in spec.columns} | {"listing_date": "2026-01-02", "acres": "5", "asking_price": "100", "asking_price_per_acre": "20", "days_on_market": "3", "address": "1 Main St"}

    def week(day, **other):
        (tmp_path / f"land_listings_{day}.csv").write_text(",".join(spec.columns) + "\n" + ",".join((row | other)[c] for c in spec.columns) + "\n")
        return exports.read_export(spark, str(tmp_path / f"land_listings_{day}.csv"), spec)[0].drop("file", "line")

    held = exports.split(week("20260105"))[0]
    held = exports.load(held, week("20260112", asking_price="90"), spec)
    held = exports.load(held, week("20260112", asking_price="80"), spec)  # the same week again
    assert sorted((r.snapshot_date.isoformat(), r.asking_price) for r in held.collect()) == [("2026-01-05", 100), ("2026-01-12", 80)]


def test_sales_of_land_and_buildings_share_a_table(spark):
    sale = dict(address="1 Main St", submarket="m", sale_date="2026-01-02", sale_price="100")
    rows = lambda spec, **more: exports.validated(spark.createDataFrame([{c: (sale | more).get(c) for c in spec.columns}], ", ".join(f"{c} string" for c in spec.columns)), spec, datetime.date(2026, 1, 1))
    land, building = rows(exports.LAND_SALES, acres="5"), rows(exports.BUILDING_SALES, building_sf="9")
    shared = ["comp_type", "submarket", "address", "sale_date", "sale_price", "error"]
    held = exports.split(building.select(shared))[0]
    held = exports.load(held, land.select(shared), exports.LAND_SALES)
    held = exports.load(held, rows(exports.LAND_SALES, acres="5", sale_price="70").select(shared), exports.LAND_SALES)
    assert sorted((r.comp_type, r.sale_price) for r in held.collect()) == [("building", 100), ("land", 70)]
    with pytest.raises(ValueError, match="as_of"):
        exports.validated(spark.createDataFrame([], ", ".join(f"{c} string" for c in exports.BUILDING_SALES.columns)), exports.BUILDING_SALES)


@pytest.mark.parametrize("advisory", ["1m", "64m"])
def test_numbers_are_dense_after_files(spark, tmp_path, advisory):
    """Rows wide enough that the exchanges for counts and for rows would be cut differently."""
    before = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
    try:
        new = spark.range(200_000).select((F.col("id") % 1009).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("wide"))
        old = spark.createDataFrame([(7, None, "x")], "id long, k long, wide string")
        history.append_numbered(old, new, "id", ["k", "wide"]).write.parquet(str(tmp_path / "out"))
        got = spark.read.parquet(str(tmp_path / "out"))
        assert got.agg(F.count("*"), F.countDistinct("id"), F.min("id"), F.max("id")).first() == (200_001, 200_001, 7, 200_007)
        moved = got.where("id > 7").withColumn("n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("k", "wide"))).where("n + 7 <> id")
        assert moved.count() == 0
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_addresses(spark):
    from acrelake.functions import address

    mail = {"PO Box 12, Macon, GA 31201": True, "P.O. BOX 7 ATLANTA GA, 30303-1234": True, "12 Main St, Atlanta, GA 30303": True, "c/o Bank, 9 Elm Rd Dalton ga 30720": True,
            "Main St, Atlanta, GA 30303": False, "12 Main St, Atlanta, ZZ 30303": False, "12 Main St, Atlanta, GA": False, "": False, None: False, "Box 9 Macon GA 31201": True, "GA 30303-1234": False}
    site = {"12 Main": True, "0 CAMPBELLTON FAIRBURN RD": True, "Old Mill road": True, "O'Neal Ridge": True, "Rd": False, "Main": False, "12": False, "": False, None: False, "12A Main": False}
    for cases, f in ((mail, address.mailing_parses), (site, address.site_parses)):
        rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "a string, want boolean")
        assert rows.where(~f(F.col("a")).eqNullSafe(F.col("want"))).collect() == []


def test_records_are_parsed_once(spark, tmp_path):
    """One parser in the plan for each record, however many cells it has; with and without quotes the cells are the same."""
    rows = ["a,b,c", "1,,x y", ' 2 ,"q, ""z""",', "3", ",,", '"4","",5,6', "7,8,9,10", "", '"l\nm",n,\r']
    (tmp_path / "f.csv").write_text("\n".join(rows) + "\n")
    body, heads = lines.read_rows(spark, str(tmp_path))
    assert body._jdf.queryExecution().optimizedPlan().prettyJson().count("CsvToStructs") <= 2  # in records that end in their line, and in others
    got = {r.line: r.cells for r in body.collect()}
    assert got == {2: ["1", None, "x y"], 3: [" 2 ", 'q, "z"', None], 4: ["3", None, None], 6: ["4", got[6][1], "5"], 7: ["7", "8", "9"], 9: ["l\nm", "n", None]}
    assert not got[6][1] and heads.first().header == ["a", "b", "c"]


def test_fields_of_exports_are_read_once(spark):
    """Values, errors and bounds look at one reading: a date's four formats are tried once."""
    raw = spark.createDataFrame([tuple("x" for _ in exports.LAND_SALES.columns)], ", ".join(f"{c} string" for c in exports.LAND_SALES.columns))
    plan = exports.validated(raw, exports.LAND_SALES)._jdf.queryExecution().analyzed().prettyJson()
    assert plan.count("yyyy/M/d") <= 2  # a function and what stands for it
