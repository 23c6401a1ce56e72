import http.server
import json
import threading
import urllib.error
import urllib.parse

import pytest
from pyspark.sql import functions as F

from acrelake.sources import features, markdown, reports

SERVED = {"a": 5, "b": 4, "c": 0}
SEEN = []


class Service(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
        SEEN.append(q)
        if self.path.startswith("/busy") and len(SEEN) < 2:
            self.send_response(503)
            self.send_header("Retry-After", "0")
            return self.end_headers()
        if self.path.startswith("/gone"):
            self.send_response(404)
            return self.end_headers()
        n, at, size = SERVED["abc"[int(float(q["geometry"].split(",")[0]))]], int(q["resultOffset"]), int(q["resultRecordCount"])
        rows = [{"attributes": {"ID": i, "OWNER": None}, "geometry": {"x": 1.5}} for i in range(at, min(n, at + size))]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"features": rows} | ({"exceededTransferLimit": at + size < n} if n == 4 else {})).encode())

    def log_message(self, *a):
        pass


@pytest.fixture()
def url():
    SEEN.clear()
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages(spark, url):
    spark.dataSource.register(features.FeatureService)
    areas = json.dumps({k: [i, 0, i + 1, 1] for i, k in enumerate("abc")})
    df = spark.read.format("feature_service").options(url=f"{url}/q", areas=areas, page="2", where="ACRES BETWEEN 1 AND 9").load()
    got = sorted((r.area, r.attributes["ID"], r.attributes["OWNER"], r.geometry) for r in df.collect())
    assert got == [(k, str(i), None, '{"x": 1.5}') for k in "ab" for i in range(SERVED[k])]
    assert len(SEEN) == 3 + 2 + 1 and {q["where"] for q in SEEN} == {"ACRES BETWEEN 1 AND 9"}


def test_retries(url):
    q = "geometry=2,0,3,1&resultOffset=0&resultRecordCount=2"
    assert features.fetch(f"{url}/busy?{q}") == {"features": []} and len(SEEN) == 2
    with pytest.raises(urllib.error.HTTPError):
        features.fetch(f"{url}/gone?{q}")
    assert len(SEEN) == 3


def test_last_page_and_drift():
    assert features.last({"exceededTransferLimit": True}, 1, 2) is False
    assert features.last({"exceededTransferLimit": True}, 0, 2) and features.last({"exceededTransferLimit": False}, 2, 2)
    assert features.last({}, 1, 2) and not features.last({}, 2, 2)
    assert features.drift({"a", "b"}, {"b"}) == {"a"}


def test_markdown(spark, tmp_path):
    df = spark.createDataFrame([("x|y", 1234567.0), ("p\nq", None)], "name string, price double").orderBy(F.desc("price"))
    text = markdown.report("Memo", {"Top": markdown.table(df.select("name", markdown.money(F.col("price")).alias("price")), 5)})
    assert text == "# Memo\n\n## Top\n\n| name | price |\n|-|-|\n| x\\|y | $1,234,567 |\n| p q | n/a |\n"
    for t in ("old", text):
        markdown.write(t, str(tmp_path / "memo.md"))
    assert (tmp_path / "memo.md").read_text() == text and len(list(tmp_path.iterdir())) == 1


class Parcels(http.server.BaseHTTPRequestHandler):
    """A service with object ids from 1 that evaluates what its clients send."""

    rows = {"a": [], "b": []}

    def do_GET(self):
        q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
        SEEN.append(q)
        own = Parcels.rows["ab"[int(float(q["geometry"].split(",")[0]))]]
        if "outStatistics" in q:
            found = [{"top": max((r["OBJECTID"] for r in own), default=None)}]
        else:
            test = q["where"].replace("''", "\\'").replace("1=1", "True").replace(" AND ", " and ").replace("IS NOT NULL", "is not None").replace(" IN ", " in ").replace("=", "==").replace(">==", ">=").replace("<==", "<=")
            found = sorted((r for r in own if eval(test, {}, dict(r))), key=lambda r: r["OBJECTID"])  # noqa: S307
            at, size = int(q["resultOffset"]), int(q["resultRecordCount"])
            found = found[at : at + size]
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"features": [{"attributes": r} for r in found]}).encode())

    def log_message(self, *a):
        pass


@pytest.fixture()
def parcels():
    SEEN.clear()
    Parcels.rows = {k: [{"OBJECTID": i, "ACRES": i * 1.5, "OWNER": "O'Neal" if i % 2 else "x"} for i in range(1, 6)] for k in "ab"}
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Parcels)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/q"
    server.shutdown()


TYPED = "area string, OBJECTID long, ACRES double, OWNER string"
AREAS = json.dumps({"a": [0, 0, 1, 1], "b": [1, 0, 2, 1]})


def test_filters_go_to_the_service(spark, parcels):
    spark.dataSource.register(features.FeatureService)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = lambda **o: spark.read.format("feature_service").schema(TYPED).options(url=parcels, areas=AREAS, page="2", **o).load()
        test = "area = 'a' AND ACRES >= 3 AND ACRES < 7 AND OWNER IN ('O''Neal', 'y') AND length(OWNER) > 2"
        got = sorted(tuple(r) for r in read(pushdown="true").where(test).collect())
        sent = [q for q in SEEN]
        SEEN.clear()
        want = sorted(tuple(r) for r in read().where(test).collect())
        assert got == want == [("a", 3, 4.5, "O'Neal")]
        assert {q["geometry"][0] for q in sent} == {"0"} and all("ACRES >= 3.0" in q["where"] and "ACRES < 7.0" in q["where"] and "OWNER IN ('O''Neal', 'y')" in q["where"] for q in sent)
        assert len(sent) == 1 and {q["where"] for q in SEEN} == {"1=1"} and len(SEEN) == 6
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_requests_keep_their_interval(parcels):
    import time

    began = time.monotonic()
    schema = type("S", (), {"fields": []})()
    reader = features.FeatureReader({"url": parcels, "areas": AREAS, "page": "2", "tasks": "1", "interval": "0.1"}, schema)
    (one,) = reader.partitions()
    assert len(list(reader.read(one))) == 10 and len(SEEN) == 6
    assert time.monotonic() - began >= 0.5


def test_stream_fetches_no_page_twice(spark, parcels, tmp_path):
    spark.dataSource.register(features.FeatureService)
    out = str(tmp_path / "out")

    def run(write):
        df = spark.readStream.format("feature_service").schema(TYPED).options(url=parcels, areas=AREAS, page="2", cache=str(tmp_path / "pages")).load()
        write(df.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)).start().awaitTermination(120)

    def broken(batch, number):
        batch.collect()
        raise RuntimeError("lost")

    pages = lambda: [q for q in SEEN if "outStatistics" not in q]
    land = lambda w: w.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    with pytest.raises(Exception, match="lost"):
        run(lambda w: w.foreachBatch(broken))
    first = len(pages())
    assert first >= 6
    run(land)
    assert len(pages()) == first  # the batch came again from the pages that were kept
    assert sorted((r.area, r.OBJECTID) for r in spark.read.parquet(out).collect()) == [(k, i) for k in "ab" for i in range(1, 6)]
    Parcels.rows["b"] += [{"OBJECTID": 9, "ACRES": 1.0, "OWNER": None}]
    run(land)
    assert sorted(r.OBJECTID for r in spark.read.parquet(out).where("batch > 0").collect()) == [9]
    assert len({json.dumps(q, sort_keys=True) for q in pages()}) == len(pages())


def test_reports_come_whole_or_not_at_all(spark, tmp_path):
    spark.dataSource.register(reports.ReportFiles)
    to = tmp_path / "memos"
    rows = spark.range(1000).select(F.format_string("p%04d.md", "id").alias("name"), F.concat(F.lit("# é "), F.col("id").cast("string")).alias("body")).repartition(8)
    save = lambda df: df.write.format("report_files").mode("overwrite").save(str(to))
    save(rows)
    assert len(list(to.iterdir())) == 1000 and (to / "p0042.md").read_text() == "# é 42"
    with pytest.raises(Exception, match="."):
        save(rows.withColumn("body", F.when(F.col("name") == "p0900.md", F.raise_error(F.lit("lost"))).otherwise("new")))
    with pytest.raises(Exception, match="one name"):
        save(rows.union(rows.limit(1)))
    assert [p.name for p in tmp_path.iterdir()] == ["memos"] and len(list(to.iterdir())) == 1000 and (to / "p0042.md").read_text() == "# é 42"
    save(rows.limit(3))
    assert len(list(to.iterdir())) == 3 and [p.name for p in tmp_path.iterdir()] == ["memos"]
