"""Queries over staged stores, exact selection and nearest places, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelake.operators import cycle, ingest, nearest, selection, store
from acrelake.plans import cycles
from acrelake.plans.catalogue import query, t
from acrelake.plans.cycles import _items
from acrelake.sources import exports, lines, scratch


def _store(spark: SparkSession, name: str) -> store.Store:
    return store.Store(spark, scratch.fresh_path(spark, name))


_NOTE = "'composite=' || coalesce(printf('%.2f', composite), 'none') || '; actionability=' || actionability"


@query(
    f"WITH s AS ({cycles._JUDGED}), f AS (SELECT parcel_id, count(*) AS n FROM ({cycles._GAPS} UNION ALL SELECT parcel_id, '' FROM s WHERE stale_days > 30 UNION ALL SELECT parcel_id, '' FROM s WHERE s6 IS NOT NULL "
    f"UNION ALL SELECT parcel_id, '' FROM s WHERE median_n < 3 AND coalesce(submarket, '') <> '') GROUP BY 1) SELECT s.parcel_id, composite, actionability, coalesce(n, 0) AS n_flags, {_NOTE} AS notes FROM s LEFT JOIN f USING (parcel_id)"
)
def published_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scoring cycle's scores, flags and log, committed together and read through the manifest; beside it lies a cycle that never ended."""
    rows, to = scratch.written(cycles._scored(spark, sf_dir), "scored"), _store(spark, "published")
    for name in ("score-1", "score-1"):  # the second is known already
        if one := to.cycle(name):
            one.append("scores", rows.select("parcel_id", "composite", "actionability"))
            one.append("flags", cycle.flags(rows, name))
            one.append("log", cycle.log_rows(rows, name, "market"))
            one.commit()
    lost = to.cycle("score-2")
    lost.append("scores", rows.select("parcel_id", "composite", "actionability"))
    flags = to.read("flags").groupBy("parcel_id").agg(F.count("*").alias("n_flags"))
    out = to.read("scores").join(flags, "parcel_id", "left").join(to.read("log").select("parcel_id", "notes"), "parcel_id", "left")
    return out.select("parcel_id", "composite", "actionability", F.coalesce("n_flags", F.lit(0)).alias("n_flags"), "notes")


#: Columns of a parcel, those never updated, and those that keep a first value.
PARCEL = (
    "parcel_id", "county", "state", "market", "submarket", "address", "owner_name", "owner_mailing_address", "owner_type_inferred",
    "acreage", "land_sf", "zoning", "zoning_description", "land_use_code", "land_use_description",
    "assessed_value_land", "assessed_value_improvement", "assessed_value_total", "fair_market_value", "tax_year", "tax_amount", "tax_status",
    "last_sale_date", "last_sale_price", "deed_book_page", "year_built", "improvement_sf", "geometry", "centroid",
    "discovery_source", "discovery_date", "last_updated", "raw_response_path",
)
FROZEN = ("county", "state", "market", "submarket")
KEPT_FIRST = ("discovery_source", "discovery_date")


def _made(name: str, run: str, number: str, text: str) -> str:
    """A parcel's value as one run delivers it: text, a number or none."""
    i = PARCEL.index(name)
    if name == "parcel_id":
        return "c_custkey AS parcel_id"
    value = f"c_custkey * {i} + {len(run)}" if i in (9, 10, 15, 16, 17, 18, 19, 20, 23, 25, 26) else f"concat('{name}-{run}-', CAST(c_custkey AS {text}))"
    value = f"CAST({value} AS {number})" if "concat" not in value else value
    return f"CASE WHEN (c_custkey + {i}) % {5 if run == 'a' else 7} <> 0 THEN {value} END AS {name}"


def _delivered(run: str, number: str = "DOUBLE", text: str = "STRING") -> list[str]:
    return [_made(n, run, number, text) for n in PARCEL]


_A, _B = (f"SELECT {', '.join(_delivered(r, text='VARCHAR'))} FROM customer WHERE {w}" for r, w in (("a", "c_custkey % 3 <> 1"), ("bb", "c_custkey % 40 = 5 OR c_custkey % 300 = 1")))


@query(f"""SELECT {", ".join(["coalesce(a.parcel_id, b.parcel_id) AS parcel_id"] + [(f"coalesce(a.{c}, b.{c})" if c in KEPT_FIRST else f"CASE WHEN a.parcel_id IS NOT NULL THEN a.{c} ELSE b.{c} END" if c in FROZEN else f"CASE WHEN b.parcel_id IS NOT NULL THEN b.{c} ELSE a.{c} END") + f" AS {c}" for c in PARCEL[1:]])}
  FROM ({_A}) a FULL JOIN ({_B}) b ON a.parcel_id = b.parcel_id""")
def upsert_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second delivery of 33 columns into a table of buckets, of which only those that it falls into are rewritten; each row comes
    twice, an older one with other values."""
    customer, to = t(spark, sf_dir, "customer"), _store(spark, "parcels")
    for run, where in (("a", "c_custkey % 3 <> 1"), ("bb", "c_custkey % 40 = 5 OR c_custkey % 300 = 1")):
        rows = customer.where(where).selectExpr(*_delivered(run), "1 AS turn")
        old = rows.select(*[F.lit("old").alias(c) if c == "address" else c for c in PARCEL], F.lit(0).alias("turn"))
        one = to.cycle(run)
        one.upsert("parcels", rows.unionByName(old), "parcel_id", [F.col("turn").desc()], list(KEPT_FIRST), list(FROZEN), buckets=16, columns=list(PARCEL))
        one.commit()
    return to.read("parcels").select(*PARCEL)


_HOT = "CASE WHEN l_orderkey % 10 = 0 THEN l_returnflag WHEN l_orderkey % 10 < 9 THEN 'hot' END"


@query(f"SELECT g, n, round(price, 6) AS price FROM (SELECT {_HOT} AS g, count(*) AS n, quantile_cont(l_extendedprice, 0.5) AS price FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1)")
def median_hot_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group has eight tenths of all rows; no task sorts more than a thousand values of it."""
    rows = t(spark, sf_dir, "lineitem").where("l_linenumber <> 3").select(F.expr(_HOT).alias("g"), F.col("l_extendedprice").alias("price"))
    return selection.medians(rows, ["g"], "price", bin_rows=1000).withColumn("price", F.round("price", 6))


@query("SELECT g, n, price FROM (SELECT l_suppkey % 3 AS g, count(*) AS n, round(quantile_cont(l_quantity, 0.9), 6) AS price FROM lineitem GROUP BY 1)")
def quantile_of_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty values, each in very many rows."""
    rows = t(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 3 AS g", "l_quantity AS price")
    return selection.quantiles(rows, ["g"], "price", 0.9, bin_rows=100).withColumn("price", F.round("price", 6))


def _csv_files(rows: DataFrame, header: str) -> str:
    """A folder with a file for each bucket of ``rows`` (bucket, at, value): its header, then its values in order."""
    spark = rows.sparkSession
    heads = rows.select("bucket").distinct().select("bucket", F.lit(-1).cast("long").alias("at"), F.lit(header).alias("value"))
    path = f"{scratch.fresh_path(spark, 'csv')}-{uuid.uuid4().hex}"
    rows.unionByName(heads).repartition(5, "bucket").sortWithinPartitions("bucket", "at").drop("at").write.partitionBy("bucket").text(path)
    return path


_DELIVERED = "o_orderkey % {n} = 0"
_PRICE = "CASE WHEN o_orderkey % 5 = {k} THEN '0' ELSE CAST(o_custkey + 1 + {k} AS {text}) END"


def _ingested(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Two deliveries of land sales in files, the second one twice; a table of the store after them."""
    to, spec = _store(spark, "ingested"), exports.LAND_SALES
    for cycle_id, n, k in (("in-1", 2, 0), ("in-2", 3, 1), ("in-2", 3, 1)):
        orders = t(spark, sf_dir, "orders").where(_DELIVERED.format(n=n))
        cells = {"address": "CAST(o_orderkey AS STRING)", "submarket": "concat('m', o_custkey % 7)", "acres": "'5'", "sale_date": "'2026-01-02'", "sale_price": _PRICE.format(k=k, text="STRING")}
        value = "concat_ws(',', " + ", ".join(cells.get(c, "''") for c in spec.columns) + ") AS value"
        rows = orders.selectExpr("o_custkey % 3 AS bucket", "o_orderkey AS at", value)
        ingest.ingest(to, cycle_id, spec, _csv_files(rows, ",".join(spec.columns)), buckets=8)
    return to.read(name)


_SOLD = "SELECT o_orderkey AS address, o_custkey + 1 + {k} AS sale_price FROM orders WHERE o_orderkey % {n} = 0 AND o_orderkey % 5 <> {k}"


@query(f"SELECT coalesce(b.address, a.address) AS address, coalesce(b.sale_price, a.sale_price) AS sale_price FROM ({_SOLD.format(n=2, k=0)}) a FULL JOIN ({_SOLD.format(n=3, k=1)}) b ON a.address = b.address")
def ingested_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir, "land_sales_comps").select(F.col("address").cast("long").alias("address"), "sale_price")


@query(" UNION ALL ".join(f"SELECT 'in-{c}' AS cycle_id, count(*) FILTER (o_orderkey % 5 <> {k}) AS loaded, count(*) FILTER (o_orderkey % 5 = {k}) AS failed FROM orders WHERE o_orderkey % {n} = 0 GROUP BY o_custkey % 3" for c, n, k in ((1, 2, 0), (2, 3, 1))))
def ingestion_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each file; the delivery that came twice was loaded once."""
    number = lambda what: F.regexp_extract("notes", rf"{what}=(\d+)", 1).cast("long")
    return _ingested(spark, sf_dir, "log").select("cycle_id", number("rows_loaded").alias("loaded"), number("rows_failed").alias("failed"))


_FROM = "c_custkey, ((c_custkey * 7919) % 36000) / 100.0{d} - 180.0{d} AS x, ((c_custkey * 104729) % 17900) / 100.0{d} - 89.5{d} AS y"
_TO = "s_suppkey, ((s_suppkey * 3571) % 36000) / 100.0{d} - 180.0{d} AS x, CASE WHEN s_suppkey % 4 = 0 THEN 84.0{d} ELSE ((s_suppkey * 13) % 16000) / 100.0{d} - 80.0{d} END AS y"
_MILES = "2 * 3958.7613 * asin(sqrt(least(1.0, pow(sin((radians(b.y) - radians(a.y)) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin((radians(b.x) - radians(a.x)) / 2), 2))))"


@query(f"SELECT c_custkey, round(min({_MILES}), 6) AS miles FROM (SELECT {_FROM.format(d='::DOUBLE')} FROM customer) a, (SELECT {_TO.format(d='::DOUBLE')} FROM supplier) b GROUP BY 1")
def nearest_miles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All over the globe: near the poles, across the date line, and half a continent away."""
    a, b = t(spark, sf_dir, "customer").selectExpr(*_items(_FROM.format(d="D"))), t(spark, sf_dir, "supplier").selectExpr(*_items(_TO.format(d="D")))
    return nearest.nearest(a, b, "c_custkey", "s_suppkey").select("c_custkey", F.round("miles", 6).alias("miles"))


@query("""SELECT bucket, o_orderkey, (1 + sum(lines) OVER (PARTITION BY bucket ORDER BY o_orderkey) - lines + 1)::BIGINT AS line, note
  FROM (SELECT o_custkey % 5 AS bucket, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 + o_orderkey % 4 ELSE 1 END AS lines,
    CASE WHEN o_orderkey % 3 = 0 THEN 'note, "' || o_orderkey || '"' || repeat(chr(10) || 'x', (o_orderkey % 4)::INT) ELSE 'plain' END AS note FROM orders)""")
def numbered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as CSV files with quoted line ends, read back by splits: each record with the line that it begins on."""
    note = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN concat('note, \"', o_orderkey, '\"', repeat('\nx', CAST(o_orderkey % 4 AS INT))) ELSE 'plain' END")
    orders = t(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("bucket"), "o_orderkey", note.alias("note"))
    quoted = F.concat(F.lit('"'), F.replace("note", F.lit('"'), F.lit('""')), F.lit('"'))
    rows = orders.select("bucket", F.col("o_orderkey").alias("at"), F.concat_ws(",", F.col("o_orderkey").cast("string"), quoted).alias("value"))
    body, heads = lines.read_rows(spark, _csv_files(rows, "key,note"))
    named = body.join(heads, "file").select("file", "line", F.map_from_arrays("header", F.slice("cells", 1, 2)).alias("m"))
    return named.select(F.regexp_extract("file", r"bucket=(\d+)", 1).cast("long").alias("bucket"), F.col("m.key").cast("long").alias("o_orderkey"), "line", F.col("m.note").alias("note"))
