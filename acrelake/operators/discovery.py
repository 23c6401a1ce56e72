"""Features of a service to parcel rows, flags of filters that only flag, and quality checks of a source."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelake.functions import geometry, text

SQFT_PER_ACRE = 43560.0


def parcels(features: DataFrame, names: dict[str, str], prefix: str, market: str, source: str, day: Column, orientation: str = "reference") -> DataFrame:
    """Rows (parcel columns, ring, skip_reason) of features (area, attributes map, rings): ``names`` maps our fields to the service's.
    A feature without key or geometry, or whose centre isn't in degrees, has a reason and is to be left out."""
    of = lambda field: F.col("attributes")[names[field]] if field in names else F.lit(None).cast("string")
    key = text.text_or_null(of("parcel_id"))
    rows = features.select("*", F.when(F.size("rings") > 0, geometry.largest_outer(F.col("rings"), orientation)).alias("outer"))
    rows = rows.withColumn("ring", F.col("outer.ring")).withColumn("center", geometry.vertex_centroid(F.col("ring")))
    reason = F.when(key.isNull(), "no key").when(F.coalesce(F.size("ring"), F.lit(0)) < 3, "no polygon").when(~geometry.in_degrees(F.col("center.x"), F.col("center.y")), "centre not in degrees")
    acres, owner = text.lenient_double(of("acreage")), text.text_or_null(of("owner_name"))
    return rows.select(
        F.concat(F.lit(prefix), key).alias("parcel_id"), F.lit(market).alias("market"), F.col("area").alias("submarket"), text.text_or_null(of("address")).alias("address"),
        owner.alias("owner_name"), F.nullif(text.mailing(of("mailing_1"), of("mailing_2")), F.lit("")).alias("owner_mailing_address"), text.owner_type(owner).alias("owner_type_inferred"),
        acres.alias("acreage"), (acres * SQFT_PER_ACRE).alias("land_sf"), text.text_or_null(of("zoning")).alias("zoning"), text.text_or_null(of("land_use")).alias("land_use_code"),
        *[text.lenient_long(of(c)).alias(f"assessed_value_{c}") for c in ("land", "improvement", "total")], text.lenient_long(of("tax_year")).alias("tax_year"),
        F.concat(F.lit(f"{source}:"), "area").alias("discovery_source"), day.alias("discovery_date"), "center", "ring", F.coalesce("outer.reduced", F.lit(False)).alias("multipolygon"), reason.alias("skip_reason"),
    )


#: Filters whose data is missing, which flag every accepted parcel.
FLAG_ONLY = ("H3", "H4", "H5", "H6", "H7", "H8", "H9", "H10")


def flag_only(accepted: DataFrame, key: str, reason: str = "data not joined") -> DataFrame:
    """Rows (key, filter, reason): one of each filter for each accepted parcel."""
    return accepted.select(key, F.explode(F.array(*[F.lit(h) for h in FLAG_ONLY])).alias("filter")).withColumn("reason", F.concat("filter", F.lit(f": {reason}")))


def mapping_check(mapping: DataFrame, layer: DataFrame) -> DataFrame:
    """Rows (logical, configured, outcome, actual) of mapped fields (logical, configured) against a layer's names (name): ok, case (another
    spelling, a hint) or missing (a failure). Unmapped fields are left out."""
    exact, spelt = layer.select(F.col("name").alias("configured"), F.lit(True).alias("_exact")).distinct(), layer.groupBy(F.lower("name").alias("_low")).agg(F.max("name").alias("actual"))
    rows = mapping.where(F.coalesce("configured", F.lit("")) != "").join(exact, "configured", "left").withColumn("_low", F.lower("configured")).join(spelt, "_low", "left")
    outcome = F.when(F.col("_exact"), "ok").when(F.col("actual").isNotNull(), "case").otherwise("missing")
    return rows.select("logical", "configured", outcome.alias("outcome"), F.when(F.col("_exact").isNull(), F.col("actual")).alias("actual"))


#: Words that stand for a name withheld.
REDACTION_TOKENS = ("REDACTED", "CONFIDENTIAL", "WITHHELD", "UNDISCLOSED")


def owner_redaction(owner: Column, tokens: tuple[str, ...] = REDACTION_TOKENS) -> list[Column]:
    """Aggregates sample_size, redacted_count, too_short_count and failing over owner names; a name counts by its letters alone."""
    bare = text.strip(owner)
    given, short = F.coalesce(owner, F.lit("")) != "", F.char_length(bare) <= 3
    hidden = given & ~short & F.regexp_replace(F.upper(bare), "[^A-Z]", "").rlike("|".join(tokens))
    return [F.count("*").alias("sample_size"), F.count_if(hidden).alias("redacted_count"), F.count_if(given & short).alias("too_short_count"), (F.count_if(hidden) > 0).alias("failing")]


def population(df: DataFrame, fields: list[str], nulls: tuple[str, ...] = ("", "Null", "<Null>", "None")) -> DataFrame:
    """Rows (field, rate): the share of rows that give each field, three decimals."""
    gone = F.col("value").isNull() | F.col("value").isin(*nulls)
    return df.unpivot([], fields, "field", "value").groupBy("field").agg(F.round(F.avg(F.when(gone, 0.0).otherwise(1.0)), 3).alias("rate"))


def placed(x: Column, y: Column, box: tuple[float, float, float, float], empty: Column, slack: float = 0.5) -> Column:
    """empty, out_of_range (not degrees), ok, or out_of_box beyond ``slack`` around the box."""
    x0, y0, x1, y1 = box
    return F.when(empty | x.isNull() | y.isNull(), "empty").when(~geometry.in_degrees(x, y), "out_of_range").when(geometry.envelope(x, y, x0 - slack, y0 - slack, x1 + slack, y1 + slack), "ok").otherwise("out_of_box")


def masked(df: DataFrame, fields: list[str], pattern: str = r"(?i)owner|mail|phone|email|ssn") -> DataFrame:
    """Mapped personal fields, and any whose name looks like one, masked; nulls stay."""
    hide = [c for c in df.columns if c in fields] + [c for c in df.columns if c not in fields and re.search(pattern, c)]
    return df.select(*[F.when(F.col(c).isNotNull(), "***").alias(c) if c in hide else F.col(c) for c in df.columns])


def totals(df: DataFrame, by: str, outcome: str, outcomes: list[str]) -> DataFrame:
    """Rows (by, a count for each of ``outcomes``), and one named total over all."""
    counts = [F.count_if(F.col(outcome) == o).alias(o) for o in outcomes]
    rolled = df.rollup(by).agg(F.grouping(by).alias("_all"), *counts)
    return rolled.select(F.when(F.col("_all") == 1, "total").otherwise(F.col(by)).alias(by), *outcomes)


def merged_registry(sources: DataFrame, overlay: DataFrame, key: str, defaults: dict[str, str]) -> DataFrame:
    """``sources`` with the columns of ``overlay`` by key, ``defaults`` where it says nothing. Keys that begin with an underscore are notes;
    an overlay key without a source is an error, since a misspelt one would drop out silently."""
    real = lambda df: df.where(~F.startswith(F.col(key), F.lit("_")))
    orphans = [r[0] for r in real(overlay).join(sources, key, "left_anti").select(key).orderBy(key).limit(20).collect()]
    if orphans:
        raise ValueError(f"overlay keys without a source: {', '.join(orphans)}")
    filled = real(sources).join(overlay, key, "left")
    return filled.select(*sources.columns, *[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in overlay.columns if c != key])


def fresh_exports(spark: SparkSession, folder: str, now: datetime.datetime, days: int = 30) -> DataFrame:
    """Rows (path, modified) of CSV files changed in the last ``days`` days, in the folders just below ``folder``: archived ones lie deeper.
    File names and times are listed, contents are not read. An empty or missing place gives no rows."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = hadoop(f"{folder.rstrip('/')}/*/*.csv")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at):
        return spark.createDataFrame([], "path string, modified timestamp")
    files = spark.read.format("binaryFile").schema(schema).load(f"{folder.rstrip('/')}/*/*.csv")
    return files.where(F.col("modificationTime") >= F.lit(now - datetime.timedelta(days=days))).select("path", F.col("modificationTime").alias("modified"))
