"""CSV exports: raw header checks, all-string scans, typed projection with the first error of each row.

Fixed values: the names of exports and of their columns, and the keys by which rows replace each other, are those of the files' contract."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelake.functions import text
from acrelake.operators import history
from acrelake.sources import lines


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "string"
    required: bool = False
    least: float | None = None
    above: float | None = None
    most: float | None = None
    #: At most so many years after the day of the run.
    years_ahead: int | None = None
    #: The header may lack it; such files give nulls.
    optional: bool = False


@dataclass(frozen=True)
class ExportSpec:
    name: str
    pattern: str
    #: In the order in which they are checked.
    fields: tuple[Field, ...]
    #: Their order in files without a header to go by; that of the checks if empty.
    layout: tuple[str, ...] = ()
    #: Parse errors of all fields are told together, before any range.
    gather: bool = False
    #: Rows with these columns alike replace those loaded before.
    keys: tuple[str, ...] = ()
    #: Columns that the files don't have: the same text in every row, and the day in the file's name.
    constants: tuple[tuple[str, str], ...] = ()
    dated: str | None = None

    @property
    def columns(self) -> list[str]:
        return list(self.layout) or [f.name for f in self.fields]

    @property
    def needed(self) -> list[str]:
        spare = {f.name for f in self.fields if f.optional}
        return [c for c in self.columns if c not in spare]


SUBMARKET_STATS = ExportSpec(
    "submarket_stats",
    r"submarket_stats_([0-9]{8})\.csv",
    (
        Field("submarket_name", required=True), Field("market", required=True), Field("report_date", "date", required=True),
        Field("vacancy_rate_pct", "double", least=0, most=100), Field("availability_rate_pct", "double", least=0, most=100), Field("asking_rent_nnn_psf", "double", above=0),
        Field("total_inventory_sf", "long", least=0), Field("under_construction_sf", "long", least=0), Field("proposed_sf", "long", least=0), Field("net_absorption_t12_sf", "long"),
    ),
    ("submarket_name", "market", "total_inventory_sf", "vacancy_rate_pct", "availability_rate_pct", "net_absorption_t12_sf", "under_construction_sf", "proposed_sf",
     "asking_rent_nnn_psf", "report_date"),
    gather=True, keys=("market", "submarket_name", "report_date"),
)
LAND_SALES = ExportSpec(
    "land_sales_comps",
    r"land_sales_comps_([0-9]{6})\.csv",
    (
        Field("address", required=True), Field("parcel_id"), Field("county"), Field("submarket", required=True), Field("acres", "double", True, above=0),
        Field("sale_date", "date", True), Field("sale_price", "long", True, above=0), Field("price_per_acre", "double"), Field("buyer_name"),
        Field("seller_name"), Field("zoning"), Field("intended_use"), Field("cap_rate", "double"),
    ),
    keys=("comp_type", "submarket", "address", "sale_date"), constants=(("comp_type", "land"),),
)
BUILDING_SALES = ExportSpec(
    "building_sales_comps",
    r"building_sales_comps_([0-9]{6})\.csv",
    (
        Field("address", required=True), Field("submarket", required=True), Field("sale_date", "date", True), Field("sale_price", "long", True, above=0),
        Field("building_sf", "double", True, above=0), Field("price_psf", "double"), Field("cap_rate", "double"),
        Field("year_built", "long", least=1850, years_ahead=2), Field("clear_height_ft", "double", least=8, most=80),
        Field("noi_at_sale"), Field("buyer_name"), Field("seller_name"), Field("tenant_at_sale"), Field("lease_term_remaining_years"),
    ),
    ("address", "submarket", "building_sf", "year_built", "clear_height_ft", "sale_date", "sale_price", "price_psf", "cap_rate", "noi_at_sale",
     "buyer_name", "seller_name", "tenant_at_sale", "lease_term_remaining_years"),
    keys=("comp_type", "submarket", "address", "sale_date"), constants=(("comp_type", "building"),),
)
LEASING = ExportSpec(
    "leasing_comps",
    r"leasing_comps_([0-9]{6})\.csv",
    (
        Field("address", required=True), Field("submarket", required=True), Field("tenant_name", required=True), Field("lease_start_date", "date", True),
        Field("lease_term_months", "long", True, above=0), Field("building_sf_leased", "double", True, above=0),
        Field("starting_rent_psf_nnn", "double", True, above=0), Field("rent_escalation_pct", "double"), Field("naics_code", "digits", optional=True),
        Field("tenant_industry"), Field("lease_type"),
    ),
    ("address", "submarket", "tenant_name", "tenant_industry", "lease_start_date", "lease_term_months", "building_sf_leased", "starting_rent_psf_nnn",
     "rent_escalation_pct", "lease_type", "naics_code"),
    keys=("submarket", "address", "tenant_name", "lease_start_date"),
)
LAND_LISTINGS = ExportSpec(
    "land_listings",
    r"land_listings_([0-9]{8})\.csv",
    (
        Field("address", required=True), Field("submarket", required=True), Field("listing_date", "date", True), Field("acres", "double", True, above=0),
        Field("asking_price", "long", above=0), Field("asking_price_per_acre", "double", above=0), Field("days_on_market", "long", least=0),
        Field("parcel_id"), Field("county"), Field("zoning"), Field("topography_notes"), Field("listing_broker"), Field("listing_broker_firm"),
        Field("utilities_status"), Field("entitlement_status"),
    ),
    ("address", "parcel_id", "county", "submarket", "acres", "zoning", "topography_notes", "asking_price", "asking_price_per_acre", "listing_date",
     "days_on_market", "listing_broker", "listing_broker_firm", "utilities_status", "entitlement_status"),
    keys=("snapshot_date", "address"), dated="snapshot_date",
)
SPECS = {s.name: s for s in (SUBMARKET_STATS, LAND_SALES, BUILDING_SALES, LEASING, LAND_LISTINGS)}


def header_errors(header: list[str], spec: ExportSpec) -> list[str]:
    names = [h.removeprefix("﻿").strip().lower() for h in header]
    if not any(names):
        return ["empty header"]
    twice = sorted({n for n in names if names.count(n) > 1})
    missing = [c for c in spec.needed if c not in names]
    return [f"duplicate column {n}" for n in twice] + [f"missing column {c}" for c in missing]


def validated(raw: DataFrame, spec: ExportSpec, as_of: datetime.date | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed columns of ``spec``, those of ``keep`` as they are, and ``error`` (null if none): the first failure in the order of required
    texts, required dates, then field by field; with ``gather`` all parse errors joined by ``; ``, then the first range that fails. ``as_of``,
    the day of the run, bounds years and must be given where a field has such a bound. A file's day is taken from ``raw``."""
    values, texts, parses, ranges, mixed = [], [], [], [], []
    # read once in a projection of its own: values, errors and bounds all look at what was read
    raw = raw.select(*keep, *([spec.dated] if spec.dated else []), *[_read(F.col(f.name), f).alias(f.name) for f in spec.fields])
    for f in spec.fields:
        value, parse, limits = _parsed(F.col(f.name), f, as_of)
        values.append(value.alias(f.name))
        if f.required and f.kind in ("string", "date"):
            texts += parse
        else:
            parses += parse
            ranges += limits
            mixed += parse + limits
    errors = [*texts, F.nullif(F.concat_ws("; ", *parses), F.lit("")), *ranges] if spec.gather else [*texts, *mixed]
    more = [F.lit(v).alias(k) for k, v in spec.constants] + ([F.col(spec.dated)] if spec.dated else [])
    return raw.select(*keep, *values, *more, F.coalesce(*errors, F.lit(None).cast("string")).alias("error"))


def file_day(path: Column, spec: ExportSpec) -> Column:
    """The day in the name of a file, null where it has none."""
    return F.try_to_date(F.nullif(F.regexp_extract(path, spec.pattern, 1), F.lit("")), "yyyyMMdd")


def _read(c: Column, f: Field) -> Column:
    """The bare text of a string, of other kinds struct(value, bad)."""
    if f.kind in ("string", "digits"):
        return F.nullif(text.strip(c), F.lit(""))
    if f.kind == "date":
        return text.once(F.nullif(text.strip(c), F.lit("")), lambda bare: text.once(text.date(bare), lambda v: F.struct(v.alias("value"), (bare.isNotNull() & v.isNull()).alias("bad"))))
    return text.number(c)


def _parsed(read: Column, f: Field, as_of: datetime.date | None) -> tuple[Column, list[Column], list[Column]]:
    if f.kind == "string":
        return read, [F.when(read.isNull(), f"{f.name}: required")] if f.required else [], []
    if f.kind == "digits":
        return read, [F.when(~read.rlike("^[0-9]+$"), f"{f.name}: not all digits")], []
    value, bad = read["value"], read["bad"]
    parse, limits = [F.when(bad, f"{f.name}: not a {'date' if f.kind == 'date' else 'number'}")], []
    if f.required:
        parse.append(F.when(value.isNull(), f"{f.name}: required"))
    if f.kind != "date":
        most = f.most
        if f.years_ahead is not None:
            if as_of is None:
                raise ValueError(f"{f.name} is bounded by the day of the run: as_of must be given")
            most = as_of.year + f.years_ahead
        for bound, test in ((f.least, value.__lt__), (f.above, value.__le__), (most, value.__gt__)):
            if bound is not None:
                limits.append(F.when(test(F.lit(bound)), f"{f.name}: out of range"))
    return F.bround(value, 0).cast("long") if f.kind == "long" else value, parse, limits


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rows that failed with their error: a bad row doesn't spoil its file."""
    return checked.where("error IS NULL").drop("error"), checked.where("error IS NOT NULL")


def load(old: DataFrame, checked: DataFrame, spec: ExportSpec) -> DataFrame:
    """``old`` with the valid rows in place of those with their keys; repeated rows of the file all come."""
    return history.keyed_replace(old, split(checked)[0], list(spec.keys))


def read_export(spark: SparkSession, path: str, spec: ExportSpec, as_of: datetime.date | None = None) -> tuple[DataFrame, DataFrame]:
    """Checked rows (file, line, the columns of ``spec``, error) of a file or folder, and files whose header doesn't fit, rows (file,
    error). Each file's columns are those of its own header, a large file is read by many tasks, and ``line`` is where a row begins."""
    rows, headers = lines.read_rows(spark, path)
    names = F.transform("header", lambda h: F.lower(F.btrim(F.regexp_replace(F.coalesce(h, F.lit("")), "^\ufeff", ""))))
    judged = headers.select("file", names.alias("header")).select("file", "header", _header_error(F.col("header"), spec).alias("error"))
    # where a file has each column; -1, which gives null, where it lacks one
    fit = judged.where("error IS NULL").select("file", *[(F.array_position("header", F.lit(c)) - 1).cast("int").alias(f"at_{c}") for c in spec.columns])
    # a row for each file, so few beside the rows that the join by file may be one by broadcast, if Spark finds it small
    raw = rows.join(fit, "file").select("file", "line", *[F.get("cells", F.col(f"at_{c}")).alias(c) for c in spec.columns])
    if spec.dated:
        raw = raw.withColumn(spec.dated, file_day(F.col("file"), spec))
    return validated(raw, spec, as_of, keep=("file", "line")), judged.where("error IS NOT NULL").select("file", "error")


def _header_error(names: Column, spec: ExportSpec) -> Column:
    """``header_errors`` as one text; null if there is none."""
    twice = F.array_sort(F.array_distinct(F.filter(names, lambda n: F.size(F.filter(names, lambda m: m == n)) > 1)))
    missing = F.array_except(F.array(*[F.lit(c) for c in spec.needed]), names)
    told = lambda what, found: F.transform(found, lambda n: F.concat(F.lit(f"{what} column "), n))
    every = F.concat(told("duplicate", twice), told("missing", missing))
    return F.when(~F.exists(names, lambda n: n != ""), "empty header").when(F.size(every) > 0, F.array_join(every, "; "))
