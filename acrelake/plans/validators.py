"""Row checks of the export types, each beside its SQL: raw values go wrong by the row's number, in several fields at once, and the
first failure in the order of checks is told."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession

from acrelake.plans.catalogue import query, t
from acrelake.sources import exports

DAY = datetime.date(2026, 6, 1)

#: Per export the columns with their usual value, and in order of checks (column, modulus, remainder, value, error).
RAW: dict[str, tuple[dict[str, str], list[tuple[str, int, int, str | None, str]]]] = {
    "land_sales_comps": (
        {"address": " 1 Main ", "submarket": "m", "acres": "5.5", "sale_date": "04/27/2026", "sale_price": "$1,000", "price_per_acre": "", "cap_rate": "5%"},
        [
            ("address", 11, 0, "  ", "address: required"), ("submarket", 13, 0, None, "submarket: required"),
            ("sale_date", 7, 0, "soon", "sale_date: not a date"), ("sale_date", 7, 1, "", "sale_date: required"),
            ("acres", 5, 0, "x1", "acres: not a number"), ("acres", 5, 1, "", "acres: required"), ("acres", 5, 2, "0", "acres: out of range"),
            ("sale_price", 3, 0, "-4", "sale_price: out of range"), ("price_per_acre", 4, 0, "y", "price_per_acre: not a number"), ("cap_rate", 17, 0, "n", "cap_rate: not a number"),
        ],
    ),
    "building_sales_comps": (
        {"address": "1 Main", "submarket": "m", "sale_date": "2026-04-27", "sale_price": "9", "building_sf": "1,000", "year_built": "1999", "clear_height_ft": "32"},
        [
            ("address", 17, 0, "", "address: required"), ("submarket", 19, 0, None, "submarket: required"),
            ("sale_date", 11, 0, None, "sale_date: required"), ("sale_price", 7, 0, "0", "sale_price: out of range"), ("sale_price", 7, 1, "", "sale_price: required"),
            ("building_sf", 5, 0, "big", "building_sf: not a number"), ("year_built", 4, 0, "1849", "year_built: out of range"), ("year_built", 4, 1, "2029", "year_built: out of range"), ("year_built", 4, 2, "2028", ""),
            ("clear_height_ft", 3, 0, "81", "clear_height_ft: out of range"), ("clear_height_ft", 3, 1, "7.9", "clear_height_ft: out of range"),
        ],
    ),
    "leasing_comps": (
        {"address": "1 Main", "submarket": "m", "tenant_name": "t", "lease_start_date": "2026-04-27", "lease_term_months": "60", "building_sf_leased": "10", "starting_rent_psf_nnn": "$7.5", "naics_code": "4931"},
        [
            ("address", 17, 0, "", "address: required"), ("tenant_name", 13, 0, " ", "tenant_name: required"), ("lease_start_date", 11, 0, "13/13/2026", "lease_start_date: not a date"),
            ("lease_term_months", 7, 0, "0", "lease_term_months: out of range"), ("building_sf_leased", 5, 0, "", "building_sf_leased: required"),
            ("starting_rent_psf_nnn", 4, 0, "-1", "starting_rent_psf_nnn: out of range"), ("naics_code", 3, 0, "49-31", "naics_code: not all digits"),
        ],
    ),
    "land_listings": (
        {"address": "1 Main", "submarket": "m", "listing_date": "2026-04-27", "acres": "9", "asking_price": "100", "asking_price_per_acre": "", "days_on_market": "3"},
        [
            ("address", 17, 0, None, "address: required"), ("listing_date", 13, 0, "today", "listing_date: not a date"), ("acres", 11, 0, "-1", "acres: out of range"),
            ("asking_price", 7, 0, "0", "asking_price: out of range"), ("asking_price_per_acre", 5, 0, "0.0", "asking_price_per_acre: out of range"), ("days_on_market", 4, 0, "-1", "days_on_market: out of range"), ("days_on_market", 4, 1, "z", "days_on_market: not a number"),
        ],
    ),
}


def _literal(v: str | None) -> str:
    return "NULL" if v is None else f"'{v}'"


def _value(column: str, usual: str | None, cases: list[tuple[str, int, int, str | None, str]]) -> str:
    own = [f"WHEN p_partkey % {m} = {r} THEN {_literal(v)}" for c, m, r, v, _ in cases if c == column]
    return f"CAST({f'CASE {" ".join(own)} ELSE {_literal(usual)} END' if own else _literal(usual)} AS STRING) AS {column}"


def _register(name: str) -> None:
    spec, (usual, cases) = exports.SPECS[name], RAW[name]
    told = " ".join(f"WHEN p_partkey % {m} = {r} THEN '{e}'" for _, m, r, _, e in cases if e)

    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = t(spark, sf_dir, "part").selectExpr("p_partkey", *[_value(c, usual.get(c), cases) for c in spec.columns], *([f"DATE '2026-05-04' AS {spec.dated}"] if spec.dated else []))
        return exports.validated(raw, spec, DAY, keep=("p_partkey",)).select("p_partkey", "error")

    rows.__name__ = f"validated_{name}"
    query(f"SELECT p_partkey, CASE {told} END AS error FROM part")(rows)


for _name in RAW:
    _register(_name)
