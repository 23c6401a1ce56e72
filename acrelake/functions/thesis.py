"""The paragraphs of an investment memo as column expressions: a clause whose data are null is left out, an empty paragraph is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of strategies as memos show them.
STRATEGY_NAMES = {
    "bts": "BTS Development",
    "spec": "Spec Development",
    "land_bank": "Land Bank",
    "ground_lease": "Ground Lease",
    "flip": "Land Flip / Disposition",
}
#: Kinds of owner that memos remark on.
MOTIVATED = ("trust", "estate", "trust_absentee", "absentee", "estate_absentee")
#: The wording of clauses, which must match that of memos already written.
IN_SUBMARKET = "The parcel sits in the %s submarket of the %s industrial market"
IN_MARKET = "The parcel sits in the %s industrial market"
ON_SITE = "on a %.2f acres site"
ZONED = "zoned %s"
ASSESSED = "County assessed value of $%s implies ~$%s/acre on the tax roll"
COMPS = "recent submarket land comps (n=%d) transacted near $%s/acre"
OWNER = "owner is classified as %s -- typically motivated for a clean disposition"
VACANCY = "submarket vacancy is %.1f%%"
ABSORPTION = "trailing-12-month net absorption is %s SF (%s)"
SUPPLY = "under-construction pipeline is %s SF"
TIMING = "On market timing: %s (as of %s, %s)."
PASSES = "Actionability passes all four gates with primary strategy %s; the recommendation below captures the specific next step."
FAILS = "Actionability fails at the %s gate%s Remediating that single blocker would move this parcel into the actionable pipeline."
PENDING = "Actionability is PENDING -- additional data sources or scoring passes are required before this parcel can be classified."


def _said(template: str, *values: Column) -> Column:
    """The clause, null where a value is null."""
    known = F.lit(True)
    for v in values:
        known = known & v.isNotNull()
    return F.when(known, F.format_string(template, *values))


def _whole(c: Column) -> Column:
    """Thousands grouped; fractions are cut, not rounded."""
    return F.format_number(c.cast("long"), 0)


def _given(c: Column) -> Column:
    return F.when(c != "", c)


def _paragraph(clauses: list[Column], between: str) -> Column:
    text = F.concat_ws(between, *clauses)
    return F.when(text != "", F.concat(text, F.lit(".")))


def location(market: Column, submarket: Column, acres: Column, zoning: Column) -> Column:
    place = F.coalesce(_said(IN_SUBMARKET, _given(submarket), _given(market)), _said(IN_MARKET, _given(market)))
    return _paragraph([place, _said(ON_SITE, F.when(acres != 0, acres.cast("double"))), _said(ZONED, _given(zoning))], ", ")


def opportunity(assessed: Column, acres: Column, prices: Column, owner: Column) -> Column:
    """``prices`` is the array of comparable prices per acre; nulls and zeros don't count, and of an even number the upper middle one is taken."""
    value = F.when((assessed != 0) & (acres > 0), assessed)
    known = F.array_sort(F.filter(prices, lambda p: p.isNotNull() & (p != 0)))
    middle = F.get(known, F.floor(F.size(known) / 2).cast("int"))
    clauses = [_said(ASSESSED, _whole(value), _whole(F.try_divide(value, acres))), _said(COMPS, F.size(known), _whole(middle)), _said(OWNER, F.when(owner.isin(*MOTIVATED), owner))]
    return _paragraph(clauses, ". ")


def timing(vacancy: Column, absorption: Column, supply: Column, as_of: Column, source: Column) -> Column:
    way = F.when(absorption >= 0, "positive").otherwise("negative")
    said = F.concat_ws(", ", _said(VACANCY, vacancy.cast("double")), _said(ABSORPTION, _whole(absorption), way), _said(SUPPLY, _whole(supply)))
    return F.when(said != "", F.format_string(TIMING, said, F.coalesce(as_of.cast("string"), F.lit("—")), F.coalesce(_given(source), F.lit("submarket data"))))


def risk(verdict: Column, strategy: Column, blockers: Column) -> Column:
    """``blockers`` maps a gate to its reason."""
    names = F.create_map(*[F.lit(x) for pair in STRATEGY_NAMES.items() for x in pair])
    gate = F.regexp_extract(verdict, "^FAIL:(.*)$", 1)
    reason = _given(F.try_element_at(blockers, gate))
    failed = F.format_string(FAILS, gate, F.coalesce(F.concat(F.lit(": "), reason, F.lit(".")), F.lit(".")))
    passed = F.format_string(PASSES, F.coalesce(F.try_element_at(names, strategy), _given(strategy), F.lit("—")))
    return F.when(verdict == "PASS", passed).when(verdict.startswith("FAIL:"), failed).otherwise(PENDING)


def thesis(*paragraphs: Column) -> Column:
    return F.concat_ws("\n\n", *paragraphs)
