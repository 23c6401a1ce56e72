"""The sections of a site snapshot as column expressions: a snapshot is one column of text, made by executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acrelake.functions import scoring
from acrelake.functions.thesis import STRATEGY_NAMES

#: Fixed value: what stands for unknown figures.
NONE = "—"
#: Fixed value: the greatest length of a table's cell.
CELL = 120
#: Names of the sub-scores in reports.
SCORE_NAMES = {
    "s1": "interstate proximity",
    "s2": "parcel geometry",
    "s3": "topography / grading cost",
    "s4": "submarket vacancy",
    "s5": "submarket net absorption (T12)",
    "s6": "competing pipeline",
    "s7": "labor pool density",
    "s8": "land basis ($/acre)",
    "s9": "entitlement complexity",
    "s10": "incentive availability",
    "s11": "rail adjacency",
    "s12": "proximity to demand generators",
}
#: Names of the gates in reports.
GATE_NAMES = {"control": "Path to control", "entitlement": "Path to entitlement", "strategy": "Viable strategy with next step", "deal_killer": "No deal-killers"}
#: Ratings that are shown.
RATINGS = ("STRONG", "MODERATE", "WEAK", "N/A")
#: The wording of recommendations.
BELOW = "Composite score %.1f is below the %.0f qualification threshold."
CLEARS = "Composite %.1f clears threshold and all four actionability gates pass. Primary strategy: %s."
BLOCKED = "Composite %.1f clears threshold but %s gate fails%s"


def cell(c: Column) -> Column:
    """A value in one line of a table: blanks are single, bars are escaped, and what is too long ends in an ellipsis."""
    plain = F.btrim(F.regexp_replace(c.cast("string"), r"\s+", " "))
    safe = F.replace(F.replace(plain, F.lit("|"), F.lit("\\|")), F.lit("`"), F.lit(""))
    short = F.when(F.char_length(safe) > CELL, F.concat(F.left(safe, F.lit(CELL - 1)), F.lit("…"))).otherwise(safe)
    return F.coalesce(F.when(short != "", short), F.lit(NONE))


def shown(c: Column, default: str = NONE) -> Column:
    """A value in a line of text."""
    bare = F.btrim(c.cast("string"))
    return F.coalesce(F.when(bare != "", bare), F.lit(default))


def figure(template: str, c: Column) -> Column:
    return F.coalesce(F.when(c.isNotNull(), F.format_string(template, c.cast("double"))), F.lit(NONE))


def whole(c: Column, before: str = "") -> Column:
    """Thousands grouped; fractions are cut, not rounded."""
    return F.coalesce(F.concat(F.lit(before), F.format_number(c.cast("long"), 0)), F.lit(NONE))


def _rows(head: list[str], rows: list[list[Column]]) -> list[Column]:
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return [F.lit("| " + " | ".join(head) + " |"), F.lit("|" + "|".join("-" * (len(h) + 2) for h in head) + "|"), *[line(r) for r in rows]]


def breakdown(weights: dict[str, float]) -> Column:
    """The table of sub-scores, columns named as ``weights``, and their composite, to which an unknown score adds nothing."""
    rows = []
    for name, weight in weights.items():
        score = F.col(name).cast("double")
        whole_score = F.concat(score.cast("int").cast("string"), F.lit("/10"))
        rows.append([F.lit(SCORE_NAMES[name]), F.coalesce(whole_score, F.lit(NONE)), F.lit(f"{weight:g}"), F.format_string("%.2f", F.coalesce(score * float(weight), F.lit(0.0)))])
    total = F.format_string("| **Composite** |  |  | **%.1f/100** |", scoring.full_weight_composite(weights) if sum(weights.values()) else F.lit(0.0))
    return F.concat_ws("\n", *_rows(["Parameter", "Sub-Score", "Weight", "Weighted"], rows), total)


def strategies(fit: Column, reasons: dict[tuple[str, str], str]) -> Column:
    """The table of strategies by a map of their ratings; ``reasons`` has the sentence for a strategy and its rating, which are the user's to write."""
    rows = []
    for key, name in STRATEGY_NAMES.items():
        given = F.try_element_at(fit, F.lit(key))
        rating = F.when(given.isin(*RATINGS), given).otherwise("N/A")
        known = [F.when(rating == r, F.lit(said)) for (k, r), said in reasons.items() if k == key]
        rows.append([F.lit(name), rating, cell(F.coalesce(*known, F.lit(None).cast("string")))])
    return F.concat_ws("\n", *_rows(["Strategy", "Fit", "Rationale"], rows))


def gates(verdict: Column, blockers: Column) -> Column:
    """The table of gates with the reason of the one that fails, and the verdict."""
    rows = [[F.lit(GATE_NAMES[g]), status, F.when(status == "FAIL", cell(F.try_element_at(blockers, F.lit(g)))).otherwise(NONE)] for g, status in scoring.gate_statuses(verdict).items()]
    last = F.concat(F.lit("**Overall actionability**: "), shown(verdict, "PENDING"))
    return F.concat_ws("\n", *_rows(["Gate", "Status", "Detail"], rows), F.lit(""), last)


def strategy_name(strategy: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in STRATEGY_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, strategy), F.when(strategy != "", strategy), F.lit(NONE))


def rationale(score: Column, verdict: Column, threshold: float, strategy: Column, blockers: Column) -> Column:
    """The sentence behind :func:`scoring.recommendation`; an unknown score is -1, an unknown gate is named so."""
    points = F.coalesce(score.cast("double"), F.lit(-1.0))
    gate = F.coalesce(F.when(verdict.startswith("FAIL:"), F.substring(verdict, 6, 1000)), F.lit("(unknown)"))
    reason = F.try_element_at(blockers, gate)
    end = F.when(reason != "", F.concat(F.lit(": "), reason, F.lit("."))).otherwise(".")
    below = F.format_string(BELOW, points, F.lit(float(threshold)))
    return F.when(points < threshold, below).when(verdict == "PASS", F.format_string(CLEARS, points, strategy_name(strategy))).otherwise(F.format_string(BLOCKED, points, gate, end))


def recommendation(score: Column, verdict: Column, threshold: float, strategy: Column, blockers: Column) -> Column:
    return F.concat(F.lit("**"), scoring.recommendation(score, verdict, threshold), F.lit("** — "), rationale(score, verdict, threshold, strategy, blockers))


def heading(address: Column, market: Column, submarket: Column, acres: Column, score: Column, status: Column) -> Column:
    facts = F.concat_ws(" | ", F.concat_ws(" — ", shown(market), shown(submarket)), figure("%.2f acres", acres), F.concat(F.lit("Score: "), figure("%.1f", score), F.lit("/100")), status)
    return F.concat(F.lit("# Site Snapshot: "), shown(address), F.lit("\n## "), facts)


def listed(items: dict[str, Column]) -> Column:
    """A list of named facts, one a line."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"- **{name}**: "), value) for name, value in items.items()])


def open_flags(flags: Column) -> Column:
    """A list of the flags of an array of structs (kind, text)."""
    lines = F.transform(flags, lambda f: F.concat(F.lit("- **"), shown(f["kind"]), F.lit("**: "), shown(f["text"])))
    return F.when(F.size(flags) > 0, F.array_join(lines, "\n")).otherwise("- (no open flags)")


def document(head: Column, sections: dict[str, Column]) -> Column:
    """The whole text; a section that is null is left out with its title."""
    parts = [F.concat(F.lit(f"### {title}\n"), body) for title, body in sections.items()]
    return F.concat(F.concat_ws("\n\n", head, *parts), F.lit("\n"))
