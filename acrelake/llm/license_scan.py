"""Licence scans: an Aho-Corasick automaton over words, and a shunting-yard evaluator for licence expressions.

Each text is lower-cased (A-Z) and cut into words; one automaton finds every phrase (identifier tags, notice
phrases, licence names) at word boundaries. After an ``SPDX-License-Identifier`` tag the rest of the line is
parsed as an expression with and/or/with, as far as it is one, and evaluated over licence categories. An operand is a known identifier or
a reference (``LicenseRef-``, ``DocumentRef-``), and what stands to the right of ``with`` a known exception: prose after a tag is no
expression. The identifiers are those of ``license_ids.txt`` beside this file; the notice phrases are a short list of the most common ones.

Defined results: a null or empty text has no words, no labels and score 0; text without a phrase the same;
a line that begins with no expression gives the label ``expression-invalid`` and nothing else; extra columns are dropped; repeated
rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from importlib import resources

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: The phrases of the contract and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notice phrases and tags of our own: label and the evidence that one of them gives.
NOTICES = {
    "licensed under the apache license version 2 0": ("apache-2.0", 0.95),
    "released under the mit license": ("mit-notice", 0.95),
    "licensed under the mit license": ("mit-notice", 0.95),
    "permission is hereby granted free of charge": ("mit-notice", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "gnu general public license": ("gnu", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "general public license version 2": ("gpl-2.0", 0.9),
    "general public license version 3": ("gpl-3.0", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "licensed under cc by nc": ("cc-by-nc", 0.9),
    "licensed under cc by": ("cc-by", 0.8),
    "licensed under cc0": ("cc0", 0.9),
    "creative commons attribution": ("cc-by", 0.8),
    "creative commons zero": ("cc0", 0.9),
    "all rights reserved": ("all-rights-reserved", 0.5),
    "bsd license": ("bsd", 0.7),
    "isc license": ("isc", 0.7),
}
BASE_WEIGHT = 0.7
TAG = "spdx license identifier"

RANK = {"permissive": 0, "weak-copyleft": 1, "copyleft": 2, "restricted": 3, "unknown": 4}
_NAMES = {v: k for k, v in RANK.items()}
_TAG_LINE = re.compile(r"SPDX-License-Identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.+:-]+)")
_BINDING = {"or": 1, "and": 2, "with": 3}
_REFERENCE = re.compile(r"(documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+", re.IGNORECASE)


@lru_cache(maxsize=1)
def identifiers() -> dict[str, str]:
    """Lower-case identifiers and their category; exceptions have the category ``exception``. The file has a line for each category."""
    out = {}
    for line in resources.files("acrelake.llm").joinpath("license_ids.txt").read_text().splitlines():
        kind, _, names = line.partition(":")
        if names and not line.startswith("#"):
            out |= dict.fromkeys(names.lower().split(), kind)
    return out


def known(token: str, exception: bool) -> bool:
    """Whether a token may stand as a licence, or as an exception to one; a plus sign means later versions too."""
    low = token.lower()
    if exception:
        return identifiers().get(low) == "exception"
    kind = identifiers().get(low) or identifiers().get(low.removesuffix("+"))
    return kind not in (None, "exception") or bool(_REFERENCE.fullmatch(low))


def parse_expression(text: str, whole: bool = True) -> list[str]:
    """Reverse Polish order of a licence expression by the shunting-yard algorithm; ValueError if malformed or of unknown names. Unless
    it must be the ``whole`` text, the longest beginning that is an expression counts, as prose or punctuation often follows."""
    out: list[str] = []
    stack: list[str] = []
    operand, at, text = True, 0, text.strip().removesuffix("*/").removesuffix("-->").strip()
    good: list[str] | None = None
    size = depth = 0

    def error() -> list[str]:
        if whole or good is None:
            raise ValueError(text)
        return out[:size] + good

    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            return error()
        at, token = found.end(), found[1]
        low = token.lower()
        if token == "(":
            if not operand:
                return error()
            stack.append(token)
            depth += 1
        elif token == ")":
            if operand or not depth:
                return error()
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif low in _BINDING:
            if operand:
                return error()
            while stack and stack[-1] != "(" and _BINDING[stack[-1]] >= _BINDING[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        else:
            token = token if whole else token.rstrip(".:")
            if not operand or not known(token, bool(stack) and stack[-1] == "with"):
                return error()
            out.append(token)
            operand = False
        if not operand and not depth:
            good, size = stack[::-1], len(out)
    return error() if operand or depth else out + stack[::-1]


def category(identifier: str) -> str:
    low = identifier.lower()
    return identifiers().get(low) or identifiers().get(low.removesuffix("+")) or ("restricted" if _REFERENCE.fullmatch(low) else "unknown")


def evaluate(rpn: list[str]) -> tuple[str, list[str]]:
    """Category and identifiers: ``or`` takes the freer side, ``and`` the more closed one, ``with`` keeps its licence
    but loosens copyleft to weak copyleft."""
    stack: list[int] = []
    names: list[str] = []
    for i, token in enumerate(rpn):
        if token in _BINDING:
            b, a = stack.pop(), stack.pop()
            stack.append(min(a, b) if token == "or" else max(a, b) if token == "and" else min(a, 1) if a == 2 else a)
        else:
            exception = i + 1 < len(rpn) and rpn[i + 1] == "with"
            stack.append(0 if exception else RANK[category(token)])
            if not exception:
                names.append(token.lower())
    return _NAMES[stack[0]], sorted(set(names))


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Phrases between spaces, so that matches begin and end at word boundaries."""
    found = ahocorasick.Automaton()
    for phrase in sorted({*BASE_PHRASES, *NOTICES, TAG}):
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan_text(text: str | None) -> dict:
    """All places of all phrases, the labels and the score of one text."""
    text = text or ""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))
    line = f" {' '.join(words)} "
    base, labels, own, score, starts = set(), set(), [], 1.0, []
    tagged, seen, upto = False, 0, 0
    for end, phrase in automaton().iter(line):  # ends never go back
        seen, upto = seen + line.count(" ", upto, end), end
        word = seen - phrase.count(" ") - 1
        own.append((word, phrase))
        if phrase == TAG:
            tagged = True
        if phrase in BASE_PHRASES:
            base.add(BASE_PHRASES[phrase])
            starts.append(word)
            score *= 1 - BASE_WEIGHT
        if phrase in NOTICES:
            label, weight = NOTICES[phrase]
            labels.add(label)
            score *= 1 - weight
    expressions = []
    if tagged:
        for found in _TAG_LINE.finditer(text):
            try:
                kind, names = evaluate(parse_expression(found[1], whole=False))
                labels |= {kind, *names}
                expressions.append(found[1].strip())
                score = 0.0
            except ValueError:
                labels.add("expression-invalid")
    return {"n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": sorted(base), "labels": sorted(base | labels), "score": 1 - score, "matches": sorted(own), "expressions": expressions}


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, matches array<struct<word:long,phrase:string>>, expressions array<string>"
_ARROW = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()), ("matches", pa.list_(pa.struct([("word", pa.int64()), ("phrase", pa.string())]))), ("expressions", pa.list_(pa.string()))])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: word count, places, labels, score, every match and every valid expression."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(t) for t in batch.column(1).to_pylist()]
            for row in rows:
                row["matches"] = [{"word": w, "phrase": p} for w, p in row["matches"]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *pa.array(rows, _ARROW).flatten()], [id_col, *(f.name for f in _ARROW)])

    rows = docs.select(id_col, docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"{id_col} {dict(rows.dtypes)[id_col]}, {SCHEMA}")
