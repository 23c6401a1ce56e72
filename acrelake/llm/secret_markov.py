"""Secrets by pattern and by character Markov models, with DataFrame functions only.

Patterns give the base spans. Other long tokens, of letters alone too, are scored by two first-order Markov
models over characters, one of random strings and one of ordinary identifiers; the summed log-likelihood ratio
decides. Both models are counted from labelled samples (a seeded generator here; pass your own to ``train``), and
their difference is one table of constants inside the plan.

Offsets are code points. They come from the lengths of a text's parts between matches, so no row leaves the JVM.

Work is linear in the length of a token, and nearly so in the number of matches in a text.

Defined results: a null or empty text has no spans; extra columns are dropped; repeated rows give repeated results;
an empty table gives an empty one.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelake.llm.common import count_below, let, prefix_sums

#: The patterns of the contract. A run of 16 or more is a maximal run with that length, likewise
#: for access keys; a failing assignment uses up its text, so its length is tested afterwards.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Whole runs of the alphabet that are not of digits alone; whether they have digits at all is left to the models.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?![0-9]+(?![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{16,}"
LEAST_TOTAL = 12.0
LEAST_MEAN = 0.45


def _random_strings(rng: random.Random, count: int) -> list[str]:
    kinds = ["0123456789abcdef", ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[:26], ALPHABET[26:52], ALPHABET[:52]]
    return ["".join(rng.choices(rng.choice(kinds), k=rng.randint(16, 48))) for _ in range(count)]


def _identifiers(rng: random.Random, count: int) -> list[str]:
    words = "get set load read write file name value index count user order item list table column row batch node parse token stream buffer handler request response server client config default error state update delete insert query result type key data time date number total price amount customer address account session version test main util helper manager factory builder service model view page label score text lang source document table part supplier region nation line event thing nation station creation national heit keit ung sch ein mente cion ado llega eau tion ement que elle travaux heureux niveaux chevaux vouloir savoir avoir roi loi jeux lieu nouveau meilleur toujours travailler asamblea demasiado gracias caminos amigos queja cosas deseos jamas trabajo ciudades obligaciones geschichte wissenschaft gesellschaft zwischen strasse pflicht verzeichnis schreiben".split()

    def one() -> str:
        parts = [rng.choice(words) for _ in range(rng.randint(3, 6))]
        style = rng.randrange(5)
        if style == 0:
            out = "_".join(parts)
        elif style == 1:
            out = parts[0] + "".join(map(str.capitalize, parts[1:]))
        elif style == 2:
            out = "-".join(parts)
        elif style == 3:
            out = "_".join(parts).upper()
        else:
            out = "".join(parts)
        if rng.random() < 0.6:
            out += rng.choice(["", "_", "-"]) + str(rng.randint(0, 2030))
        return out + "=" * (rng.random() < 0.02) if rng.random() < 0.9 else "/".join(parts) + f"/{rng.randint(0, 99)}"

    return [one() for _ in range(count)]


def labelled_samples(seed: int, count: int) -> tuple[list[str], list[str]]:
    rng = random.Random(seed)
    return _random_strings(rng, count), _identifiers(rng, count)


def train(secrets: Iterable[str], ordinary: Iterable[str], smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratio of every pair of characters, row by row over ALPHABET."""
    n = len(ALPHABET)
    place = {c: i for i, c in enumerate(ALPHABET)}

    def logs(strings: Iterable[str]) -> list[float]:
        counts = [[smooth] * n for _ in range(n)]
        for s in strings:
            for a, b in zip(s, s[1:]):
                counts[place[a]][place[b]] += 1
        return [math.log(x / sum(row)) for row in counts for x in row]

    return [a - b for a, b in zip(logs(secrets), logs(ordinary))]


@lru_cache(maxsize=2)
def default_table(seed: int = 11, count: int = 20_000) -> tuple[float, ...]:
    return tuple(train(*labelled_samples(seed, count)))


def ratio(token: str, table: tuple[float, ...]) -> float:
    """The score of one token, for tests and thresholds."""
    n = len(ALPHABET)
    return sum(table[ALPHABET.index(a) * n + ALPHABET.index(b)] for a, b in zip(token, token[1:]))


def _llr(token: Column, table: tuple[float, ...]) -> Column:
    """The token's characters are read once into an array of places, so the work is linear in its length."""
    n = len(ALPHABET)
    values = F.split(F.lit(",".join(f"{x:.6g}" for x in table)), ",").cast("array<double>")  # folded to a constant
    places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return let(places, lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(0.0), lambda acc, i: acc + F.get(values, F.get(p, i - 1) * n + F.get(p, i))))


def _spans(text: Column, pattern: str, kind: str, rank: int, good: Column | None = None) -> Column:
    """array<struct(start, rank, end, kind)> of all matches; ``good`` is an array of booleans beside the matches."""
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    sizes = F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.char_length)

    def placed(parts: Column) -> Column:
        before = prefix_sums(F.transform(parts, lambda x: x["gap"] + F.coalesce(x["size"], F.lit(0))))
        starts = F.zip_with(parts, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), F.lit(rank).alias("rank"), (at + x["gap"] + x["size"]).alias("end"), F.lit(kind).alias("kind"), x["good"].alias("good")))
        fits = F.filter(starts, lambda x: x["end"].isNotNull() & F.coalesce(x["good"], F.lit(False)))
        return F.transform(fits, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))

    every = F.transform(sizes, lambda _: F.lit(True)) if good is None else good
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    parts = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), every.alias("good"))
    return F.when(F.regexp_like(text, p), let(parts, placed)).otherwise(none)


def find_secrets(docs: DataFrame, table: tuple[float, ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, base, spans): arrays of struct(start, rank, end, kind) by start, then kind; kind ``random`` is the models'."""
    table = table or default_table()
    rows = docs.select(id_col, F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_t"))
    text = F.col("_t")
    good = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda g: F.char_length(g) >= 12)
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    random_like = F.transform(tokens, lambda t: _random(t, table))
    found = rows.select(
        id_col,
        F.concat(_spans(text, ASSIGN, "assign", 0, good), _spans(text, ACCESS, "access", 1), _spans(text, HEX, "hex", 2)).alias("_base"),
        _spans(text, TOKEN, "random", 3, random_like).alias("_more"),
    )
    # base spans that begin before the end of a token, less those that end by its start, overlap it
    starts, ends = F.array_sort(F.transform("_base", lambda b: b["start"])), F.array_sort(F.transform("_base", lambda b: b["end"]))
    both = F.struct(starts.alias("starts"), ends.alias("ends"))
    clear = let(both, lambda x: F.filter("_more", lambda m: count_below(x["starts"], m["end"]) == count_below(x["ends"], m["start"] + 1)))
    clear = F.when((F.size("_base") == 0) | (F.size("_more") == 0), F.col("_more")).otherwise(clear)
    found = found.select(id_col, F.array_sort("_base").alias("base"), clear.alias("_more"))
    return found.select(id_col, "base", F.array_sort(F.concat("base", "_more")).alias("spans"))


def _random(token: Column, table: tuple[float, ...]) -> Column:
    score = _llr(token, table)
    return (score >= LEAST_TOTAL) & (score >= LEAST_MEAN * (F.char_length(token) - 1))
