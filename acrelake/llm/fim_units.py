"""Fill-in-middle by relational units.

Every text is cut into units, the matches of a pattern. ``posexplode`` gives a row per unit, window running sums of unit lengths its
end, and each document asks for two cuts by unit ordinal. A join of these requests with the units by document and ordinal finds the
ends, an aggregation brings both to one row per document, and substrings of the text make the prefix, the middle and the suffix.

Texts move in one exchange, by a key of id and text; units, windows, requests and both joins keep that partitioning, so nothing else is
shuffled, and a document's unit rows hold a number each, not its text.

Defined results: a null text reads as empty, a null id as the empty string; an empty text has no units and is plain; a text without
line ends is one unit; repeated rows (id and text alike) give equal results, rows that share an id only are documents of their own;
extra columns are dropped; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines with their ends.
UNIT = r"[^\n]*\n|[^\n]+"
#: Signs before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
SEED = 7
_KEY = ["_k1", "_k2"]


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    rows = rows.select("*", F.xxhash64("_id", "_text").alias("_k1"), F.xxhash64(F.lit(1), "_text", "_id").alias("_k2"))
    return rows.repartition(*_KEY)


def units(keyed: DataFrame, pattern: str = UNIT) -> DataFrame:
    """Rows (key, id, pos, end, n): a unit's ordinal from 1, the code points up to its end, and its document's units. Repeated rows
    share one set. ``posexplode_outer`` keeps filters on the text from going below the exchange, which would then be made twice."""
    lengths = F.transform(F.regexp_extract_all("_text", F.lit(f"({pattern})"), 1), lambda u: F.char_length(u))
    rows = keyed.select(*_KEY, "_id", F.posexplode_outer(lengths).alias("pos", "len")).where("pos IS NOT NULL")
    rows = rows.groupBy(*_KEY, "_id", "pos").agg(F.max("len").cast("long").alias("len"))
    doc = Window.partitionBy(*_KEY)
    upto = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(*_KEY, "_id", (F.col("pos") + 1).alias("pos"), F.sum("len").over(upto).alias("end"), F.count("*").over(doc).alias("n"))


def cuts(units: DataFrame, seed: int = SEED) -> DataFrame:
    """Rows (key, n, lo, hi): the code points before the first and the second cut of each document that has units."""
    h = draws(F.col("_id"), seed)
    asked = units.where("pos = n").select(*_KEY, "n", F.least(h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)).alias("a"), F.greatest(h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)).alias("b"))
    requests = asked.select(*_KEY, "n", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("pos")), F.struct(F.lit(1).alias("side"), F.col("b").alias("pos")))).alias("r"))
    requests = requests.select(*_KEY, F.col("n").alias("_n"), "r.side", F.col("r.pos").alias("pos"))
    # a cut before the first unit meets no unit: nothing lies before it
    met = requests.join(units.select(*_KEY, "pos", "end"), [*_KEY, "pos"], "left")
    at = lambda side: F.coalesce(F.max(F.when(F.col("side") == side, F.col("end"))), F.lit(0))
    return met.groupBy(*_KEY).agg(F.max("_n").alias("n"), at(0).alias("lo"), at(1).alias("hi"))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = UNIT, seed: int = SEED, percent: int = 100, spm_percent: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Rows (id, text, n, form, prefix, middle, suffix, output), one for each row of ``docs``; the parts are null where the form is plain:
    empty texts, texts that hold a mark, and all but ``percent`` of the others."""
    keyed = _keyed(docs, id_col, text_col)
    found = cuts(units(keyed, pattern), seed)
    both = keyed.join(found.hint("shuffle_hash"), _KEY, "left").select("_id", F.col("_text").alias("text"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "lo", "hi")
    text = F.col("text")
    h = draws(F.col("_id"), seed)
    plain = (F.col("n") == 0) | F.contains(text, F.lit(marks[0])) | F.contains(text, F.lit(marks[1])) | F.contains(text, F.lit(marks[2])) | (h[2] % 100 >= percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    part = lambda lo, hi: F.when(F.col("form") != "plain", F.substring(text, (lo + 1).cast("int"), (hi - lo).cast("int")))
    lo, hi = F.col("lo"), F.col("hi")
    out = both.select("*", form.alias("form")).select("_id", "text", "n", "form", part(F.lit(0), lo).alias("prefix"), part(lo, hi).alias("middle"), part(hi, F.char_length(text)).alias("suffix"))
    p, s, m = map(F.lit, marks)
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    return out.select(F.col("_id").alias(id_col), "text", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. No mark can arise across a border of parts, as each begins and ends with a sign that
    occurs nowhere else in it."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    first, second, middle = F.get(parts, 1), F.get(parts, 2), F.get(parts, 3)
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))
