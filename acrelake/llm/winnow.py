"""Benchmark decontamination by winnowing, DataFrame functions only.

Fingerprints are the smallest hashes of K-word grams in every sliding window of SPAN - K + 1 grams. Equal spans of SPAN
words choose the same gram (the first smallest), so joining the fingerprints of documents and of benchmark windows
yields every shared span; each hit is extended to the whole window and compared word by word. Items of fewer than SPAN
words are one window of their own length, fingerprinted by the gram of all their words; only lengths that
occur are looked for.

Only fingerprints meet in the join: benchmark windows are distinct texts, broadcast if a count shows that they are few and
shuffled otherwise. A window that many items share is one row, a passage that many documents share is one probe each.

Defined results: a null text has no words and is not contaminated; items without words are never found; rows with a null id
are judged like others; repeated rows give repeated results; extra columns are dropped; empty tables give an empty one or
nothing contaminated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrelake.llm.common import ascii_lower, let, maybe_broadcast, written

#: The word pattern and the window of the contract.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = 13
K = 6


def words_of(text: Column) -> Column:
    """Words by splitting between them; extracting matches one by one copies the text for each."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN_WORDS, -1), "")


def _grams(hashes: Column, k: int) -> Column:
    """Hashes of all k-word grams, from word hashes. Elements are read one by one: ``slice`` copies the whole array."""
    n = F.size(hashes)
    gram = lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), gram)).otherwise(F.array().cast("array<bigint>"))


def _fingerprints(hashes: Column, span: int, k: int) -> Column:
    """array<struct(p, m)>: per window the first smallest gram, each gram once; p counts words from 0."""
    width = span - k + 1

    def chosen(grams: Column) -> Column:
        first = lambda i: let(F.array(*[F.get(grams, i + j) for j in range(width)]), lambda part: (i + F.array_position(part, F.array_min(part)) - 1).cast("int"))
        places = F.transform(F.sequence(F.lit(0), F.size(grams) - width), first)
        return F.transform(F.array_distinct(places), lambda p: F.struct(p.alias("p"), F.get(grams, p).alias("m")))

    return F.when(F.size(hashes) >= span, let(_grams(hashes, k), chosen)).otherwise(F.array().cast("array<struct<p:int,m:bigint>>"))


def _short(hashes: Column, length: Column, span: int) -> Column:
    """The gram of a whole short window, as ``_grams`` has it for that length."""
    out = F.lit(None).cast("bigint")
    for n in range(1, span):
        out = F.when(length == n, F.xxhash64(*[F.get(hashes, F.lit(j)) for j in range(n)])).otherwise(out)
    return out


def benchmark_windows(items: DataFrame, item_col: str, text_col: str, span: int = SPAN) -> DataFrame:
    """Rows (item, words array, wtext, len) of all windows of all items."""
    rows = items.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(span))
    windows = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))
    out = rows.select("item", size.alias("len"), F.explode(windows).alias("words"))
    return out.select("item", "len", "words", F.array_join("words", " ").alias("wtext"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K) -> DataFrame:
    """Rows (id, text_key, n_words, n_hit, items array<string>), one for every row of ``docs``; text_key is a hash of the text."""
    every = written(benchmark_windows(items, item_col, item_text, span).withColumn("wid", F.xxhash64("len", "wtext")), "windows")
    whole = F.col("len") == span
    mark = let(
        F.transform("words", lambda w: F.xxhash64(w)),
        lambda h: let(_grams(h, k), lambda g: F.struct(F.when(whole, F.array_min(g)).otherwise(_short(h, F.col("len"), span)).alias("m"), F.when(whole, F.array_position(g, F.array_min(g)) - 1).otherwise(0).cast("int").alias("shift"))),
    )
    distinct = every.dropDuplicates(["wtext"]).select("wid", "len", "wtext", mark.alias("mark"))
    prints = written(distinct.select("wid", "len", "wtext", "mark.m", "mark.shift"), "prints")
    short = sorted(r.len for r in prints.where(F.col("len") < span).select("len").distinct().collect())  # at most span - 1 numbers

    mark = lambda length, p, m: F.struct(F.lit(length).alias("len"), (p + 1).alias("p"), m.alias("m"))
    few = lambda h, length: F.transform(_grams(h, length), lambda m, i: mark(length, i, m))
    prints_of = lambda h: F.concat(F.transform(_fingerprints(h, span, k), lambda x: mark(span, x["p"], x["m"])), *[few(h, n) for n in short])
    hashed = F.transform(words_of(F.col(text_col)), lambda w: F.xxhash64(w))
    full = docs.select(F.col(id_col).alias("id"), F.explode(let(hashed, prints_of)).alias("f")).select("id", "f.len", "f.p", "f.m")
    hits = full.join(maybe_broadcast(prints), ["m", "len"]).select("id", (F.col("p") - F.col("shift")).alias("s"), "wid", "len", "wtext")
    hits = hits.where("s >= 1").groupBy(F.col("id").alias("_id")).agg(F.collect_set(F.struct("s", "wid", "len", "wtext")).alias("hits"))
    hits = written(hits, "hits")

    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    both = text.join(hits, F.col("id").eqNullSafe(F.col("_id")), "left")
    none = F.array().cast("array<struct<s:int,wid:bigint,len:int,wtext:string>>")
    judged = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.filter(F.coalesce("hits", none), lambda h: F.array_join(F.slice(w, h["s"], h["len"]), " ") == h["wtext"]).alias("good")))
    covered = lambda good: F.array_distinct(F.flatten(F.transform(good, lambda h: F.sequence(h["s"], h["s"] + h["len"] - 1))))
    judged = let(judged, lambda j: F.struct(j["n_words"].alias("n_words"), F.size(covered(j["good"])).cast("long").alias("n_hit"), F.array_distinct(F.transform(j["good"], lambda h: h["wid"])).alias("wids")))
    found = both.select("id", F.xxhash64("text").alias("text_key"), judged.alias("j")).select("id", "text_key", "j.*")
    found = written(found, "found")

    of = found.where(F.size("wids") > 0).select("id", "text_key", F.explode("wids").alias("wid")).distinct()
    names = of.join(every.select("wid", "item").distinct(), "wid").groupBy(F.col("id").alias("_id"), F.col("text_key").alias("_key")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = found.join(names, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return out.select(F.col("id").alias(id_col), "text_key", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated() -> Column:
    """The contract's rule: a twentieth of the words, at least."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
