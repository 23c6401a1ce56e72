"""Near-duplicates by MinHash with tensored banding, links confirmed on full shingle sets.

Two small collections of ``rows`` concatenated hashes each (``side`` of them) give side * side table keys, one for every
pair of a hash from the first and one from the second collection: 2 * side * rows minhashes do the work of
2 * side**2 * rows. A pair of similarity s shares a key with probability (1 - (1 - s**rows)**side)**2, 0.997 at
s = 0.75 and over 0.9999 at 0.85 for the defaults.

Texts with equal shingle sets form one class, represented once, so copies cost one row each. Only half keys that
occur in two classes are paired, which loses no shared table key. Inside a table bucket every member is tried against one other,
then members outside the largest component against one of them (``graph.link_buckets``): linear for a large group of near copies.

What is left is exact and needs no pair of members either: each group of buckets has one pivot P, and its members are held as
their differences from it, R = P - X and A = X - P. As common(X, Y) = P - R(X) - R(Y) + |R(X) & R(Y)| + |A(X) & A(Y)|, with sets
standing for their sizes, two members are linked only if their differences share so many shingles that v(X) + v(Y), v(X) = R(X) - P / 2 +
X * num / (num + den), is reached. A member that is linked with P at once joins its component. For others that bound is
positive, hence their differences meet by a join on the rarest shingles of each (a prefix filter): near copies just below
the threshold differ from each other by shingles of their own, and never become candidates. Where two meet, what both have left from there on
must still suffice (a positional filter, for what is lacking and what is new apart).

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer
words than the shingle's give one shingle; rows with a null id belong to components like others but can't name them
(``component_id`` is null, ``kept`` true where no row of the component has an id); repeated rows are copies; ``chosen`` marks the
one document of a component, its smallest (id, hash of the text), in every row that has both; extra
columns are dropped; an empty table gives an empty one. Classes are numbered by 64 bits of their 128-bit hash; two of n
classes fall together with probability n * n / 2 ** 65.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrelake.llm.common import drop_written, maybe_broadcast, prefix_sums, written
from acrelake.llm.graph import link_buckets, shared_keys

WORDS = 5
SIMILARITY = (75, 100)
SIDE = 12
ROWS = 3

_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of one text; bytes.lower and bytes.split touch ASCII only."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.empty(0, _U)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), _U, len(parts))
    if len(parts) <= words:
        ids, words = ids, len(parts)
    n = len(ids) - words + 1
    h = np.full(n, words, _U)
    for i in range(words):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + ids[i : i + n])
    return np.unique(h)


def signature(shingles: np.ndarray, side: int, rows: int, seed: int = 1) -> np.ndarray:
    """2 * side half keys, each of ``rows`` minhashes, by one multiply and shift per minhash."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(1, 1 << 63, 2 * side * rows, dtype=np.int64).astype(_U) * _U(2) + _U(1)
    add = rng.integers(0, 1 << 63, 2 * side * rows, dtype=np.int64).astype(_U)
    low = np.empty(2 * side * rows, _U)
    for i in range(len(low)):
        h = shingles * mult[i] + add[i]
        low[i] = ((h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)).min()
    keys = np.zeros(2 * side, _U)
    for r in range(rows):
        keys = _mix(keys * _U(0x9E3779B97F4A7C15) + low[r::rows] + np.arange(2 * side, dtype=_U))
    return keys


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """Rows (id, text_key, n_shingles, class_id, halves): class_id is a 128-bit hash of the set, text_key one of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, classes, halves = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text, words)
                counts.append(len(s))
                classes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                halves.append(signature(s, side, rows).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(classes, pa.binary()), pa.array(halves, pa.list_(pa.int64()))], [id_col, "text_key", "n_shingles", "class_id", "halves"])

    src = docs.select(docs[id_col], F.xxhash64(docs[text_col].cast("string")).alias("text_key"), docs[text_col].cast("string").alias("text"))
    return src.mapInArrow(run, f"`{id_col}` {dict(src.dtypes)[id_col]}, text_key long, n_shingles long, class_id binary, halves array<long>")


def full_sets(docs: DataFrame, text_col: str, words: int = WORDS) -> DataFrame:
    """Rows (class_id, shingles) of texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for t in batch.column(0).to_pylist() if len(s := shingle_set(t, words))]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["class_id", "shingles"])

    return docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "class_id binary, shingles array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """Rows (id, text_key, n_shingles, class_id, component_id, kept, chosen) for every row of ``docs``."""
    num, den = similarity
    base = written(sketches(docs, id_col, text_col, words, side, rows), "sketches")
    own = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("text_key"))
    # classes are numbered by a 64-bit hash of it: long keys shuffle and compare far cheaper than binary ones
    reps = base.where("class_id is not null").groupBy("class_id").agg(F.min(own).alias("name"), F.first("n_shingles").alias("n"), F.first("halves").alias("halves"))
    reps = written(reps.select("*", F.xxhash64("class_id").alias("id")), "classes")

    half = reps.select("id", F.posexplode("halves").alias("place", "h")).select("id", "place", F.col("h").alias("key"))
    alive = shared_keys(half)
    sides = alive.groupBy("id").agg(F.collect_list(F.when(F.col("place") < side, F.struct("place", "key"))).alias("a"), F.collect_list(F.when(F.col("place") >= side, F.struct("place", "key"))).alias("b"))
    pairs = F.flatten(F.transform("a", lambda a: F.transform("b", lambda b: F.xxhash64(a["place"], a["key"], b["place"], b["key"]))))
    keyed = written(sides.select(F.explode(pairs).alias("key"), "id"), "keys")
    sizes = reps.select("id", "n")
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def sets_of(ids: DataFrame) -> DataFrame:
        """A written table (id, shingles) of the classes in the written table ``ids`` (id)."""
        one = reps.join(maybe_broadcast(ids), "id", "left_semi").select("class_id", "id", F.col("name.id").alias("_id"), F.col("name.text_key").alias("_key"))
        one = written(one, "texts")
        wanted = maybe_broadcast(one)
        some = texts.join(wanted, texts["id"].eqNullSafe(F.col("_id")) & (F.xxhash64(texts["text"]) == F.col("_key")), "left_semi")
        sets = full_sets(some, "text", words).join(wanted.select("class_id", "id"), "class_id")
        sets = written(sets.select("id", "shingles").dropDuplicates(["id"]), "sets")
        drop_written(one)
        return sets

    def verify(candidates: DataFrame) -> DataFrame:
        """Links among candidates, on full sets of just the classes that need them."""
        one = lambda c: sizes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"))
        near = written(candidates.join(one("a"), "a").join(one("b"), "b").where(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")), "near")
        need = written(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "need")
        sets = sets_of(need)
        both = near.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("s_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("s_b")), "b")
        common = F.size(F.array_intersect("s_a", "s_b"))
        links = written(both.withColumn("common", common).where(den * F.col("common") >= num * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b"), "links")
        drop_written(near, need, sets)
        return links

    def rest(open_: DataFrame) -> DataFrame:
        return _by_differences(open_, sets_of, num, den)

    groups = link_buckets(keyed, verify, rest)
    drop_written(keyed)
    named = reps.join(groups, "id", "left").select("class_id", "name", F.coalesce("component", "id").alias("component"))
    smallest = named.groupBy("component").agg(F.min("name").alias("first"))
    placed = named.join(smallest, "component").select("class_id", "first")
    out = base.drop("halves").join(placed, "class_id", "left")
    alone = F.col("class_id").isNull()
    component = F.when(alone, F.col(id_col)).otherwise(F.col("first.id"))
    kept = F.coalesce(F.col(id_col) == component, component.isNull())
    return out.select(id_col, "text_key", "n_shingles", "class_id", component.alias("component_id"), kept.alias("kept"), (alone | F.coalesce(own.eqNullSafe(F.col("first")), F.lit(False))).alias("chosen"))


def _by_differences(open_: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """The links between components of open buckets, rows (key, id, component, main); a written table (a, b)."""
    # the smallest member of a bucket's largest component is the pivot: a pair that shares several keys is met once for each pivot
    group = written(open_.select(F.col("main").alias("p"), "id", "component").distinct(), "group")
    ids = written(group.select(F.explode(F.array("p", "id")).alias("id")).distinct(), "ids")
    sets = sets_of(ids)
    sides = group.join(sets.select(F.col("id").alias("p"), F.col("shingles").alias("s_p")), "p").join(sets.select("id", F.col("shingles").alias("s_x")), "id")
    # in whole numbers: v is the docstring's bound times scale, v of P itself is -edge
    scale = 2 * (num + den)
    v = scale * F.size(F.array_except("s_p", "s_x")) - (num + den) * F.size("s_p") + 2 * num * F.size("s_x")
    member = sides.select("p", "id", "component", v.cast("long").alias("v"), ((den - num) * F.size("s_p")).cast("long").alias("edge"), F.array_except("s_p", "s_x").alias("r"), F.array_except("s_x", "s_p").alias("a"))
    member = written(member, "members")
    drop_written(group, ids, sets)
    outside = F.col("v") > F.col("edge")
    direct = member.where(~outside & (F.col("id") != F.col("p"))).select(F.least("p", "id").alias("a"), F.greatest("p", "id").alias("b"))

    # only shingles that two members differ from P by can be shared
    tagged = F.concat(F.transform("r", lambda e: F.struct(e.alias("e"), F.lit(1).alias("lost"))), F.transform("a", lambda e: F.struct(e.alias("e"), F.lit(0).alias("lost"))))
    flat = member.select("p", "id", F.explode(tagged).alias("d")).select("p", "id", "d.e", "d.lost")
    often = flat.groupBy("p", "e").agg(F.count("*").alias("f")).where("f > 1")
    ordered = flat.join(often, ["p", "e"]).groupBy("p", "id").agg(F.array_sort(F.collect_list(F.struct("f", "e", "lost"))).alias("order"), F.sum("lost").alias("nr"), F.sum(1 - F.col("lost")).alias("na"))
    ranked = member.select("p", "id", "component", "v", "edge", outside.alias("out")).join(ordered, ["p", "id"])
    # the least overlap that a partner outside P's reach (its v is over edge), or within it (-edge at least), asks for, and the prefix
    # of the rarest shingles that can't be without a shared one
    least = lambda margin: F.greatest(F.ceil((F.col("v") + margin) / F.lit(scale)), F.lit(1))
    prefix = lambda margin: F.greatest(F.size("order") - least(margin) + 1, F.lit(0)).cast("int")
    ranked = ranked.select("p", "id", "component", "v", "nr", "na", "out", F.expr("order.e").alias("e"), prefix_sums(F.expr("order.lost")).alias("past"), prefix(F.col("edge")).alias("to_out"), F.when(F.col("out"), prefix(-F.col("edge"))).otherwise(0).alias("to_in"))
    ranked = written(ranked, "ranked")
    # a pair is met at its first common shingle at the latest: of either kind it has no more in common than both have from there on
    left_r, left_a = F.col("nr") - F.col("o.past"), F.col("na") - (F.col("at") - F.col("o.past"))
    flagged = lambda size: F.slice(F.arrays_zip("e", "past"), F.lit(1), F.col(size))
    posted = lambda size, where: ranked.where(where).select("p", "id", "component", "v", "nr", "na", F.posexplode(flagged(size)).alias("at", "o"))
    post = lambda size, where: posted(size, where).select("p", "id", "component", "v", left_r.alias("nr"), left_a.alias("na"), F.col("o.e").alias("e"))
    slack = scale * (F.col("nr") + F.col("na")) - F.col("v")

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        """Candidates (p, x, y) of different components that share a posted shingle and could share enough of them. A side's shingle goes
        where all that post it on the other side are of its component or can't reach it, whatever they share."""

        def useful(one: DataFrame, other: DataFrame) -> DataFrame:
            reach = other.groupBy("p", "e").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.max(slack).alias("_most"), F.min("v").alias("_least"))
            both = one.join(reach, ["p", "e"]).where((F.col("v") <= F.col("_most")) & (slack >= F.col("_least")) & ((F.col("_lo") != F.col("component")) | (F.col("_hi") != F.col("component"))))
            return both.drop("_lo", "_hi", "_most", "_least")

        first = useful(left, right)
        l, r = first.alias("l"), useful(right, first).alias("r")
        room = F.expr(f"{scale} * (least(l.nr, r.nr) + least(l.na, r.na)) >= l.v + r.v")
        return l.join(r, F.expr("l.p = r.p AND l.e = r.e AND l.component <> r.component") & room).select("l.p", F.col("l.id").alias("x"), F.col("r.id").alias("y"))

    pairs = met(post("to_out", "out"), post("to_out", "out")).where("x < y").union(met(post("to_in", "out"), post("to_out", "NOT out"))).distinct()
    half = lambda c: ranked.select("p", F.col("id").alias(c), F.col("v").alias(f"v_{c}"), F.col("e").alias(f"e_{c}"))
    sure = pairs.join(half("x"), ["p", "x"]).join(half("y"), ["p", "y"]).where(scale * F.size(F.array_intersect("e_x", "e_y")) >= F.col("v_x") + F.col("v_y"))
    links = written(direct.union(sure.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct(), "links")
    drop_written(member, ranked)
    return links
