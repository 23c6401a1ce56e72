"""Substring deduplication by collinear chaining: fuzzy passages that documents share.

Seeds are minimisers: of every WINDOW consecutive K-word grams the one with the smallest hash, so any span of
WINDOW + K - 1 equal words shares a seed. Each place of a seed that several documents have is joined to one of them, the first in its
anchor, which is linear in the seed's occurrences; the anchor's own further places are joined to it too, so a passage that a
document holds twice is reported at both places. Per pair of documents the matches are chained: a chain gains K for each match and pays
GAP for each word skipped on either side, and the best predecessor comes from a Fenwick tree over anchor positions that
keeps prefix maxima. Chains are aligned word by word, by banded edit distance between seeds and by extension at
their ends. Where parts of one passage have different anchors their aligned parts are joined again:
passages of a document count by the union of its aligned parts.

Result rows are parts of passages of at least LEAST_WORDS words: (id, other_id, start, end, other_start, other_end, edits), word positions,
end exclusive. Both sides are named, so every document that holds a shared passage occurs in some row.

Defined results: null or empty texts and rows with a null id share nothing; repeated rows (id and text alike) are one
document; what one document alone repeats is not looked at; of places of a seed that overlap, as in a word said a thousand times, those
K words apart count; rows that share an id but not the text are told apart by text; extra columns are dropped; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acrelake.llm.common import drop_written, maybe_broadcast, written

K = 5
WINDOW = 8
GAP = 0.1
LEAST_WORDS = 50
#: Aligned parts below this many words are chance; edits may be at most this share of a part: one word in eight, the rate at which seeds
#: of K words still find nine of ten passages.
LEAST_PART = 16
MOST_EDITS = 0.125
#: Mismatches in a row that an extension may cross.
CROSS = 2

_U = np.uint64


def word_ids(text: str | None) -> np.ndarray:
    """64-bit hashes of the words: A-Z lower-cased, cut at ASCII white space."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, parts), _U, len(parts))


def minimisers(ids: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the grams that are smallest in some window."""
    n = len(ids) - k + 1
    if n < window:
        return np.empty(0, _U), np.empty(0, np.int64)
    h = np.full(n, k, _U)
    for i in range(k):
        h = (h * _U(0x9E3779B97F4A7C15)) + ids[i : i + n]
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(32)
    at = np.unique(np.lib.stride_tricks.sliding_window_view(h, window).argmin(1) + np.arange(n - window + 1))
    return h[at], at


def chains(pos: np.ndarray, other: np.ndarray, k: int = K, gap: float = GAP) -> list[list[int]]:
    """Matches grouped to collinear chains, as indices in order; each match is in one chain."""
    if len(pos) == 1:
        return [[0]]
    order = np.lexsort((-other, pos))
    ranks = (np.unique(other, return_inverse=True)[1] + 1).tolist()
    size = max(ranks) + 1
    pos, other = pos.tolist(), other.tolist()
    best, who = [-np.inf] * size, [-1] * size
    score, before = [0.0] * len(pos), [-1] * len(pos)
    for i in order.tolist():
        p, q, r = float(pos[i]), float(other[i]), ranks[i]
        top, j = -np.inf, -1
        x = r - 1
        while x > 0:
            if best[x] > top:
                top, j = best[x], who[x]
            x -= x & -x
        gain = top - gap * (p + q)
        score[i] = k + max(0.0, gain)
        before[i] = j if gain > 0 else -1
        value = score[i] + gap * (p + q)
        while r < size:
            if value > best[r]:
                best[r], who[r] = value, i
            r += r & -r
    used, out = [False] * len(pos), []
    for i in sorted(range(len(pos)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance within a band of ``most``; more than ``most`` counts as most + 1. Stretches that have too few words in
    common are told by counting, the others row by row until all of a row is above ``most``."""
    n, m = len(a), len(b)
    if abs(n - m) > most or max(n, m) - _common(a, b) > most:
        return most + 1
    row = np.arange(m + 1)
    for i in range(1, n + 1):
        lo, hi = max(1, i - most), min(m, i + most)
        step = np.minimum(row[lo - 1 : hi] + (b[lo - 1 : hi] != a[i - 1]), row[lo : hi + 1] + 1)
        row[lo - 1] = i if lo == 1 else most + 1
        row[lo : hi + 1] = step
        at = np.arange(lo - 1, hi + 1)
        row[lo - 1 : hi + 1] = np.minimum.accumulate(row[lo - 1 : hi + 1] - at) + at
        if row[lo - 1 : hi + 1].min() > most:
            return most + 1
    return int(min(row[m], most + 1))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two stretches have in common, each as often as in both."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    count = lambda part: np.bincount(part, minlength=len(ids))
    return int(np.minimum(count(at[: len(a)]), count(at[len(a) :])).sum())


def _apart(h: np.ndarray, at: np.ndarray, k: int = K) -> np.ndarray:
    """Indices of the places to keep: of runs of overlapping places of one seed, those k words apart."""
    order = np.lexsort((at, h))
    h, at = h[order], at[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (at[1:] - at[:-1] >= k)
    since = at - at[np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))]
    keep = fresh.copy()
    keep[1:] |= since[1:] // k != since[:-1] // k
    return order[keep]


def _extend(a: np.ndarray, b: np.ndarray) -> int:
    """How far two arrays agree from their start, crossing up to CROSS mismatches that agreement follows."""
    n = min(len(a), len(b))
    same = (a[:n] == b[:n]).tobytes()
    i = same.find(0)
    if i < 0:
        return n
    good, missed = i, 0
    while i < n and missed <= CROSS:
        if same[i]:
            if missed == 0 or same[i : i + 3] == b"\1\1\1":
                good, missed = i + 1, 0
            else:
                missed += 1
        else:
            missed += 1
        i += 1
    return good


def align(a: np.ndarray, b: np.ndarray, pos: list[int], other: list[int], k: int = K) -> list[tuple[int, int, int, int, int]]:
    """Aligned parts (start, end, other_start, other_end, edits) of a chain; a stretch between seeds that is too
    different ends one part and begins the next."""
    parts, s, o, e, f, cost = [], pos[0], other[0], pos[0] + k, other[0] + k, 0
    later = zip(pos[1:], other[1:])
    if all(p - q == s - o for p, q in zip(pos, other)) and np.array_equal(a[s : pos[-1] + k], b[o : other[-1] + k]):
        e, f, later = pos[-1] + k, other[-1] + k, ()  # equal throughout, as most copies are: no stretch to compare
    for p, q in later:
        if p < e or q < f:  # overlapping seeds on one diagonal go on; on another one the later seed is passed over
            if p - e == q - f:
                e, f = p + k, q + k
            continue
        most = max(2, int(MOST_EDITS * max(p - e, q - f)) + 1)
        d = edits(a[e:p], b[f:q], most)
        if d > most:
            parts.append((s, e, o, f, cost))
            s, o, cost = p, q, 0
        else:
            cost += d
        e, f = p + k, q + k
    parts.append((s, e, o, f, cost))
    out = []
    for s, e, o, f, cost in parts:
        more = _extend(a[e:], b[f:])
        less = _extend(a[:s][::-1], b[:o][::-1])
        cost += int((a[e : e + more] != b[f : f + more]).sum()) + int((a[s - less : s] != b[o - less : o]).sum())
        out.append((s - less, e + more, o - less, f + more, cost))
    return out


class _Words:
    """Word ids of the texts met last; rows of one document follow each other."""

    def __init__(self) -> None:
        self.text, self.ids = None, None

    def __call__(self, text: str) -> np.ndarray:
        if text is not self.text and text != self.text:
            self.text, self.ids = text, word_ids(text)
        return self.ids


#: Words that an extension may reach on either side of a lone seed, which can't make a passage of its own, and of a chain.
_LONE = (LEAST_WORDS - K) // 2
_MARGIN = LEAST_WORDS
#: Seeds with more places and anchors with more chains are spread over tasks.
_HOT = 20_000
_BUSY = 2_000


def _margin(seeds: int) -> int:
    return _LONE if seeds == 1 else _MARGIN


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """Rows (id, other_id, start, end, other_start, other_end, edits)."""
    src = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    src = src.withColumn("d", F.xxhash64("id", "text"))
    kind = dict(src.dtypes)["id"]

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            out: tuple[list, list, list] = ([], [], [])
            for d, text in zip(keys, batch.column(1).to_pylist()):
                h, at = minimisers(word_ids(text))
                kept = _apart(h, at)
                out[0].append(h[kept].view(np.int64))
                out[1].append(np.full(len(kept), d, np.int64))
                out[2].append(at[kept].astype(np.int32))
            columns = [np.concatenate(x) if x else np.empty(0) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())], ["seed", "d", "pos"])

    found = written(src.select("d", "text").mapInArrow(seeds, "seed long, d long, pos int"), "seeds")
    first = F.min(F.struct("d", "pos")).alias("first")
    busy = found.groupBy("seed").agg(first, F.max("d").alias("last"), F.count("*").alias("n")).where("first.d <> last")
    busy = written(busy.select("seed", F.col("first.d").alias("anchor"), F.col("first.pos").alias("other"), "n"), "busy")
    hot = written(busy.where(F.col("n") > _HOT), "hot")
    shared = found.join(maybe_broadcast(hot), "seed", "left_anti").join(busy, "seed").unionByName(found.join(maybe_broadcast(hot), "seed"))
    matches = shared.where("d <> anchor OR pos <> other").groupBy("d", "anchor").agg(F.collect_set(F.struct("pos", "other")).alias("m"))
    matches = matches.select("d", "anchor", "m.pos", "m.other")

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, anchor, pos, other in zip(pdf["d"], pdf["anchor"], pdf["pos"], pdf["other"]):
                for c in chains(pos, other):
                    rows.append((d, anchor, pos[c].tolist(), other[c].tolist()))
            yield pd.DataFrame(rows, columns=["d", "anchor", "pos", "other"])

    every = written(matches.mapInPandas(chained, "d long, anchor long, pos array<int>, other array<int>"), "chains")
    drop_written(found, busy, hot)
    # what chains and their margins cover together must reach the least passage; most chance seeds go here, before any text is read
    margin = F.when(F.size("pos") == 1, _LONE).otherwise(_MARGIN)
    ends = (F.col("pos")[0] - margin, F.element_at("pos", -1) + K + margin)
    lines = written(_islands(every.withColumn("_from", ends[0]).withColumn("_to", ends[1]), "_from", "_to", least).select("d", "anchor", "pos", "other"), "likely")
    drop_written(every)

    def sliced(where: str, out: str):
        """Adds the words around a chain on one side, so that no text travels further."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words = _Words()
            for pdf in batches:
                cut = []
                for text, at in zip(pdf["text"], pdf[where]):
                    lo = max(0, int(at[0]) - _margin(len(at)))
                    cut.append(words(text)[lo : int(at[-1]) + K + _margin(len(at))].view(np.int64))
                pdf = pdf.drop(columns="text")
                pdf[out] = cut
                yield pdf

        return run

    # chains have no bound of their own, so they meet the texts by shuffle; only keys are broadcast
    touched = written(lines.select("d").distinct(), "chained")
    near = src.select("d", "id", "text").join(maybe_broadcast(touched), "d", "left_semi").join(lines, "d")
    left = near.mapInPandas(sliced("pos", "a"), f"d long, id {kind}, anchor long, pos array<int>, other array<int>, a array<long>")
    left = written(left.dropDuplicates(["d", "anchor", "pos", "other"]), "left")
    need = written(left.groupBy("anchor").agg(F.floor(F.count("*") / _BUSY).cast("int").alias("salts")), "anchors")
    split = written(need.where("salts > 0"), "split")
    far = src.select(F.col("d").alias("anchor"), F.col("id").alias("other_id"), "text").join(maybe_broadcast(need), "anchor").dropDuplicates(["anchor"])
    far = far.select("anchor", "other_id", "text", F.explode(F.sequence(F.lit(0), "salts")).alias("salt"))
    turn = F.pmod(F.xxhash64("d", "pos"), F.coalesce("salts", F.lit(0)) + 1).cast("int")
    salted = left.join(maybe_broadcast(split), "anchor", "left").withColumn("salt", turn).drop("salts")

    def aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                a, b = np.asarray(r.a, np.int64).view(_U), words(r.text)
                margin = _margin(len(r.pos))
                lo, ro = max(0, int(r.pos[0]) - margin), max(0, int(r.other[0]) - margin)
                b = b[ro : int(r.other[-1]) + K + margin]
                for s, e, o, f, cost in align(a, b, (np.asarray(r.pos) - lo).tolist(), (np.asarray(r.other) - ro).tolist()):
                    if e - s >= LEAST_PART and cost <= MOST_EDITS * (e - s):
                        rows.append((r.d, r.id, r.other_id, s + lo, e + lo, o + ro, f + ro, cost))
            yield pd.DataFrame(rows, columns=["d", "id", "other_id", "start", "end", "other_start", "other_end", "edits"])

    parts = salted.join(far, ["anchor", "salt"]).mapInPandas(aligned, f"d long, id {kind}, other_id {kind}, start int, end int, other_start int, other_end int, edits int")
    return _islands(parts, "start", "end", least).select(F.col("id").alias(id_col), "other_id", "start", "end", "other_start", "other_end", "edits")


def _islands(rows: DataFrame, start: str, end: str, least: int) -> DataFrame:
    """The rows whose spans, joined with those of their document that they touch, are of ``least`` words or more."""
    by = Window.partitionBy("d").orderBy(start, end)
    rows = rows.withColumn("_reach", F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_island", F.sum(F.when(F.col(start) <= F.col("_reach"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy("d", "_island")
    return rows.withColumn("_words", F.max(end).over(island) - F.min(start).over(island)).where(F.col("_words") >= least)
