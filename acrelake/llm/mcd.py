"""Quality rules: text statistics, and robust multivariate outliers by minimum covariance determinant.

``text_stats`` takes counts of every whole text. ``robust_outliers`` fits location and scatter per group (language and
source) on all rows of it. Each concentration step keeps the share ``support`` of the rows that lie nearest to
the current estimate, rows that tie at the cut by weight, and estimates from them anew, until the determinant stands still; of three starts
(deviations from the medians, moments of all rows with far values pulled in, moments of all rows) the least determinant wins. A last estimate
comes from all rows within the quantile REWEIGHT of that one.

A group of up to ALONE rows takes its steps in one task. A larger one, and the estimate over all rows, takes them as aggregations: one counts rows
by distance, which gives the cut, another sums the moments of those within it, both map-side first; rows within a thirty-second of an octave of
distance tie. So no task holds a group with a third of all rows, and no row is left out.

Rows that the base rule rejects take no part in any estimate: a group that is mostly short texts doesn't make its proper texts outliers.

Each feature has a floor on its standard deviation: deviations below it are ordinary in any group, and a feature that
is constant over a group (no symbols at all) doesn't make the first deviating text an outlier. At every size a group's
center and scatter are shrunk towards those of all rows, fitted alike: the group counts by its rows, all rows as
PRIOR_ROWS. A table of a single row or of equal rows has nothing to differ from and rejects none.

Defined results: a null or empty text has zero counts and fails the base rule; null language or source is a group
of its own; a group all of whose rows fail the base rule has no estimate and no outliers; extra columns are dropped; repeated rows
give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrelake.llm.common import drop_written, maybe_broadcast, written

#: The symbols that count.
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines", "n_distinct")


def _repeats(words: list[bytes]) -> tuple[int, int]:
    """Words inside 3-word windows that occur twice or more, and distinct words."""
    n = len(words)
    index = dict(zip(words, range(n)))
    if n < 4:
        return 0, len(index)
    ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
    if n < 2_000_000:  # three ids fit in one long
        keys = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:
        pair = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
        keys = pair[:-1] * n + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] = again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum()), len(index)


def count_text(text: str | None) -> tuple[int, ...]:
    """The counts of COUNTS for one text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    repeat, distinct = _repeats(words)
    dup, seen, lines = 0, set(), 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    upper = sum(1 for _ in filter(bytes.isupper, words))
    return (len(words), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, SYMBOLS)), dup, repeat, upper, text.count("!") + text.count("?"), lines, distinct)


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Rows (id, the columns of ``keep``, COUNTS)."""
    rows = docs.select(id_col, *keep, docs[text_col].cast("string").alias("_text"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = np.array([count_text(t) for t in pdf["_text"]], np.int64).reshape(len(pdf), len(COUNTS))
            out = pdf.drop(columns="_text")
            for i, name in enumerate(COUNTS):
                out[name] = counts[:, i]
            yield out

    return rows.mapInPandas(run, ", ".join([f"`{c}` {kinds[c]}" for c in (id_col, *keep)] + [f"{c} long" for c in COUNTS]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: Transformed statistics and the floors of their standard deviations.
FLOORS = {"f_len": 1.0, "f_word": 0.12, "f_symbols": 0.06, "f_marks": 0.08, "f_upper": 0.12, "f_dup": 0.3, "f_repeat": 0.3, "f_variety": 0.12}


def features() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    root = lambda a, b: F.asin(F.sqrt(F.least(a / b, F.lit(1.0))))
    return {
        "f_len": F.log(words),
        "f_word": F.log(chars / words),
        "f_symbols": root(F.col("n_symbols"), chars),
        "f_marks": root(F.col("n_marks"), chars),
        "f_upper": root(F.col("n_upper"), words),
        "f_dup": root(F.col("n_dup_lines"), F.greatest(F.col("n_lines"), F.lit(1)).cast("double")),
        "f_repeat": root(F.col("n_repeat_words"), words),
        "f_variety": F.log(F.col("n_distinct").cast("double") / F.pow(words, F.lit(0.75)) + 1e-3),
    }


def chi2_quantile(p: float, d: int) -> float:
    """Wilson and Hilferty's approximation."""
    from statistics import NormalDist

    return d * (1 - 2 / (9 * d) + NormalDist().inv_cdf(p) * math.sqrt(2 / (9 * d))) ** 3


#: Rows that the estimate over all rows counts for beside a group's own.
PRIOR_ROWS = 50
#: Quantile within which rows count in the last estimate.
REWEIGHT = 0.975


#: Rows of the largest group that is fitted in one task.
ALONE = 6000
#: Distances, by octave, and values, by floor, that are told apart where rows are counted by them.
BINS = 32
#: Scaled deviations beyond which the second start pulls values in.
PULL = 1.5
#: Log-determinants that move by less than this stand still.
STILL = 1e-6
#: The same where rows tie by bins of distance.
STILL_BINNED = 1e-4
STEPS = 50


def _estimate(mean: np.ndarray, cov: np.ndarray, rows: float, floors: np.ndarray, prior: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(center, precision, scatter, log-determinant) of moments, shrunk towards ``prior`` by ``rows`` and floored."""
    if prior is not None:
        own = rows / (rows + PRIOR_ROWS)
        mean, cov = own * mean + (1 - own) * prior[0], own * cov + (1 - own) * prior[1]
    value, vector = np.linalg.eigh(cov / np.outer(floors, floors))
    value = np.maximum(value, 1.0)  # no direction is narrower than the floors
    back = vector / floors[:, None]
    return mean, (back / value) @ back.T, cov, float(np.log(value).sum())


def _grow(share: float, d: int) -> float:
    """Scatter of the nearest share of a normal sample, made consistent: share over P(chi2 with d + 2 <= quantile)."""
    return 1.0 if share == 1.0 else share / _chi2_cdf(chi2_quantile(share, d), d + 2)


def _moments(x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = weight @ x / weight.sum()
    far = x - mean
    return mean, (far * weight[:, None]).T @ far / weight.sum()


def concentrate(x: np.ndarray, rows: float, floors: np.ndarray, support: float, steps: int = STEPS, prior: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The raw estimate of one group from its vectors ``x``; ``rows`` is how many the group has."""
    n, d = x.shape
    middle = np.median(x, axis=0)
    width = np.maximum(1.4826 * np.median(np.abs(x - middle), axis=0), floors)
    ones = np.ones(n)
    pulled = np.clip(x, middle - PULL * width, middle + PULL * width)
    starts = [(middle, np.diag(1 / width**2)), *[_estimate(*_moments(y, ones), rows, floors, prior)[:2] for y in (pulled, x)]]
    best = None
    for center, precision in starts:
        was = None
        for _ in range(steps):
            far = np.einsum("ij,jk,ik->i", x - center, precision, x - center)
            cut = np.sort(far)[max(0, math.ceil(support * n) - 1)]
            below, at = far < cut, far == cut
            # rows that tie at the cut count by weight, so that a third of equal rows doesn't come in or stay out as a whole
            weight = below + at * min(1.0, max(0.0, support * n - below.sum()) / at.sum())
            mean, cov = _moments(x, weight if weight.sum() > 0 else ones)
            now = _estimate(mean, cov * _grow(support, d), rows, floors, prior)
            center, precision = now[:2]
            if was is not None and abs(was - now[3]) <= STILL:
                break
            was = now[3]
        if best is None or now[3] < best[3]:
            best = now
    return best


def _fitted(rows: DataFrame, own: list[str], names: list[str], floors: np.ndarray, support: float, steps: int, prior: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """Rows (own, center, precision, scatter) of the raw estimates, a group in one task; ``rows`` has the group's size as _rows."""
    kinds = dict(rows.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        center, precision, scatter, _ = concentrate(pdf[names].to_numpy(float), float(pdf["_rows"].iloc[0]), floors, support, steps, prior)
        return pd.DataFrame([[*key, center.tolist(), precision.ravel().tolist(), scatter.ravel().tolist()]], columns=[*own, "center", "precision", "scatter"])

    return rows.groupBy(*own).applyInPandas(run, ", ".join([f"`{k}` {kinds[k]}" for k in own] + ["center array<double>", "precision array<double>", "scatter array<double>"]))


def _distance(names: list[str]) -> Column:
    d = len(names)
    diff = [F.col(n) - F.col("center")[i] for i, n in enumerate(names)]
    terms = [diff[i] * diff[j] * F.col("precision")[i * d + j] * (1 if i == j else 2) for i in range(d) for j in range(i, d)]
    return sum(terms[1:], terms[0])


_STATE = ("center array<double>", "precision array<double>", "scatter array<double>", "logdet double")


def _summed(rows: DataFrame, by: list[str], off: list[Column], weight: Column) -> DataFrame:
    """Rows (by, _rows, n, s, c): sums of weights, of weighted deviations ``off`` and of their products."""
    d = len(off)
    flat = rows.select(*by, "_rows", weight.alias("_w"), *[o.alias(f"o{i}") for i, o in enumerate(off)])
    of = lambda *k: F.sum(math.prod([F.col(f"o{i}") for i in k], start=F.col("_w")))
    sums = flat.groupBy(*by).agg(F.first("_rows").alias("_rows"), F.sum("_w").alias("n"), *[of(i).alias(f"s{i}") for i in range(d)], *[of(i, j).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)])
    return sums.select(*by, "_rows", "n", F.array(*[f"s{i}" for i in range(d)]).alias("s"), F.array(*[f"c{min(i, j)}_{max(i, j)}" for i in range(d) for j in range(d)]).alias("c"))


def _from_sums(sums: DataFrame, by: list[str], floors: np.ndarray, grow: float, prior: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """Rows (by, _STATE): estimates from sums of deviations from ``at``."""
    d, kinds = len(floors), dict(sums.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                shift = np.array(row["s"]) / row["n"]
                cov = np.array(row["c"]).reshape(d, d) / row["n"] - np.outer(shift, shift)
                mean, precision, scatter, logdet = _estimate(np.array(row["at"]) + shift, cov * grow, float(row["_rows"]), floors, prior)
                out.append([*[row[k] for k in by], mean.tolist(), precision.ravel().tolist(), scatter.ravel().tolist(), logdet])
            yield pd.DataFrame(out, columns=[*by, "center", "precision", "scatter", "logdet"])

    return sums.select(*by, "_rows", "n", "s", "c", "at").coalesce(8).mapInPandas(run, ", ".join([f"`{k}` {kinds[k]}" for k in by] + [*_STATE]))


def _medians(values: DataFrame, own: list[str], floors: np.ndarray) -> DataFrame:
    """Rows (own, m): the medians of the array column ``x`` by place, to a BINS-th of the floors, from counts."""
    width = F.array(*[F.lit(float(f) / BINS) for f in floors])
    flat = values.select(*own, F.posexplode(F.zip_with("x", width, lambda x, w: F.rint(x / w))).alias("i", "bin")).groupBy(*own, "i", "bin").agg(F.count("*").alias("m"))
    group = Window.partitionBy(*own, "i")
    upto = flat.select("*", F.sum("m").over(group.orderBy("bin")).alias("upto"), F.sum("m").over(group).alias("all"))
    middle = upto.where("2 * upto >= all AND 2 * (upto - m) < all")
    at = F.array_sort(F.collect_list(F.struct("i", "bin")))
    return middle.groupBy(*own).agg(F.zip_with(at, width, lambda a, w: a["bin"] * w).alias("m"))


def _starts(rows: DataFrame, own: list[str], names: list[str], floors: np.ndarray, prior: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """Rows (own, _s, _STATE) of the three starts, from all rows."""
    d = len(names)
    middle = written(_medians(rows.select(*own, F.array(*names).alias("x")), own, floors), "medians")
    off = rows.join(maybe_broadcast(middle), own).select(*own, F.zip_with(F.array(*names), "m", lambda x, m: F.abs(x - m)).alias("x"))
    spread = _medians(off, own, floors).withColumnRenamed("m", "mad").join(middle, own)
    spread = written(spread.select(*own, "m", F.zip_with("mad", F.array(*[F.lit(float(f)) for f in floors]), lambda a, f: F.greatest(1.4826 * a, f)).alias("width")), "widths")
    drop_written(middle)
    known = rows.join(maybe_broadcast(spread), own)
    out = [F.col(n) - F.col("m")[i] for i, n in enumerate(names)]
    pull = [F.greatest(-PULL * F.col("width")[i], F.least(PULL * F.col("width")[i], o)) for i, o in enumerate(out)]
    both = known.select(*own, "_rows", F.explode(F.array(*[F.struct(F.lit(k).alias("_s"), F.array(*o).alias("o")) for k, o in ((1, pull), (2, out))])).alias("v")).select(*own, "_rows", "v._s", "v.o")
    sums = _summed(both, [*own, "_s"], [F.col("o")[i] for i in range(d)], F.lit(1.0)).join(spread.withColumnRenamed("m", "at"), own)
    moments = _from_sums(sums, [*own, "_s"], floors, 1.0, prior)
    diagonal = F.array(*[(1 / F.pow(F.col("width")[i], 2)) if i == j else F.lit(0.0) for i in range(d) for j in range(d)])
    first = spread.select(*own, F.lit(0).alias("_s"), F.col("m").alias("center"), diagonal.alias("precision"), F.array().cast("array<double>").alias("scatter"), F.lit(None).cast("double").alias("logdet"))
    state = written(first.unionByName(moments.withColumn("logdet", F.lit(None).cast("double"))), "starts")
    drop_written(spread)
    return state


def _stepped(rows: DataFrame, own: list[str], names: list[str], floors: np.ndarray, support: float, steps: int, prior: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """As :func:`_fitted`, for groups of any size: ``rows`` is a written table, and each step goes over all of it."""
    by = [*own, "_s"]
    state = _starts(rows, own, names, floors, prior).withColumn("still", F.lit(False))
    told = []
    for turn in range(steps):
        # few rows: three for each ALONE rows of the table at least
        moving = state.where("NOT still").select(*by, "center", "precision", F.col("logdet").alias("was"))
        pairs = rows.join(F.broadcast(moving.drop("was")), own).withColumn("_bin", F.floor(BINS * F.log2(F.greatest(_distance(names), F.lit(1e-12)))))
        hist = pairs.groupBy(*by, "_bin").agg(F.count("*").alias("m"), F.first("_rows").alias("_rows"))
        hist = hist.withColumn("over", F.sum("m").over(Window.partitionBy(*by).orderBy("_bin")) - support * F.col("_rows"))
        cut = written(hist.where("over >= 0 AND over - m < 0").select(*by, F.col("_bin").alias("_cut"), (1 - F.col("over") / F.col("m")).alias("_part")), "cut")
        near = pairs.join(F.broadcast(cut), by).where("_bin <= _cut")
        weight = F.when(F.col("_bin") < F.col("_cut"), 1.0).otherwise(F.col("_part"))
        sums = _summed(near, by, [F.col(n) - F.col("center")[i] for i, n in enumerate(names)], weight).join(F.broadcast(moving.select(*by, F.col("center").alias("at"))), by)
        now = _from_sums(sums, by, floors, _grow(support, len(names)), prior).join(F.broadcast(moving.select(*by, "was")), by)
        last = F.lit(turn == steps - 1)
        state = written(now.withColumn("still", last | F.coalesce(F.abs(F.col("was") - F.col("logdet")) <= STILL_BINNED, F.lit(False))).drop("was"), "state")
        told.append(state)
        drop_written(cut)
        if state.where("NOT still").isEmpty():
            break
    ended = told[0].where("still")
    for more in told[1:]:
        ended = ended.unionByName(more.where("still"))
    best = ended.groupBy(*own).agg(F.min_by(F.struct("center", "precision", "scatter"), F.struct("logdet", "_s")).alias("best"))
    return best.select(*own, "best.*")


def _raw(judged: DataFrame, sizes: DataFrame, own: list[str], names: list[str], floors: np.ndarray, support: float, steps: int, prior: tuple[np.ndarray, np.ndarray] | None, alone: int) -> DataFrame:
    """Rows (own, center, precision, scatter), a written table: the raw estimates of all groups, each from all of its rows."""
    rows = judged.join(maybe_broadcast(sizes), own)
    out = _fitted(rows.where(F.col("_rows") <= alone), own, names, floors, support, steps, prior)
    if not sizes.where(F.col("_rows") > alone).isEmpty():
        large = written(rows.where(F.col("_rows") > alone), "large")
        out = out.unionByName(_stepped(large, own, names, floors, support, steps, prior))
    return written(out, "raw")


def _reweighted(keyed: DataFrame, raw: DataFrame, own: list[str], names: list[str], floors: np.ndarray, prior: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """Rows (own, center, precision, scatter): the last estimates, from the sums over all rows near the raw ones. A group none of whose
    rows is near, as its rows are few and far from all others, keeps its raw estimate."""
    d = len(names)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    near = F.col("_d") <= chi2_quantile(REWEIGHT, d)
    # sums of deviations from the raw center, so that no digits are lost in their squares
    off = [F.col(n) - F.col("center")[i] for i, n in enumerate(names)]
    rows = keyed.join(raw, own).withColumn("_d", _distance(names)).select(*own, near.alias("_near"), *[c.alias(f"o{i}") for i, c in enumerate(off)])
    mine = lambda c: F.sum(F.when(F.col("_near"), c))
    sums = rows.groupBy(*own).agg(F.count("*").alias("_rows"), F.count_if("_near").alias("n"), *[mine(F.col(f"o{i}")).alias(f"s{i}") for i in range(d)], *[mine(F.col(f"o{i}") * F.col(f"o{j}")).alias(f"c{i}_{j}") for i, j in pairs])
    kinds = dict(sums.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                center = np.array(row["center"])
                if not row["n"]:
                    out.append([*[row[k] for k in own], row["center"], row["precision"], row["scatter"]])
                    continue
                shift = np.array([row[f"s{i}"] for i in range(d)]) / row["n"]
                cov = np.zeros((d, d))
                for i, j in pairs:
                    cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] / row["n"] - shift[i] * shift[j]
                last = _estimate(center + shift, cov * _grow(REWEIGHT, d), row["_rows"], floors, prior)
                out.append([*[row[k] for k in own], last[0].tolist(), last[1].ravel().tolist(), last[2].ravel().tolist()])
            yield pd.DataFrame(out, columns=[*own, "center", "precision", "scatter"])

    return sums.join(raw, own).mapInPandas(run, ", ".join([f"`{k}` {kinds[k]}" for k in own] + ["center array<double>", "precision array<double>", "scatter array<double>"]))


def robust_outliers(rows: DataFrame, floors: dict[str, float] = FLOORS, groups: tuple[str, ...] = ("lang", "source"), support: float = 0.5, steps: int = STEPS, quantile: float = 1 - 1e-6, fit: Column | None = None, sample: int = ALONE) -> DataFrame:
    """``rows`` with distance2 and outlier (boolean); ``rows`` is a written table that has the features. Rows where ``fit`` is false have
    distances but no part in the estimates; a group without any other row has null distances and no outliers. ``sample`` is the number of
    rows beyond which a group is fitted by distributed steps; none of its rows is left out.

    Groups are many small keys: estimates per group are one row each and are joined back on the keys.
    """
    names, floor = list(floors), np.array(list(floors.values()), float)
    d = len(names)
    own = [f"_k{i}" for i in range(len(groups))]
    keyed = rows.select(*rows.columns, (F.lit(True) if fit is None else fit).alias("_fit"))
    for i, g in enumerate(groups):
        keyed = keyed.withColumn(own[i], F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("null")))
    keyed = written(keyed, "vectors")
    judged = keyed.where("_fit").select(*own, *names)
    sizes = written(judged.groupBy(*own).agg(F.count("*").alias("_rows")), "sizes")
    every = judged.select(F.lit("any").alias("_any"), *names)
    total = written(sizes.agg(F.sum("_rows").alias("_rows")).where("_rows > 0").select(F.lit("any").alias("_any"), "_rows"), "total")
    whole = _raw(every, total, ["_any"], names, floor, support, steps, None, sample).select("center", "scatter").collect()  # one row
    prior = (np.array(whole[0].center), np.array(whole[0].scatter).reshape(d, d)) if whole else None
    raw = _raw(judged, sizes, own, names, floor, support, steps, prior, sample)
    model = written(_reweighted(judged, maybe_broadcast(raw), own, names, floor, prior), "model")
    scored = keyed.join(maybe_broadcast(model).drop("scatter"), own, "left").withColumn("distance2", _distance(names))
    return scored.withColumn("outlier", F.coalesce(F.col("distance2") > chi2_quantile(quantile, d), F.lit(False))).drop(*own, "_fit", "center", "precision")


def _chi2_cdf(x: float, d: int) -> float:
    from statistics import NormalDist

    return NormalDist().cdf(((x / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))


def quality(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, lang, source, COUNTS, features, distance2, outlier, base_failed, kept)."""
    rows = written(text_stats(docs).select("*", *[c.alias(n) for n, c in features().items()]), "stats")
    out = robust_outliers(rows, fit=~base_failed())
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.col("outlier"))
