"""op11, op12 and op13: brute force, odd input, empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from acrelake.llm import brown_classes, divergence, fim_units
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, pos long"
ODD = ["", None, "one line", "\n", "\n\n\n", "a\nb", "a\nb\n", "has <S> in it\nx\n", "<P", "é\n😀 x\n\ny" * 7, "<\nS>\nM>\n", "w " * 200_000 + "\nend"]


def odd_docs(spark):
    rows = [(i, t, "en", "s", "x", 1) for i, t in enumerate(ODD)]
    rows += [(3, "a\nb", "en", "s", "x", 1), (3, "a\nb", "en", "s", "x", 1), (None, "a\nb\nc\n", None, None, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def cut(doc_id, text, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", p, m, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("percent,spm", [(100, 50), (40, 0), (100, 100)])
def test_fill_in_middle_is_brute_force(spark, percent, spm):
    docs = odd_docs(spark)
    out = fim_units.fill_in_middle(docs, percent=percent, spm_percent=spm).withColumn("again", fim_units.restored(F.col("output"), F.col("form")))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix, r.middle, r.output, r.again) for r in out.collect()), key=repr)
    want = sorted(((r.doc_id, *cut(r.doc_id, r.text, percent, spm), r.text or "") for r in docs.collect()), key=repr)
    assert got == want


def test_fill_in_middle_moves_texts_once(spark):
    plan = fim_units.fill_in_middle(odd_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan and "Python" not in plan
    assert plan.count("REPARTITION_BY_COL") in (1, 3)  # planned three times from one description, which adaptive execution makes once
    assert fim_units.fill_in_middle(odd_docs(spark).limit(0)).count() == 0


def measured(rows, least=1, top=10):
    """divergence by plain Python whole numbers."""
    of, df, counts = defaultdict(set), Counter(), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]
        of[lang].add(source)
        df.update({(lang, w) for w in words})
        counts[lang, source].update(words)
    out = set()
    for lang, sources in of.items():
        kept = sorted(t for (x, t), n in df.items() if x == lang and n >= least)
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, k))
    return out


def test_divergence_is_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a, b in product(("Ab", "é", "zz", "Q"), ("x", "Y", "ö", "k", "p", "ß"))]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 30))) + " 12! ", lang, f"s{rng.integers(0, 9)}") for lang in ("en", "de", None) for _ in range(60)]
    rows += [("", "fr", "a"), (None, "fr", "b"), ("lone", "it", "only"), ("x1y", "fr", None), ("?!", "no", "p"), ("", "no", "q")] + [("same same", "en", "hot")] * 50
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("value", F.lit(1))
    for least, sizes in ((1, {"chunk": 4, "block": 2, "slab": 2}), (10, {}), (10**6, {"block": 1})):
        got = [tuple(r) for r in divergence.divergence(docs, least=least, **sizes).collect()]
        assert len(got) == len(set(got)) and set(got) == measured(rows, least)
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_shares_are_exact(spark):
    pairs = [(2, 2), (3, 7), (10**15, 9 * 10**15), (123456789012345, 9 * 10**15 - 1), (2, 9 * 10**15), (5, 1)]
    df = spark.createDataFrame(pairs, "c long, total long")
    assert [r[0] for r in df.select(divergence.share(F.col("c"), F.col("total"))).collect()] == [1 + 10**9 * c // t for c, t in pairs]
    got = divergence._shares(np.array([[c] for c, _ in pairs], np.int64), np.array([t for _, t in pairs], np.int64))
    assert got[:, 0].tolist() == [1 + 10**9 * c // t for c, t in pairs]


def tokens_of(text):
    return (text or "").encode().lower().split() + [b""]


def unigrams(rows):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter(w for (_, t), h in zip(rows, held) if not h for w in tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, h, len(x := tokens_of(t)), sum(counts[w] > 0 for w in x), n, math.fsum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x)) for (i, t), h in zip(rows, held)], counts


def test_class_scores_are_brute_force_and_better_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = brown_classes.class_scores(docs, rounds=2).collect()
    want, _ = unigrams(rows)
    assert len(got) == len(want)
    of = {w[0]: w for w in want}
    for r in got:
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == of[r.doc_id][:5]
        assert r.base_score == pytest.approx(of[r.doc_id][5], rel=1e-10)
        assert r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_class_scores_learn_an_order_of_words(spark):
    """Words of two kinds that take turns: classes tell them apart, and a text out of order scores less."""
    rng = np.random.default_rng(5)
    kinds = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    text = lambda n, order: " ".join(rng.choice(kinds[order(k)]) for k in range(n))
    turns = lambda k: k % 2
    held = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 7 == 2]
    learn = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [(i, text(40, turns)) for i in learn[:600]] + [(i, text(40, turns)) for i in held[:20]] + [(i, text(40, lambda _: rng.integers(0, 2))) for i in held[20:40]]
    got = {r.doc_id: r for r in brown_classes.class_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    good = [got[i].score - got[i].base_score for i in held[:20]]
    bad = [got[i].score - got[i].base_score for i in held[20:40]]
    assert min(good) > 5 > max(bad)  # turns are worth log10(2) a word


def test_class_model_sums_to_one(spark):
    """Over all known words and an unknown one, after any class."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = []
    fit = brown_classes.fit
    brown_classes.fit = lambda coded, top, weights, n, v, rounds: kept.append((fit(coded, top, weights, n, v, rounds), top)) or kept[0][0]
    try:
        brown_classes.class_scores(docs, rounds=3)
    finally:
        brown_classes.fit = fit
    (model, top), (_, counts) = kept[0], unigrams([tuple(r) for r in docs.select("doc_id", "text").collect()])
    code = {bytes(r.word): i for i, r in enumerate(top)}
    share = np.zeros(brown_classes.ALL)
    share[brown_classes.CLASSES] += 1  # the unknown word
    for w, c in counts.items():
        band = brown_classes.EXCHANGED + c.bit_length() - 1
        share[model.classes[code.get(w, band)]] += c + 1
    share /= model.n + model.v + 1
    assert share.sum() == pytest.approx(1)
    assert (share * 10**model.gain).sum(axis=1) == pytest.approx(np.ones(brown_classes.ALL))
    assert max(model.likelihoods) > model.likelihoods[0]


def test_words_beyond_the_exchanged_ones_get_classes(spark, monkeypatch):
    """Words too long for the exchange still learn the order of words, and the model still sums to one."""
    rng, kept = np.random.default_rng(7), []
    long = lambda kind, i: f"{kind}{i}" + "x" * (brown_classes.LONGEST if i >= 10 else 0)
    kinds = [long("n", i) for i in range(60)], [long("v", i) for i in range(60)]
    share = np.array([10.0] * 10 + [1.0] * 50)
    text = lambda n, order: " ".join(rng.choice(kinds[order(k)], p=share / share.sum()) for k in range(n))
    turns = lambda k: k % 2
    held = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 7 == 2]
    learn = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 != 2]
    rare = lambda n: " ".join(long("nv"[k % 2], rng.integers(10, 60)) for k in range(n))
    rows = [(i, text(40, turns)) for i in learn[:600]] + [(i, rare(40)) for i in held[:20]]
    finished = brown_classes.finished
    monkeypatch.setattr(brown_classes, "finished", lambda coded, model: kept.append(finished(coded, model)) or kept[0])
    got = {r.doc_id: r for r in brown_classes.class_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(got[i].score - got[i].base_score for i in held[:20]) > 5
    model = kept[0][1]
    share = model.weight / (model.n + model.v + 1)
    assert share.min() >= 0 and share.sum() == pytest.approx(1)
    assert (share * 10**model.gain).sum(axis=1) == pytest.approx(np.ones(brown_classes.ALL))
    assert model.likelihoods[-1] > model.likelihoods[0]


def test_class_scores_of_odd_texts(spark):
    docs = odd_docs(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in brown_classes.class_scores(docs, rounds=1).collect()), key=repr)
    assert got == sorted(((*w[:5], round(w[5], 6)) for w in unigrams(rows)[0]), key=repr)
    assert brown_classes.class_scores(docs.limit(0)).count() == 0
    lone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = brown_classes.class_scores(spark.createDataFrame([(lone, "a b")], "doc_id long, text string")).first()
    assert (r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0.0, 0.0)


def test_pieces_are_coded_in_turns(spark):
    """The parts hold each piece once, and the table written in turns holds all of them."""
    pieces = spark.range(100).withColumnRenamed("id", "piece")
    parts = brown_classes._turns(pieces)
    assert len(parts) == brown_classes.TURNS > 1 and all(0 < p.count() < 100 for p in parts)
    assert sorted(r.piece for r in brown_classes.written_in_turns(parts, "turns").collect()) == list(range(100))


def test_counts_travel_packed(spark):
    """Neighbours' counts are bytes, and a word is met whole however its rows are cut into batches."""
    ends, k, n = np.array([0, 2, 2, 5]), np.array([3, 223, 0, 7, 9]), np.array([1, 2**40, 5, 6, 7])
    packed = brown_classes._cells(ends, k, n)
    row, at, back = brown_classes._uncelled(packed)
    assert (row.tolist(), at.tolist(), back.tolist()) == ([0, 0, 2, 2, 2], k.tolist(), n.tolist())
    row, at, back = brown_classes._uncelled(packed.slice(1, 2))
    assert (row.tolist(), at.tolist(), back.tolist()) == ([1, 1, 1], [0, 7, 9], [5, 6, 7])
    rng, scores = np.random.default_rng(5), []
    word = lambda i, k: "nv"[k % 2] + str(i) + "x" * (brown_classes.LONGEST if i >= 10 else 0)
    rows = [(i, " ".join(word(rng.integers(10 if i % 7 == 0 else 60), k) for k in range(40))) for i in range(200)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for size in ("10000", "1"):
            spark.conf.set(key, size)
            scores.append({r.doc_id: r.score for r in brown_classes.class_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(5, "doc_id"), rounds=1).collect()})
    finally:
        spark.conf.set(key, before)
    assert len(scores[0]) == 200 and scores[0] == pytest.approx(scores[1])
