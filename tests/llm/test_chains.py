"""Collinear chaining against brute force: every repeated span of over 50 words is covered, clean documents stay out."""

import random

import numpy as np

from acrelake.llm import collinear


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n)]


def test_shared_passages(spark):
    rng = random.Random(4)
    vocab = vocabulary(rng, 5000)
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [text(n) for n in (51, 60, 120, 300)]
    docs, holds = [], {}
    for i in range(80):
        words = text(rng.randint(0, 400))
        if i % 2:
            p = rng.randrange(4)
            holds.setdefault(p, []).append(i)
            at = rng.randint(0, len(words))
            words[at:at] = passages[p]
        docs.append((i, " ".join(words)))
    fuzzy = list(passages[3])
    for j in range(10, 300, 25):
        fuzzy[j] = "edited"
    docs += [(100, " ".join(text(30) + fuzzy)), (101, None), (102, ""), (None, " ".join(passages[2])), (5, docs[5][1]), (103, " ".join(passages[0][:30]))]
    rows = collinear.shared_passages(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, d int")).collect()
    found = {x for r in rows for x in (r.doc_id, r.other_id)}
    want = {i for ids in holds.values() if len(ids) > 1 for i in ids} | {100}
    assert found == want
    words = {i: (t or "").split() for i, t in docs if i is not None}
    for r in rows:
        a, b = words[r.doc_id][r.start : r.end], words[r.other_id][r.other_start : r.other_end]
        assert len(a) >= 16 and collinear.edits(np.array([hash(x) for x in a]), np.array([hash(x) for x in b]), len(a)) <= r.edits
    covered = max((r.end - r.start for r in rows if 100 in (r.doc_id, r.other_id)), default=0)
    assert covered >= 270


def test_chain_scores_match_quadratic_search():
    rng = random.Random(1)
    for _ in range(20):
        n = rng.randint(1, 40)
        pos, other = np.array(rng.sample(range(300), n)), np.array([rng.randrange(300) for _ in range(n)])
        order = sorted(range(n), key=lambda i: (pos[i], -other[i]))
        score = {}
        for i in order:
            gains = [score[j] - collinear.GAP * (pos[i] - pos[j] + other[i] - other[j]) for j in score if pos[j] < pos[i] and other[j] < other[i]]
            score[i] = collinear.K + max([0.0, *gains])
        got = collinear.chains(pos, other)
        assert sorted(i for c in got for i in c) == list(range(n))
        value = lambda c: collinear.K * len(c) - collinear.GAP * (pos[c[-1]] - pos[c[0]] + other[c[-1]] - other[c[0]])
        assert abs(value(got[0]) - max(score.values())) < 1e-6
        assert all(pos[a] < pos[b] and other[a] < other[b] for c in got for a, b in zip(c, c[1:]))


def test_edits():
    rng = random.Random(8)
    for _ in range(50):
        a, b = [rng.randrange(4) for _ in range(rng.randint(0, 12))], [rng.randrange(4) for _ in range(rng.randint(0, 12))]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert collinear.edits(np.array(a), np.array(b), 12) == row[-1]
        assert collinear.edits(np.array(a), np.array(b), 2) == min(row[-1], 3)


def test_empty(spark):
    assert collinear.shared_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_place_of_a_passage_is_found(spark, monkeypatch):
    """A passage that a document holds twice, in the anchor or another one, with and without splitting of hot seeds and anchors."""
    rng = random.Random(11)
    vocab = vocabulary(rng, 4000)
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    p = text(70)
    docs = [(i, " ".join(text(40) + p + text(90) + p + text(20)) if i in (1, 4) else " ".join(text(60) + p + text(30))) for i in range(7)]
    alone = text(80)
    docs += [(20, " ".join(alone + text(50) + alone)), (21, " ".join(["so"] * 3000)), (22, " ".join(text(20) + ["so"] * 400 + text(20)))]
    places = {i: [60] for i in range(7)} | {1: [40, 200], 4: [40, 200]}
    for hot in (20_000, 2):
        monkeypatch.setattr(collinear, "_HOT", hot)
        monkeypatch.setattr(collinear, "_BUSY", hot)
        covered = {}
        for r in collinear.shared_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect():
            covered.setdefault(r.doc_id, set()).update(range(r.start, r.end))
            covered.setdefault(r.other_id, set()).update(range(r.other_start, r.other_end))
        for i, starts in places.items():
            want = {x for s in starts for x in range(s, s + 70)}
            assert want <= covered[i] and len(covered[i]) <= len(want) + 8, i
        assert set(covered) == {*places, 21, 22}
        assert set(range(3000)) <= covered[21] and set(range(20, 420)) <= covered[22]


def test_fuzzy_passages_by_rate_of_edits(spark):
    """Passages of 60 words with an edit every so many words; whole documents are told apart by id."""
    rng = random.Random(12)
    vocab = vocabulary(rng, 20_000)
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs, pairs = [], {}
    for every in (8, 10, 15):
        for _ in range(40):
            p, i = text(60), len(docs)
            q = ["edited" if j % every == every - 1 else w for j, w in enumerate(p)]
            docs += [(i, " ".join(text(50) + p + text(50))), (i + 1, " ".join(text(30) + q + text(50)))]
            pairs.setdefault(every, set()).add(i)
    rows = collinear.shared_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {min(r.doc_id, r.other_id) for r in rows}
    assert all(abs(r.doc_id - r.other_id) == 1 for r in rows)
    share = {every: len(ids & found) / len(ids) for every, ids in pairs.items()}
    assert share[15] >= 0.97 and share[10] >= 0.95 and share[8] >= 0.85, share


def test_edits_of_long_stretches_end_soon():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 60, 20_000).astype(np.uint64)
    assert collinear.edits(a, rng.permutation(a), 4000) > 4000
    b = np.delete(a, [10, 5000, 19_000])
    b[7000] = 1
    assert collinear.edits(a, b, 4000) == 4
    assert collinear.edits(a, rng.integers(0, 1 << 60, 20_000).astype(np.uint64), 4000) == 4001


def test_queries_of_token_counts_and_passages(spark, tmp_path):
    """op6 and op8 through their queries: counts as the tokenizer gives them, passages as planted, and empty tables."""
    import base64

    import public_tokenizers
    import tiktoken

    from acrelake.llm import queries

    rng = random.Random(21)
    vocab = vocabulary(rng, 5000)
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = text(60)
    rows = [(1, f"{text(80)} {passage} {text(40)}"), (2, f"{text(10)} {passage}"), (3, text(200)), (4, None), (5, ""), (6, "a\n" * 30_000), (7, "word " * 60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, "en", "s", 1) for r in rows], schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(queries.RANKS), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.n_tokens for r in queries.op6_token_counts(spark, f"{tmp_path}/a").collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in rows}
    found = {}
    for r in queries.op8_substring_dedup(spark, f"{tmp_path}/a").collect():
        found.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        found.setdefault(r.other_id, set()).update(range(r.other_start, r.other_end))
    assert set(found) == {1, 2} and set(range(80, 140)) <= found[1] and set(range(10, 70)) <= found[2]
    assert len(found[1]) <= 64 and len(found[2]) <= 64
    assert queries.op6_token_counts(spark, f"{tmp_path}/b").count() == 0
    assert queries.op8_substring_dedup(spark, f"{tmp_path}/b").count() == 0


def test_extension_goes_word_by_word():
    """The extension, and chains of one match, against a plain version that looks at each word in turn."""

    def plain(a, b):
        n = min(len(a), len(b))
        good, i, missed = 0, 0, 0
        while i < n and missed <= collinear.CROSS:
            if a[i] == b[i] and (missed == 0 or (i + 3 <= n and all(a[i + j] == b[i + j] for j in range(3)))):
                good, missed = i + 1, 0
            else:
                missed += 1
            i += 1
        return good

    rng = np.random.default_rng(4)
    for _ in range(3000):
        a = rng.integers(0, 50, rng.integers(0, 25))
        b = np.where(rng.random(len(a)) < rng.choice([0, 0.05, 0.2, 0.6]), a + 1, a)[: rng.integers(0, 26)]
        assert collinear._extend(a, b) == plain(a.tolist(), b.tolist())
    assert collinear.chains(np.array([7]), np.array([3])) == [[0]]
