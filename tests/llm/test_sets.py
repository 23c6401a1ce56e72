"""Operators over sets of texts, against plain brute-force versions on small fixtures."""

import hashlib
import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from acrelake.llm import fuzzy_lines, graph, minhash_tensor, queries, winnow
from acrelake.llm.common import written

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, _id int, hits string, key string"


def table(spark, where, rows, name="documents"):
    if name == "benchmark":
        spark.createDataFrame(rows, "item_id long, text string, words int").write.parquet(f"{where}/benchmark.parquet")
    else:
        spark.createDataFrame([(i, t, None, "s", None, 1, 2, "x", "y") for i, t in rows], SCHEMA).write.parquet(f"{where}/{name}.parquet")
    return str(where)


def words(rng, n):
    return [rng.choice("alpha beta gamma delta épsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau phi chi psi omega".split()) + str(rng.randint(0, 9)) for _ in range(n)]


def components(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_rows():
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "one two", "One TWO", "one two three"])]
    for g in range(12):
        base = words(rng, rng.randint(30, 120))
        for _ in range(rng.randint(2, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "edit" + str(rng.randint(0, 99))
            rows.append((len(rows), " ".join(copy)))
            base = copy if g % 3 == 0 else base
    rows += [(len(rows) + k, " ".join(words(rng, 60))) for k in range(30)]
    return rows + [rows[20], rows[-1], (len(rows) + 500, "😀 " * 300)]


def test_near_duplicates(spark, tmp_path):
    rows = near_rows()
    got = sorted(tuple(r) for r in queries.op5_near_duplicates(spark, table(spark, tmp_path, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect())
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    edges = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[b]]
    comp = components(edges, sets)
    assert got == sorted((i, len(sets[i]), comp[i], comp[i] == i) for i, _ in rows)


def test_near_duplicates_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (None, "other words of no one else here"), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash_tensor.near_duplicates(df).collect())
    assert got == sorted([("None", 2, "4", False)] * 2 + [("4", 2, "4", True), ("None", 3, "None", True), ("None", 0, "None", True)])


def test_components_on_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 300), (400, 390), (390, 395)]
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == components(edges, {x for e in edges for x in e})


def test_bucket_links_reach_members_that_miss_the_smallest(spark):
    """In one bucket only neighbours link; the smallest member reaches just one of them."""
    keyed = spark.createDataFrame([(7, i) for i in range(40)] + [(8, i) for i in (1, 50)], "key long, id long")
    verify = lambda p: written(p.where("b - a = 2 OR b = 50"), "links")
    every = lambda o: verify(o.selectExpr("key", "id AS a").join(o.selectExpr("key", "id AS b"), "key").where("a < b").select("a", "b"))
    got = graph.link_buckets(keyed, verify, every)
    assert {r.id: r.component for r in got.collect()} == {**{i: i % 2 for i in range(40)}, 50: 1}


def test_near_copies_just_below_the_threshold(spark, tmp_path):
    """Copies of one text, each changed on its own: few of them are links, all of which are found, and those that aren't never meet."""
    rng, met = random.Random(6), []
    base = words(rng, 200)
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        copy = list(base)
        for at in rng.sample(range(200), rng.choice((3, 6, 6, 7, 7, 8))):
            copy[at] = f"own{rng.randint(0, 40 if i % 9 == 0 else 10**6)}"
        rows.append((i, " ".join(copy)))
    family = rows[5][1].split()
    for i in range(160, 200):
        copy = list(family)
        for at in rng.sample(range(200), 6):
            copy[at] = f"kin{i}x{at}"
        rows.append((i, " ".join(copy)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(196)} for i, t in rows}
    edges = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in minhash_tensor.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(edges, sets)
    # the last join alone, from one bucket of single members
    df = spark.createDataFrame(rows[1:], "doc_id long, text string")
    ids = [r[0] for r in rows[1:]]
    open_ = spark.createDataFrame([(1, i, i, ids[0], len(ids)) for i in ids], "key long, id long, component long, main long, n long")
    lookup = {hash_of: i for i, hash_of in ((i, minhash_tensor.xxhash.xxh3_128_digest(minhash_tensor.shingle_set(t).tobytes())) for i, t in rows[1:])}
    known = spark.createDataFrame([(bytearray(k), i) for k, i in lookup.items()], "class_id binary, id long")
    sets_of = lambda wanted: written(minhash_tensor.full_sets(df, "text").join(known, "class_id").join(wanted, "id", "left_semi").select("id", "shingles"), "sets")
    links = {(r.a, r.b) for r in minhash_tensor._by_differences(open_, sets_of, 75, 100).collect()}
    assert links <= set(edges) and components(links, ids) == components([e for e in edges if e[0]], ids)


def test_near_copies_that_share_changes_meet_seldom(spark, monkeypatch):
    """Copies that share some of their changes with others but not enough: rows of the join of differences stay few."""
    rng, rows = random.Random(9), []
    base = words(rng, 200)
    for i in range(150):
        copy = list(base)
        for at in rng.sample(range(0, 200, 10), 9):
            copy[at] = f"c{at}x{rng.randint(0, 3)}"
        if i % 10 == 9:  # a copy of the one before
            copy = [f"own{i}", *rows[-1][1].split()[1:]]
        rows.append((i, " ".join(copy)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(196)} for i, t in rows}
    edges = {(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    open_ = spark.createDataFrame([(1, i, i, 0, 150) for i in range(150)], "key long, id long, component long, main long, n long")
    known = spark.createDataFrame([(bytearray(minhash_tensor.xxhash.xxh3_128_digest(minhash_tensor.shingle_set(t).tobytes())), i) for i, t in rows], "class_id binary, id long")
    sets_of = lambda wanted: written(minhash_tensor.full_sets(df, "text").join(known, "class_id").join(wanted, "id", "left_semi").select("id", "shingles"), "sets")
    met, distinct = [], type(df).distinct

    def counted(frame):
        if frame.columns == ["p", "x", "y"]:
            met.append(frame.count())
        return distinct(frame)

    monkeypatch.setattr(type(df), "distinct", counted)
    links = {(r.a, r.b) for r in minhash_tensor._by_differences(open_, sets_of, 75, 100).collect()}
    assert len(edges) >= 15 and links == edges
    assert len(met) == 1 and met[0] <= 50_000, met


def test_decontamination(spark, tmp_path):
    rng = random.Random(5)
    items = [(k, " ".join(words(rng, n)), 0) for k, n in enumerate((40, 13, 14, 12, 6, 3, 25, 200))] + [(20, None, 0), (21, "", 0), (22, "...", 0)]
    items += [(30, items[0][1], 0), (31, "same " * 30, 0), (0, items[0][1], 0)]
    rows = [(0, None), (1, ""), (2, "?!"), (3, items[0][1].upper()), (4, "same same. " * 40), (5, "same " * 12)]
    for k in range(60):
        own = words(rng, rng.randint(5, 300))
        for _ in range(rng.randint(0, 3)):
            text = WORD.findall((rng.choice(items)[1] or "").translate(LOWER))
            s = rng.randint(0, max(0, len(text) - 3))
            at = rng.randint(0, len(own))
            own[at:at] = text[s : s + rng.randint(3, 40)]
        rows.append((10 + k, ", ".join(own)))
    rows += [(None, items[6][1]), (10, "again " + items[7][1]), rows[30], (99, "x " * 20000 + items[2][1])]
    where = table(spark, tmp_path, rows)
    table(spark, tmp_path, items, "benchmark")
    got = sorted((tuple(r) for r in queries.op7_decontamination(spark, where).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)
    grams = {}
    for i, t, _ in items:
        w = WORD.findall((t or "").translate(LOWER))
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    want = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for s in range(len(w) - n + 1):
                if (g := tuple(w[s : s + n])) in grams:
                    hit |= set(range(s, s + n))
                    found |= grams[g]
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    assert got == sorted(want, key=str)


def test_line_dedup(spark):
    rng = random.Random(9)
    long = [" ".join(words(rng, 60)) for _ in range(6)]
    fuzzy = long[0].replace(long[0].split()[20], "alphq", 1) + "!"
    docs = [(0, f"{long[0]}\n\n{long[1]}\n---"), (1, f"{long[1].upper()}\n{fuzzy}\n{long[2]}\n---"), (2, None), (3, ""), (4, "hi\nhi\nHI!\nho"), (None, long[0]), (5, f"{long[3]}\n{long[3]}")]
    df = spark.createDataFrame([(i, t, "en", 1, 2) for i, t in docs], "doc_id long, text string, lang string, id int, gone int")
    got = {r.doc.doc_id: r for r in fuzzy_lines.with_counts(df).collect()}
    assert got[0].doc.text == docs[0][1] and got[2].doc.text is None and got[3].doc.text == "" and got[None].doc.text == long[0]
    assert got[4].doc.text == "hi\nho" and got[5].doc.text == long[3]
    assert got[1].doc.text == f"{long[2]}\n---"
    assert [(got[i].n_lines, got[i].n_removed) for i in (0, 1, 4, 5, 2)] == [(4, 0), (4, 2), (4, 2), (2, 1), (0, 0)]
    assert fuzzy_lines.dedup_lines(df).columns == df.columns


def test_lines_of_rows_that_share_an_id(spark):
    """Rows with one id and different texts lose only their own surplus lines; rows alike in both keep the same ones."""
    rows = [(7, "dup line\nzzz"), (7, "a line of no one else at all\nyyy"), (3, "dup line"), (9, "twice here\nand more"), (9, "twice here\nand more")]
    got = sorted(r.text for r in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(["zzz", "a line of no one else at all\nyyy", "dup line", "twice here\nand more", "twice here\nand more"])


def test_lines_against_all_pairs(spark):
    """All lines of the given documents: of the pairs at the least edit similarity, at least as many as stated are found."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = fuzzy_lines._written_lines(docs, "doc_id", "text")
    norms = {r.k1: r.norm for r in rows.select("k1", "norm").distinct().collect()}
    keys = sorted(norms)
    pairs = spark.createDataFrame([(x, norms[x]) for x in keys], "k long, t string")
    near = pairs.selectExpr("k AS a", "t AS ta").join(pairs.selectExpr("k AS b", "t AS tb"), F.expr("a < b AND abs(len(ta) - len(tb)) <= floor(0.05 * greatest(len(ta), len(tb)))"))
    near = near.where("levenshtein(ta, tb, cast(floor(0.05 * greatest(len(ta), len(tb))) AS int)) >= 0").select("a", "b", F.size(F.split("ta", " ")).alias("n")).collect()
    keep = {r.k1: r.keep for r in fuzzy_lines._surplus(rows).collect()}
    found = [r for r in near if keep.get(r.a) is None or keep.get(r.b) is None if r.a in keep and r.b in keep]
    assert len(near) > 10 and len(found) >= 0.97 * len(near)


def changed(rng, line, n):
    """``line`` with n letters replaced at places of their own."""
    chars = list(line)
    for i in rng.sample([i for i, c in enumerate(chars) if c != " "], n):
        chars[i] = "q" if chars[i] != "q" else "z"
    return "".join(chars)


def test_line_dedup_finds_copies_at_edit_similarity(spark):
    """Planted copies go, by line length and share of edited letters up to the limit itself; different lines of the same words stay."""
    rng, docs, planted = random.Random(11), [], {}
    for n in (1, 3, 4, 5, 6, 8, 10, 12, 15, 20, 25, 40, 50, 80, 100, 200):
        for rate in (0.0, 0.02, 0.05):
            for _ in range(40):
                line = " ".join(w.replace("é", "e") for w in words(rng, n)) if n > 1 else "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(20, 59)))
                edits = int(rate * len(line)) if rate else 0
                if edits or not rate:
                    planted[len(docs)] = (n, rate)
                    docs += [(2 * len(docs), line), (2 * len(docs) + 1, changed(rng, line, edits))]
    own = [(10**6 + i, " ".join(words(rng, 30))) for i in range(200)]
    df = spark.createDataFrame(docs + own, "doc_id long, text string")
    gone = {r.doc.doc_id: r.n_removed for r in fuzzy_lines.with_counts(df).collect()}
    assert not any(gone[i] for i, _ in own)
    found = {}
    for k, kind in planted.items():
        found.setdefault(kind, []).append(gone[docs[k][0]] + gone[docs[k + 1][0]])
    share = {kind: sum(x) / len(x) for kind, x in found.items()}
    print(share)
    assert all(x >= 0.97 for (n, rate), x in share.items() if rate <= 0.02), share
    assert all(x >= 0.9 for x in share.values()), share


def test_one_letter_put_in_or_taken_out_of_short_lines(spark):
    rng, rows = random.Random(12), []
    for i in range(300):
        line = "".join(rng.choice("abcdefghijk ") for _ in range(rng.randint(20, 40))).strip().replace("  ", " x")
        at = rng.randrange(len(line))
        rows += [(2 * i, line), (2 * i + 1, line[:at] + "w" + line[at:] if i % 2 else line[:at] + line[at + 1 :])]
    pairs = [(a.strip(), b.strip()) for (_, a), (_, b) in zip(rows[::2], rows[1::2])]
    one = lambda a, b: any(b == a[:k] + a[k + 1 :] for k in range(len(a))) or any(a == b[:k] + b[k + 1 :] for k in range(len(b)))
    due = {i for i, (a, b) in enumerate(pairs) if 20 <= max(len(a), len(b)) and one(a, b)}
    gone = {r.doc.doc_id: r.n_removed for r in fuzzy_lines.with_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(gone[2 * i] + gone[2 * i + 1] == 1 for i in due) and len(due) > 250


def test_template_lines_make_no_pairs(spark, monkeypatch):
    """Lines alike in their first half and apart in the second: candidates grow with the lines, not with their square."""
    made = {}
    for n in (200, 400, 800):
        rng, seen = random.Random(n), [0]
        half = " ".join(words(rng, 25))
        own = lambda: " ".join("".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(5)) for _ in range(25))  # noqa: B023, E731
        rows = [(i, f"{half} {own()}") for i in range(n + 1)]
        rows.append((n + 1, rows[-1][1] + " x"))  # one true copy among them
        alike = fuzzy_lines._alike

        def counted(pairs, least):
            seen[0] += pairs.count()
            return alike(pairs, least)

        monkeypatch.setattr(fuzzy_lines, "_alike", counted)
        monkeypatch.setattr(fuzzy_lines, "_fits", lambda *a: F.lit(True))
        got = fuzzy_lines.with_counts(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()
        monkeypatch.undo()
        assert [r.doc.doc_id for r in got] == [n + 1]
        made[n] = seen[0]
    assert made[800] <= 5 * made[200] and made[800] <= 20 * 800, made


@pytest.mark.parametrize("name", ["op5_near_duplicates", "op7_decontamination", "op9_line_dedup"])
def test_empty_tables(spark, tmp_path, name):
    where = table(spark, tmp_path, [])
    table(spark, tmp_path, [], "benchmark")
    assert queries.QUERIES[name](spark, where).count() == 0


def test_verification_is_the_edit_distance(spark):
    """Pairs of lines with edits anywhere, none too, against the plain distance of whole texts."""
    dice, rows = random.Random(5), []
    for i in range(400):
        line = " ".join("".join(dice.choice("abcdeé") for _ in range(dice.randrange(1, 7))) for _ in range(dice.choice([1, 2, 5, 8, 20, 60])))
        chars = list(line)
        for _ in range(dice.choice([0, 1, 2, len(line) // 20, len(line) // 17 + 1])):
            place, what = dice.randrange(len(chars) + 1), dice.randrange(3)
            chars[place : place + (what > 0)] = [dice.choice("ab ")] * (what < 2)
        rows.append((i, -i, line, "".join(chars)))
    pairs = spark.createDataFrame(rows, "a long, b long, t_a string, t_b string")
    most = F.floor(F.lit(0.05) * F.greatest(F.char_length("t_a"), F.char_length("t_b")))
    want = {r.a for r in pairs.where(F.levenshtein("t_a", "t_b") <= most).collect()}
    assert {r.a for r in fuzzy_lines._alike(pairs, 0.95).collect()} == want
    assert 0 < len(want) < 400


def test_large_buckets_lose_no_link(spark, tmp_path):
    """Lines of one bucket that differ from its pivot by what they lack, by own halves or by little: all links among them are found, and
    lines of a template aren't tried in pairs."""
    dice, lines = random.Random(21), []
    word = lambda: "".join(dice.choice("abcdefghiklmnoprstuw") for _ in range(6))
    whole = [word() for _ in range(60)]
    lines.append(" ".join(whole))
    for n in range(10, 50, 2):  # beginnings of the pivot: nothing in them is new
        lines += [" ".join(whole[:n]), " ".join(whole[:n])[:-3]]
    for _ in range(30):
        own = [word() for _ in range(30)]
        lines += [" ".join(whole[:30] + own), changed(dice, " ".join(whole[:30] + own), 12)]
    for _ in range(30):
        near = list(whole)
        for at in dice.sample(range(60), dice.choice([2, 3, 4, 5])):
            near[at] = word()
        lines.append(" ".join(near))
    spread = lambda a, b: fuzzy_lines._most(a, b, 0.95)
    df = spark.createDataFrame(list(enumerate(lines)), "k1 long, norm string")
    pairs = df.selectExpr("k1 AS a", "norm AS t_a").join(df.selectExpr("k1 AS b", "norm AS t_b"), F.expr("a < b"))
    due = {(r.a, r.b) for r in pairs.where(F.levenshtein("t_a", "t_b") <= spread(F.char_length("t_a"), F.char_length("t_b"))).select("a", "b").collect()}
    group = spark.createDataFrame([(0, i, i) for i in range(len(lines))], "p long, id long, component long")
    got = {(r.a, r.b) for r in fuzzy_lines._by_differences(group, df, 0.95).collect()}
    assert len(due) > 60 and due <= got and len(got) < 0.2 * len(lines) ** 2 / 2, (len(due), len(due - got), len(got))
    # through the operator: ten times the largest size of a bucket that is tried in pairs
    text = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    keep = {r.k1: r.keep for r in fuzzy_lines.duplicate_lines(text).collect()}
    norm = {r.k1: r.norm for r in fuzzy_lines._lines(text, "doc_id", "text").collect()}
    met = {norm[k] for k in keep}
    tails = [x for i in range(1, 41) if any(i in p for p in due) for x in [lines[i]]]
    assert tails and all(x in met for x in tails)


def test_lines_without_company_leave_no_grams_on_disk(spark, monkeypatch):
    """Of a large bucket's lines, those whose grams are their own take part in no join of grams; the links of the others stay. What one step
    shuffles is gone when its table is written."""
    dice, taken = random.Random(3), []
    word = lambda: "".join(dice.choice("abcdefghiklmnoprstuw") for _ in range(6))
    lines = [" ".join(word() for _ in range(40)) for _ in range(300)]
    lines += [changed(dice, x, 3) for x in lines[:10]]
    company = fuzzy_lines._with_company

    def counted(member):
        out = company(member)
        taken.append(out.count())
        return out

    monkeypatch.setattr(fuzzy_lines, "_with_company", counted)
    df = spark.createDataFrame(list(enumerate(lines)), "k1 long, norm string")
    group = spark.createDataFrame([(299, i, i) for i in range(len(lines))], "p long, id long, component long")
    got = {(r.a, r.b) for r in fuzzy_lines._by_differences(group, df, 0.95).collect()}
    assert {(i, 300 + i) for i in range(10)} <= got
    assert len(taken) == fuzzy_lines.PASSES and sum(taken) <= 30, taken


def test_written_tables_leave_no_shuffle_files(spark):
    """Spark numbers shuffles in turn: that of a written table has no files any more, that of a plain query still has."""
    def live():
        blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum("shuffle_" in blocks.apply(i).getName() for i in range(blocks.size()))

    before = live()
    written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if live() <= before:
            break
        time.sleep(0.1)
    assert live() <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_lines_that_fit_no_other_bring_no_grams(spark, monkeypatch):
    """Lines of a large bucket go before any text of theirs is read, if no line of another component there has nearly their length and letters."""
    dice, seen = random.Random(5), []
    word = lambda: "".join(dice.choice("abcdefghiklmnoprstuw") for _ in range(dice.randint(3, 12)))
    rows = [(i, " ".join([word() for _ in range(3)] + ["common", "triple", "here"] + [word() for _ in range(4)])) for i in range(120)]
    rows += [(200 + i, rows[i][1][:-1] + "Z") for i in range(8)]
    by = fuzzy_lines._by_differences
    monkeypatch.setattr(fuzzy_lines, "_by_differences", lambda group, *a: (seen.append(group.count()), by(group, *a))[1])
    got = fuzzy_lines.with_counts(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").collect()
    assert {r.doc.doc_id for r in got} == set(range(200, 208))
    assert sum(seen) <= 12, seen


@pytest.mark.parametrize("tried", [4096, 3])
def test_fitting_lines_against_all_pairs(spark, monkeypatch, tried):
    monkeypatch.setattr(fuzzy_lines, "TRIED", tried)
    dice, n = random.Random(7), len(fuzzy_lines.LETTERS)
    rows = []
    for i in range(400):
        base = random.Random(i % 130)
        letters = [base.randint(0, 5) for _ in range(n)]
        letters[i % n] += dice.randint(0, 6)
        rows.append((i % 3, i, dice.randint(0, 3) if i % 2 else i, sum(letters) + base.randint(20, 160), letters))
    rows += [(9, 1000 + i, i, length, [0] * n) for i, length in enumerate((100, 105, 95, 1, 2, 400, 421, 500))]

    def fit(a, b):
        most = int(round(0.05 * max(a[3], b[3]), 6))
        side = lambda x, y: sum(max(u - v, 0) for u, v in zip(x[4], y[4]))
        return a[0] == b[0] and a[2] != b[2] and abs(a[3] - b[3]) <= most and max(side(a, b), side(b, a)) <= most

    want = {(a[0], a[1], a[2]) for a in rows if any(fit(a, b) for b in rows)}
    got = [tuple(r) for r in fuzzy_lines._with_fitting(written(spark.createDataFrame(rows, "p long, id long, component long, len int, letters array<int>"), "group"), 0.95).collect()]
    assert len(got) == len(set(got)) and want <= set(got)
    assert 50 < len(want) < 350
    assert set(got) == want if tried > 400 else len(got) > len(want)


def test_rarest_grams_are_ordered_in_turns(spark, monkeypatch):
    """The grams of one turn's groups alone are on disk while the rarest ones are looked for."""
    dice, turns = random.Random(11), []
    lines = ["".join(dice.choice("abcdefghiklmnoprstuw ") for _ in range(200)).strip() for _ in range(6)]
    lines += [changed(dice, x, 3) for x in lines]
    in_turns = fuzzy_lines.written_in_turns
    monkeypatch.setattr(fuzzy_lines, "written_in_turns", lambda parts, *a: (turns.append(len(parts)), in_turns(parts, *a))[1])
    df = spark.createDataFrame(list(enumerate(lines)), "k1 long, norm string")
    group = spark.createDataFrame([(p, i, i) for p in (0, 1, 2) for i in range(len(lines))], "p long, id long, component long")
    got = {(r.a, r.b) for r in fuzzy_lines._by_differences(group, df, 0.95).collect()}
    assert {(i, 6 + i) for i in range(6)} <= got
    assert turns == [fuzzy_lines.PASSES] * 2
