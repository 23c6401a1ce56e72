"""Operators that look at one text at a time, against plain brute-force versions."""

import base64
import hashlib
import random
import re
import time

import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from acrelake.llm import bpe, license_scan, mcd, pii_crf, queries, secret_markov
from acrelake.llm.common import written

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [
    None, "", " ", "a", "😀 x +1 (736) 555-2678 y a@b.co 1.2.3.4 999.1.1.1 4041894974608795", "password = 'abcdefghijkl' Token:short secret: token = abcdefghijklmnop",
    "Mit License mit license General Public License", "x" * 3000 + " " + "1" * 3000 + "@" * 50, "AKIAABCDEFGHIJKLMN AKIA1 0123456789abcdef0 ü 0123456789abcde", "a b c a b c a b c\na b c\n\na b c\n" * 20,
    "// SPDX-License-Identifier: MIT OR (GPL-2.0-only AND x", "word  \t\n  word   \r\n" * 50, "1.2.3.4.5.6.7.8 +1+2+3 12345678901234 ++1 555 555 5555 0",
]


def texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    return rows + [(10_000 + i, t) for i, t in enumerate(ODD)]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("rowwise")
    rows = texts(spark)
    df = spark.createDataFrame([(i, t, "en" if i % 3 else None, f"src{i % 2}", "clash", 1) for i, t in rows], "doc_id long, text string, lang string, source string, spans string, n_words int")
    df.write.parquet(f"{where}/documents.parquet")
    return str(where), rows


def spans_of(pattern, text, fits):
    return [m.span() for m in re.finditer(pattern, text) if fits(m)]


def digest(kinds, found):
    flat = sorted((s, k, e) for k, spans in enumerate(found) for s, e in spans)
    return hashlib.sha256(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in flat).encode()).hexdigest()


def test_pii(spark, odd_dir):
    where, rows = odd_dir
    got = {r.doc_id: r for r in queries.op1_pii(spark, where).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        text = text or ""
        n = lambda m: len(re.findall("[0-9]", m[0]))
        found = [
            spans_of(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text, bool),
            spans_of(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text, lambda m: all(int(p) <= 255 for p in m[0].split("."))),
            spans_of(r"[0-9]([\x20-]?[0-9])+", text, lambda m: 14 <= n(m) <= 19 and pii_crf.luhn(re.sub("[^0-9]", "", m[0]))),
            spans_of(r"\+[0-9][\x20().0-9-]+[0-9]", text, lambda m: 10 <= n(m) <= 15),
        ]
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, found))
        assert r.base_sha256 == digest(pii_crf.KINDS, found)


def test_field_is_consistent_and_precise():
    model = pii_crf.trained()
    said = "call 555-123-4567 now, " + "plain words here " * 9 + "5551234567 end"
    assert {said[s:e] for s, e, _ in pii_crf.field_spans(said, [], model)} == {"555-123-4567", "5551234567"}
    assert not pii_crf.field_spans("on 2024-01-02 at 10:30 we paid 1234567 for order 99 page 12", [], model)
    right = wrong = missed = 0
    for tokens, labels in pii_crf._sentences(1234, 200):
        text, at = " ".join(tokens), 0
        found = pii_crf.base_spans(text)
        found = found + pii_crf.field_spans(text, found, model)
        for token, label in zip(tokens, labels):
            hit = any(s < at + len(token) and at < e for s, e, _ in found)
            right, wrong, missed = right + (hit and label > 0), wrong + (hit and not label), missed + (label > 0 and not hit)
            at += len(token) + 1
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_licenses(spark, odd_dir):
    where, rows = odd_dir
    got = {r.doc_id: r for r in queries.op2_licenses(spark, where).collect()}
    for i, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        hits, labels = [], set()
        for phrase, label in license_scan.BASE_PHRASES.items():
            p = phrase.split()
            at = [j for j in range(len(words)) if words[j : j + len(p)] == p]
            hits += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


@pytest.mark.parametrize("text,rpn", [("MIT", "MIT"), ("MIT OR Apache-2.0 AND BSD-3-Clause", "MIT Apache-2.0 BSD-3-Clause and or"), ("(MIT OR GPL-2.0+) AND ISC", "MIT GPL-2.0+ or ISC and"), ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT", "GPL-2.0 Classpath-exception-2.0 with MIT or")])
def test_shunting_yard(text, rpn):
    assert license_scan.parse_expression(text) == rpn.split()


@pytest.mark.parametrize("text", ["", "MIT OR", "(MIT", "MIT)", "MIT Apache-2.0", "AND", "MIT ? ISC", "see", "MIT WITH BSD-3-Clause", "Classpath-exception-2.0", "GPL-2.0 WITH MIT", "MIT OR unknown"])
def test_malformed_expressions(text):
    with pytest.raises(ValueError):
        license_scan.parse_expression(text)


def test_bpe(spark, odd_dir):
    where, rows = odd_dir
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in queries.op3_bpe(spark, where).collect()}
    for i, text in rows:
        ids = enc.encode_ordinary(text or "")
        r = got[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
    mixed = "It's 12  words,\n\n  and\tmore 's 'll  Ünder é x  y " * 40
    for size in (1, 3, 17, 100):
        assert bpe.encode_text(enc, mixed, size) == enc.encode_ordinary(mixed)
        assert "".join(bpe.pieces(mixed, size)) == mixed


def test_secrets(spark, odd_dir):
    where, rows = odd_dir
    got = {r.doc_id: r for r in queries.op4_secrets(spark, where).collect()}
    for i, text in rows:
        text = text or ""
        found = [
            spans_of(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, lambda m: len(m[2]) >= 12),
            spans_of(r"AKIA[A-Z0-9]+", text, lambda m: len(m[0]) >= 18),
            spans_of(r"[0-9a-f]+", text, lambda m: len(m[0]) >= 16),
        ]
        r = got[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(len, found))
        assert r.base_sha256 == digest(secret_markov.KINDS, found)


def test_markov_models_on_held_out_samples(spark):
    table = secret_markov.default_table()
    secrets, ordinary = secret_markov.labelled_samples(5, 2000)
    call = lambda s: (x := secret_markov.ratio(s, table)) >= secret_markov.LEAST_TOTAL and x >= secret_markov.LEAST_MEAN * (len(s) - 1)
    assert sum(map(call, secrets)) / len(secrets) > 0.95
    assert sum(map(call, ordinary)) / len(ordinary) < 0.01
    df = spark.createDataFrame([(1, "see x9Kf3QpLz7Vb2MnT8wRc4YdH and load_user_table_2020 or getOrderItemValue12 here")], "doc_id long, text string")
    spans = secret_markov.find_secrets(df).first().spans
    assert [(s.kind, s.start, s.end) for s in spans] == [("random", 4, 28)]


def test_random_strings_are_found_through_the_operator(spark):
    """Held-out strings of each kind between words, letters alone among them; identifiers and long words stay."""
    rng, letters = random.Random(77), secret_markov.ALPHABET
    kinds = {"lower": letters[:26], "upper": letters[26:52], "letters": letters[:52], "base62": letters[:62], "base64": letters[:64], "lower and digits": letters[:26] + letters[52:62]}
    rows = [(k, "see " + "".join(rng.choices(chars, k=20)) + " here") for k, chars in kinds.items() for _ in range(200)]
    rows += [("identifier", f"see {x} here") for x in secret_markov.labelled_samples(41, 500)[1]]
    rows += [("word", f"see {x} here") for x in ("internationalization", "Donaudampfschifffahrt", "incomprehensibilities", "desafortunadamente", "anticonstitutionnellement", "Rechtsschutzversicherung", "12345678901234567890")]
    found = secret_markov.find_secrets(spark.createDataFrame(rows, "doc_id string, text string"))
    share = {r.doc_id: r.s for r in found.groupBy("doc_id").agg(F.avg(F.exists("spans", lambda s: s["kind"] == "random").cast("int")).alias("s")).collect()}
    assert all(share[k] >= 0.97 for k in kinds), share
    assert share["identifier"] <= 0.01 and share["word"] == 0, share


def test_quality(spark, odd_dir):
    where, rows = odd_dir
    got = {r.doc_id: r for r in queries.op10_quality(spark, where).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[j : j + 3]) for j in range(len(words) - 2)]
        again = {j + k for j, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 3000 else None
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)))
        if again is not None:
            assert r.n_repeat_words == len(again)
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_outliers_keep_clean_rows_and_reject_far_ones(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    clean = rng.normal(size=(3000, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0], [0, 0, 0.5]])
    far = rng.normal(size=(300, 3)) * 0.3 + 12
    rows = [(float(a), float(b), float(c), "en", None, k) for k, part in enumerate((clean, far)) for a, b, c in part]
    df = spark.createDataFrame(rows, "x double, y double, z double, lang string, source string, bad int")
    out = mcd.robust_outliers(df, {"x": 0.1, "y": 0.1, "z": 0.1}, quantile=1 - 1e-5)
    counts = {(r.bad, r.outlier): r["count"] for r in out.groupBy("bad", "outlier").count().collect()}
    assert counts.get((1, True)) == 300 and counts.get((0, True), 0) <= 3


def test_outliers_small_groups_and_a_third_of_copies(spark):
    """Groups of one or two far rows are judged by all rows, small clean groups stay, and a third of far copies goes whole."""
    rng = random.Random(6)
    point = lambda *at: tuple(a + rng.gauss(0, 0.1) for a in at)
    rows = [("en", "big", 0, *point(0, 0, 0)) for _ in range(400)] + [("en", "big", 1, 2.0, 2.0, 2.0)] * 200
    rows += [("en", "spread", 0, *point(0, 0, 0)) for _ in range(400)] + [("en", "spread", 1, *point(3, 3, 3)) for _ in range(200)]
    rows += [("de", f"s{i}", 0, *point(0, 0, 0)) for i in range(30) for _ in range(5)]
    rows += [(None, "one", 1, 3.0, 3.0, 3.0)] + [("fr", "two", 1, 3.0, 3.0, 3.0)] * 2
    df = spark.createDataFrame(rows, "lang string, source string, bad int, x double, y double, z double")
    out = mcd.robust_outliers(df, {"x": 0.1, "y": 0.1, "z": 0.1}).groupBy("bad", "outlier").count().collect()
    assert {(r.bad, r.outlier): r["count"] for r in out} == {(0, False): 950, (1, True): 403}


def test_groups_of_mostly_short_texts_keep_their_proper_ones(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    proper = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows = [(i, proper(rng.randint(80, 300)), "en", "mixed") for i in range(100)] + [(1000 + i, "only four words here", "en", "mixed") for i in range(150)]
    rows += [(2000 + i, None, "en", "mixed") for i in range(50)] + [(3000 + i, "", "de", "none") for i in range(3)]
    got = mcd.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == len(rows)
    assert {r.doc_id for r in got if r.kept} == set(range(100))


def test_a_sample_fits_as_all_rows_do(spark):
    """A group of more rows than the sample: the verdicts are those of the whole group's estimate."""
    import numpy as np

    rng = np.random.default_rng(1)
    clean, far = rng.normal(size=(20_000, 2)), rng.normal(size=(8_000, 2)) * 0.2 + 9
    rows = [(float(a), float(b), "en", "s", k) for k, part in enumerate((clean, far)) for a, b in part]
    df = spark.createDataFrame(rows, "x double, y double, lang string, source string, bad int")
    for sample in (500, 10**6):
        out = mcd.robust_outliers(df, {"x": 0.1, "y": 0.1}, sample=sample).groupBy("bad", "outlier").count().collect()
        counts = {(r.bad, r.outlier): r["count"] for r in out}
        assert counts.get((1, False), 0) == 0 and counts.get((0, True), 0) <= 2


def test_estimates_use_every_row_of_a_large_group(spark):
    """Steps as aggregations reach the estimate that the whole group's steps in one task reach, which a sample's don't."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(5000, 2)) @ np.array([[1, 0.4], [0, 0.7]]), rng.normal(size=(1500, 2)) * 0.3 + 6])
    floors = np.array([0.1, 0.1])
    want = mcd.concentrate(x, len(x), floors, 0.5)
    df = written(spark.createDataFrame([("g", len(x), float(a), float(b)) for a, b in x], "k string, _rows long, x double, y double").repartition(7), "rows")
    got = mcd._stepped(df, ["k"], ["x", "y"], floors, 0.5, mcd.STEPS, None).collect()
    assert len(got) == 1
    assert np.allclose(got[0].center, want[0], atol=0.02) and np.allclose(np.array(got[0].scatter).reshape(2, 2), want[2], rtol=0.03, atol=0.02)
    few = mcd.concentrate(x[rng.permutation(len(x))[:300]], len(x), floors, 0.5)
    assert not np.allclose(few[2], want[2], rtol=0.03, atol=0.02)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("op1_pii", "op2_licenses", "op3_bpe", "op4_secrets", "op10_quality"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_secrets_in_very_long_texts(spark):
    """One token of a million characters, and many matches in one text, take seconds."""
    rng = random.Random(3)
    blob = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(1_000_000))
    many = " ".join(f"token=abcdefghijkl{i} Zq8Xv1Lm2Tk9Rw4Pj{i % 10}" for i in range(30_000))
    began = time.perf_counter()
    rows = secret_markov.find_secrets(spark.createDataFrame([(1, "x " + blob), (2, many)], "doc_id long, text string")).collect()
    assert time.perf_counter() - began < 60
    got = {r.doc_id: r for r in rows}
    assert [(s.start, s.end, s.kind) for s in got[1].spans] == [(2, 1_000_002, "random")]
    want = [(m.start(), m.end()) for m in re.finditer(r"token=\w+", many)]
    assert [(s.start, s.end) for s in got[2].base] == want
    more = [(s.start, s.end) for s in got[2].spans if s.kind == "random"]
    assert set(more) <= {m.span() for m in re.finditer(r"Zq\w+", many)} and len(more) > 25_000


def test_skip_links_join_similar_tokens():
    link = lambda text: pii_crf.skip_links(text.split())
    assert link("jane@mail.org and then jane(at)mail(dot)org") == [(0, 3)]
    assert link("555-123-4567 or later +15551234567") == [(0, 3)]
    assert link("555-123-4567 then 555 123 4567") == [(0, 2), (0, 3), (0, 4)]
    assert link("word another word") == [] and link("12 and 12") == []


def test_field_carries_a_kind_to_where_there_is_no_context():
    """Sentences written by hand, not by the training generator."""
    model = pii_crf.trained()

    def found(text):
        return {(text[s:e], k) for s, e, k in pii_crf.field_spans(text, pii_crf.base_spans(text), model)}

    first = "Please call 555-123-4567 after noon. The clerk wrote it down twice, and the slip that was left on the desk reads 555 123 4567 only."
    assert {t for t, k in found(first) if k == "phone"} == {"555-123-4567", "555 123 4567"}
    assert ("ann.smith(at)example.org", "email") in found("You can write to ann.smith(at)example.org if the office is closed.")
    assert found("In 2019 we counted 48 herons, 112 ducks and 7 swans on page 88 of the ledger.") == set()


@pytest.mark.parametrize(
    "line, labels",
    [
        ("MIT.", ["mit", "permissive"]), ("MIT, see LICENSE", ["mit", "permissive"]), ("GPL-3.0-or-later applies", ["copyleft", "gpl-3.0-or-later"]),
        ("GPL-2.0 WITH Classpath-exception-2.0", ["gpl-2.0", "weak-copyleft"]), ("MIT OR GPL-2.0 AND LGPL-2.1", ["gpl-2.0", "lgpl-2.1", "mit", "permissive"]),
        ("(MIT OR GPL-2.0) AND Foo-1", ["gpl-2.0", "mit", "permissive"]),
        ("see the LICENSE file", ["expression-invalid"]), ("MIT WITH BSD-3-Clause", ["mit", "permissive"]), ("GPL-2.0+ AND LicenseRef-own.1", ["gpl-2.0+", "licenseref-own.1", "restricted"]),
        ("DocumentRef-x:LicenseRef-y", ["documentref-x:licenseref-y", "restricted"]), ("Apache-2.0 WITH LLVM-exception */", ["apache-2.0", "permissive"]), (", none", ["expression-invalid"]), ("(" * 50_000, ["expression-invalid"]),
    ],
)
def test_tag_lines(line, labels):
    got = license_scan.scan_text(f"// SPDX-License-Identifier: {line}\nint x;")
    assert got["labels"] == labels and got["score"] == (0.0 if labels == ["expression-invalid"] else 1.0)
