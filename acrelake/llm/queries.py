"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acrelake.llm import bpe, brown_classes, collinear, divergence, fim_units, fuzzy_lines, license_scan, mcd, minhash_tensor, pii_crf, secret_markov, separator_scan, winnow
from acrelake.llm.common import scratch_path, sha256_joined, table

RANKS = "byte_bpe_50k.tiktoken"


def _kind_count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _listed(spans: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_crf.find_pii(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[_kind_count("base", k) for k in pii_crf.KINDS], sha256_joined(_listed("base")).alias("base_sha256"), F.array_join(_listed("spans"), ",").alias("spans"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = public_tokenizers.path(RANKS)
    ids = bpe.encode(table(spark, sf_dir, "documents"), where, public_tokenizers.PATTERN)
    out = bpe.decode(ids, where, public_tokenizers.PATTERN)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_markov.find_secrets(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[_kind_count("base", k) for k in secret_markov.KINDS], sha256_joined(_listed("base")).alias("base_sha256"), F.array_join(_listed("spans"), ",").alias("spans"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash_tensor.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as flat token files in the shared folder, and their token counts by scanning those."""
    ids = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    out = separator_scan.count_tokens(ids, scratch_path(spark, "flat"), separator=50_256)
    return out.select("doc_id", "n_tokens")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha256_joined(F.col("items")).alias("items_sha256"), winnow.contaminated().alias("contaminated"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collinear.shared_passages(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fuzzy_lines.with_counts(table(spark, sf_dir, "documents"))
    return out.select("doc.doc_id", "n_lines", "n_removed", F.sha2("doc.text", 256).alias("text_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mcd.quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = brown_classes.class_scores(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim_units.fill_in_middle(table(spark, sf_dir, "documents"))
    chars = lambda part: F.char_length(part).cast("long").alias(f"{part}_chars")
    again = fim_units.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", chars("prefix"), chars("middle"), F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_licenses": op2_licenses,
    "op3_bpe": op3_bpe,
    "op4_secrets": op4_secrets,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_token_counts": op6_token_counts,
    "op7_decontamination": op7_decontamination,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality": op10_quality,
    "op11_class_scores": op11_class_scores,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_divergence": op13_divergence,
}

#: Exact: all pairs that share a shingle, then the closure of the links.
OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
c AS (SELECT s, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0) GROUP BY s),
e AS (SELECT rep, len(s) AS n, unnest(s) AS sh FROM c),
l AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.sh = b.sh AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT rep AS v, rep AS root FROM c UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.v),
m AS (SELECT v, min(root) AS component_id FROM r GROUP BY v)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(m.component_id, s.doc_id) AS kept
FROM s LEFT JOIN c ON list_sort(s.s) = c.s AND len(s.s) > 0 LEFT JOIN m ON m.v = c.rep
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i : i + least(13, len(w)) - 1], ' '))) AS t FROM b WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS t FROM d, ns WHERE len(w) >= n),
m AS (SELECT DISTINCT dw.doc_id, dw.n, dw.s, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.t = bw.t),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list_distinct(list(item_id::VARCHAR))) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
r AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, [('0x' || h[8 * i + 1 : 8 * i + 8])::BIGINT FOR i IN range(4)] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(u[1 : a], ''), '') AS pre, coalesce(array_to_string(u[a + 1 : b], ''), '') AS mid, coalesce(array_to_string(u[b + 1 : n], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN len(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

#: Every pair of groups over all kept terms, on whole numbers of 128 bits.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT row, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT row) AS df FROM o GROUP BY ALL),
k AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM c GROUP BY ALL HAVING sum(df) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM k GROUP BY lang),
q AS (SELECT k.lang, term, 1 + (1000000000 * (k.c + 2)) // (n + 2 * v) AS q FROM k JOIN v USING (lang)),
n AS (SELECT g.lang, g.source, coalesce(sum(c.c), 0)::HUGEINT AS n FROM g LEFT JOIN (c JOIN k USING (lang, term)) c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0)::HUGEINT + 2)) // (n.n + 2 * v) AS p
  FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op5_near_duplicates": OP5_SQL, "op7_decontamination": OP7_SQL, "op12_fill_in_middle": OP12_SQL, "op13_divergence": OP13_SQL}
