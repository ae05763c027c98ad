"""The queries of the training-data operators, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import shared_dir, table
from .centroid_clustering import cluster_report, delta_lloyd
from .decontamination import decontaminate
from .filter_audit import filter_audit
from .html_extraction import extract_pages
from .jaccard_join import jaccard_classes
from .license_scan import license_scan
from .lm_scoring import score_documents
from .quality_rules import quality_rules
from .sentencepiece_codec import encode_pieces
from .source_mixing import mix_documents
from .substring_dedup import dedup_substrings
from .token_counts import count_tokens
from .token_files import read_token_files, write_token_files


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return dedup_substrings(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    docs = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontaminate(docs, items)
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    manifest = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=2)
    return read_token_files(spark, manifest, folder)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    ruled = quality_rules(docs)
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_line_words", "base_failed", "kept")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=False, digests=True).drop("text")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(*delta_lloyd(table(spark, sf_dir, "embeddings", "vec_id", "embedding")))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mix_documents(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return filter_audit(docs, labels)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_html_extraction": op3_html_extraction,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_token_counts": op5_token_counts,
        "op6_decontamination": op6_decontamination,
        "op7_token_files": op7_token_files,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_quality_rules": op9_quality_rules,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_source_mixing": op12_source_mixing,
        "op13_filter_audit": op13_filter_audit,
    }


WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM x) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM hit)),
per AS (SELECT doc_id, list(p) AS p FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(p), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda v, k: NOT list_contains(p, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)
"""

OP4 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m, count(*) AS k FROM u a JOIN u b ON a.h = b.h AND a.doc_id <> b.doc_id
  AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY ALL),
link AS (SELECT a, b FROM pairs WHERE 100 * k >= 80 * (n + m - k)),
reach AS (SELECT a AS doc_id, a AS r FROM link UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.r = link.a)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, coalesce(c, s.doc_id) AS component_id
FROM s LEFT JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) USING (doc_id)
"""

OP6 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS v FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(v), 10) AS n, array_to_string(v[i:i + least(len(v), 10) - 1], ' ') AS s
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(v) - 9, 1) + 1)) AS i) WHERE len(v) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM w, lens, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
hit AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

# The rules as quality_rules.py has them: 5 repeated words, 10 words, 20 %, 20 documents, a fifth of the words.
OP9 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS l FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM
  (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM g) WHERE k > 1) GROUP BY doc_id),
b AS (SELECT d.doc_id, source, l, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)),
x AS (SELECT doc_id, source, array_to_string(regexp_extract_all({LOWER.format("s")}, '{WORD}'), ' ') AS s FROM (SELECT doc_id, source, unnest(l) AS s FROM d)),
lines AS (SELECT doc_id, source, s, sum(len(string_split(s, ' '))) AS n FROM x WHERE s <> '' GROUP BY ALL),
often AS (SELECT source, s, min(doc_id) AS first FROM lines GROUP BY ALL HAVING count(*) > 20),
gone AS (SELECT doc_id, sum(n) AS n FROM lines JOIN often ON lines.s = often.s AND lines.source IS NOT DISTINCT FROM often.source WHERE doc_id <> first GROUP BY doc_id),
r AS (SELECT b.*, coalesce(n, 0) AS n_line_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_line_words::BIGINT AS n_line_words, base_failed,
  NOT base_failed AND NOT (n_words - n_line_words < 0.2 * n_words) AS kept
FROM r
"""

# Plain Lloyd: every round compares every vector with every centroid.
_START = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS j, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM e ORDER BY h NULLS LAST, v LIMIT 16))"""
_ROUND = """,
a{i} AS MATERIALIZED (SELECT r, vec_id, v, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT r, vec_id, v, j, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM e, c{i}) GROUP BY r, vec_id, v)"""
_MEANS = """,
m{i} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY p) AS c FROM (SELECT j, p, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, unnest(range(64)) AS p FROM a{i}) GROUP BY j, p) GROUP BY j),
c{next} AS MATERIALIZED (SELECT c{i}.j, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (j))"""
OP11 = (
    _START
    + "".join(_ROUND.format(i=i) + _MEANS.format(i=i, next=i + 1) for i in range(3))
    + _ROUND.format(i=3)
    + """
SELECT vec_id, j::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (j)
"""
)

# Whole words of each target, read from the shuffled documents over and over: whole epochs, then a start of one.
OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
  md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
f AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total, coalesce(sum(3 * source_size) OVER o, 0) AS full_before,
  sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS w_from FROM s WINDOW o AS (ORDER BY 3 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, (total - full_before) * w > cap * w_from AS capped FROM f),
k AS (SELECT *, total - coalesce(sum(cap) FILTER (capped) OVER (), 0) AS rest, sum(w) FILTER (NOT capped) OVER () AS free FROM g),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (rest * w)::DOUBLE / free END AS target,
  CASE WHEN capped THEN cap ELSE rest * w // free END AS quota FROM k),
p AS (SELECT d.*, source_size, target, quota, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0
  ELSE (quota // source_size * size + greatest(0, least(size, quota % source_size - start)))::BIGINT END AS taken
FROM p
"""

# Every order and step counts the masks of its part anew.
OP13 = rf"""
WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
  + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
  + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT v.f || w.f || x.f || y.f || z.f AS o FROM f v, f w, f x, f y, f z WHERE v.b + w.b + x.b + y.b + z.b = 31 AND (v.b | w.b | x.b | y.b | z.b) = 31),
st AS (SELECT o AS filter_order, f AS filter, step, b, (SELECT coalesce(sum(g.b), 0) FROM f g WHERE position(g.f IN o) < step)::INT AS before
  FROM o, f, LATERAL (SELECT position(f IN o)::INT AS step)),
r AS (SELECT part, filter_order, filter, step, coalesce(sum(n) FILTER (mask & (before | b) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & before = 0 AND mask & b <> 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & before <> 0 AND mask & b <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = b), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & before = 0 AND mask & b <> 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & b <> 0), 0)::BIGINT AS toxic_lost FROM c, st GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": OP2,
        "op4_jaccard_join": OP4,
        "op6_decontamination": OP6,
        "op9_quality_rules": OP9,
        "op11_centroid_clustering": OP11,
        "op12_source_mixing": OP12,
        "op13_filter_audit": OP13,
    }
