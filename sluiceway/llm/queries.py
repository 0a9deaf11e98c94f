"""The registered queries of this package and, where SQL can say it, the same in SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, best_fit, bpe, divergence, exact_dedup, jaccard, language, license_scan, line_dedup, packing, quality, token_count, vector_codes
from .common import table

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.predict(docs, docs, table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_groups(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, docs).select("doc_id", "held_out", "lang_pred", "score")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "passage", "kind", "license", "dice", F.md5("text").alias("text_md5"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    digest = F.lit(vector_codes.codebooks_sha256(out.codebooks)).alias("codebooks_sha256")
    return vector_codes.label_errors(out.codes).select("vec_id", vector_codes.hex_code().alias("code"), "error", "label_error", digest)


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = best_fit.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pack, op2_bpe, op3_ann, op4_quality, op5_token_counts, op6_ngram_jaccard, op7_line_dedup, op8_language, op9_exact_dedup, op10_licenses,
        op11_vector_codes, op12_best_fit, op13_divergence,
    )
}


def _vector_codes_sql(scale: int = vector_codes.SCALE, parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """The rounds one after the other, each with its own codebook ``b`` and nearest entries ``a``."""

    def nearest(k: int) -> str:
        return f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, label, part, v, d[1] AS far, d[2] AS entry FROM (
    SELECT x.vec_id, x.label, x.part, any_value(x.v) AS v,
           min([list_sum(list_transform(list_zip(x.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, b.entry]) AS d
    FROM x JOIN b{k} b USING (part) GROUP BY x.r, x.vec_id, x.label, x.part))"""

    def moved(k: int) -> str:
        return f"""
m{k} AS (
  SELECT part, entry, list(q ORDER BY i) AS c FROM (
    SELECT part, entry, i, CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END::BIGINT AS q FROM (
      SELECT part, entry, i, sum(v[i]) AS s, count(*) AS n
      FROM a{k - 1}, (SELECT unnest(range(1, (SELECT max(len(v)) FROM x) + 1)) AS i) GROUP BY part, entry, i)) GROUP BY part, entry),
b{k} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{k - 1} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry)"""

    steps = ",".join(nearest(k) if k == 0 else f"{moved(k)},{nearest(k)}" for k in range(rounds + 1))
    return f"""
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda t: floor({scale} * t::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda t: t IS NULL OR NOT isfinite(t))) = 0),
x AS MATERIALIZED (
  SELECT r, vec_id, label, part::BIGINT AS part, list_slice(v, part * len(v) // {parts} + 1, (part + 1) * len(v) // {parts}) AS v
  FROM e, (SELECT unnest(range({parts})) AS part)),
b0 AS MATERIALIZED (
  SELECT part, entry, v AS c FROM (
    SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id, r) - 1 AS entry FROM x) WHERE entry < {entries}),{steps},
w AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
o AS (
  SELECT vec_id, label, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error
  FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o, w
"""

ORACLES = {
    "op11_vector_codes": _vector_codes_sql(),
    "op13_divergence": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(terms) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n)::BIGINT AS n FROM t GROUP BY ALL HAVING count(*) >= {divergence.MIN_DOCS}),
l AS MATERIALIZED (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, sum(t.n)::BIGINT AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
s AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce((SELECT sum(c.n) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0)::BIGINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN l USING (lang)),
p AS MATERIALIZED (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + s.v) AS p
  FROM s JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
q AS (SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q FROM k JOIN l USING (lang)),
terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q) // q)::BIGINT AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p > q),
u AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}
""",
    "op7_line_dedup": rf"""
WITH p AS (
  SELECT row_number() OVER () AS i, page_id,
         lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         list_filter(list_transform(string_split(
           regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
             '<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<head\b.*?</head\s*>', chr(10), 'gis'),
             '</?(p|div|li|ul|ol|h[1-6]|br|tr|table|nav|article|section|header|footer|title|body|html)\b[^>]*>', chr(10), 'gi'),
             '<[^>]*>', '', 'gs'), chr(10)),
           lambda s: trim(regexp_replace(s, '[\x20\x09\x0B-\x0D]+', ' ', 'g'))), lambda s: s <> '') AS lines
  FROM pages),
l AS (SELECT DISTINCT i, host, unnest(lines) AS line FROM p),
c AS (SELECT host, line, count(*) AS n FROM l GROUP BY ALL),
h AS (SELECT host, count(*) AS pages FROM p GROUP BY ALL),
bad AS (SELECT i, list(line) AS bad FROM l JOIN c USING (host, line) JOIN h USING (host)
        WHERE n >= {line_dedup.MIN_PAGES} AND n > pages * {line_dedup.RATIO} GROUP BY i),
k AS (SELECT page_id, host, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda s: NOT list_contains(bad, s)) END AS kept
      FROM p LEFT JOIN bad USING (i))
SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped, md5(array_to_string(kept, chr(10))) AS text_md5 FROM k
""",
    "op9_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS flat
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY flat ORDER BY points DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY flat) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(flat) AS text_sha256 FROM g
""",
}
