"""The registered queries of this subpackage: every operator over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from mktpulse.llm import (
    cdc_dedup,
    conversation_repair,
    cover_tree,
    importance,
    line_dedup,
    lm_scoring,
    lsh_forest,
    mixing,
    ngram_resample,
    sentencepiece_bpe,
    token_files,
    warc,
    winnowing,
)
from mktpulse.llm.common import read_table


def op1_winnowing(spark, sf_dir):
    return winnowing.fingerprint_edits(read_table(spark, sf_dir, "documents"))


def op2_warc(spark, sf_dir):
    return warc.round_trip(spark, read_table(spark, sf_dir, "pages"))


def op3_jaccard_join(spark, sf_dir):
    return lsh_forest.jaccard_classes(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "text_id", "copies", "links")


def op4_token_files(spark, sf_dir):
    return token_files.token_files(spark, read_table(spark, sf_dir, "documents"))


def op5_cross_entropy(spark, sf_dir):
    return lm_scoring.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_importance(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return importance.resample(docs, labels).select("doc_id", "log_weight", "key", "kept")


def op7_sentencepiece(spark, sf_dir):
    return sentencepiece_bpe.token_digests(read_table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    return mixing.Mixture(read_table(spark, sf_dir, "documents")).taken()


def op9_substring_dedup(spark, sf_dir):
    """Per document: length before, characters and passages removed, and what is left of the text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    d = cdc_dedup.dedup_substrings(docs)
    left = F.length(F.coalesce("text", F.lit("")))
    return d.select("doc_id", F.col("_before").alias("n_chars"), (F.col("_before") - left).alias("removed_chars"),
                    F.size("_removed").cast("bigint").alias("removed_passages"), "text")


def op10_cover_tree(spark, sf_dir):
    return cover_tree.top_k(read_table(spark, sf_dir, "embeddings"), F.col("_id") % 50 == 0)


def op11_resampling(spark, sf_dir):
    docs, target = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return ngram_resample.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


def op12_line_dedup(spark, sf_dir):
    d = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("_n_lines").cast("bigint").alias("n_lines"), F.col("_n_dropped").cast("bigint").alias("n_dropped"),
                    F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op13_conversation_repair(spark, sf_dir):
    rows = conversation_repair.damaged(read_table(spark, sf_dir, "conversations"))
    return conversation_repair.repaired(conversation_repair.judged(rows))


QUERIES = {
    "op1_winnowing": op1_winnowing,
    "op2_warc": op2_warc,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_token_files": op4_token_files,
    "op5_cross_entropy": op5_cross_entropy,
    "op6_importance": op6_importance,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_mixing": op8_mixing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_cover_tree": op10_cover_tree,
    "op11_resampling": op11_resampling,
    "op12_line_dedup": op12_line_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}

#: The other operators rest on hashes, tokenizers or models that SQL does not have; their tests compare with brute force.
ORACLE_SQL: dict[str, str] = {
    "op11_resampling": """
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) AS t
  FROM range(256) AS r(b)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, lower_ascii AS words FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS lower_ascii FROM documents)
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark
), dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(words) AS w FROM d) GROUP BY r, w
), bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM b) GROUP BY w
), v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)
), k AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2),
      lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM v, crc_table
), s AS (SELECT bucket, sum(n) AS n FROM dw JOIN k USING (w) GROUP BY bucket
), t AS (SELECT bucket, sum(n) AS n FROM bw JOIN k USING (w) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000)
    / ((s.n::DOUBLE + 1) * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), w AS (
  SELECT r, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM dw JOIN k USING (w) JOIN gain USING (bucket) GROUP BY r
), scored AS (
  SELECT r, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN w USING (r)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS p,
    count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND p <= 10 * n // 100 THEN p END::BIGINT AS rank FROM placed""",
    "op12_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT r, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d)
), bad AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), kept AS (
  SELECT r, count(bad.key) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (bad.key IS NULL) AS text
  FROM l LEFT JOIN bad USING (key) GROUP BY r
)
SELECT doc_id, len(lines)::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d JOIN kept USING (r)""",
    "op10_cover_tree": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5""",
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT p.page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN p.page_id IS DISTINCT FROM f.first AND f.first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM p JOIN f USING (html) JOIN (
  SELECT html, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((
           strpos('0123456789abcdef', substr(h, 1 + (5 * i) // 4, 1)) - 1) * 16 +
           strpos('0123456789abcdef', substr(h || '0', 2 + (5 * i) // 4, 1)) - 1) // (2 ** (3 - (5 * i) % 4))::BIGINT) % 32, 1), '' ORDER BY i) AS digest
  FROM (SELECT html, sha1(html) AS h FROM f) CROSS JOIN range(32) AS r(i) GROUP BY html
) d USING (html)""",
}
