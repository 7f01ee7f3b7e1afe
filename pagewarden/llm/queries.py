"""Registered queries of the corpus operators: thin digests of their whole output."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewarden.llm import (
    bpe_automaton, disclosure_pii, hilbert_negatives, line_spread, phrase_fingerprint, prefix_trie, quality_qda,
    segment_language, simhash_tiles, site_template, template_leaks, url_language, warc,
)
from pagewarden.llm.common import materialize, read

URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
VOCABULARY = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def held_out(doc_id="doc_id"):
    """Rows whose labels no model may see."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_template.extract(read(spark, sf_dir, "pages"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_language.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive(read(spark, sf_dir, "pages"))
    responses = warc.pushed(spark, folder, "warc_type = 'response'").select(
        "page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), F.col("warc_type").alias("record_type"), "refers_to")
    revisits = warc.pushed(spark, folder, "warc_type = 'revisit'", payload=False).select(
        "page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest",
        F.col("warc_type").alias("record_type"), "refers_to")
    return responses.unionByName(revisits)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(quality_qda.with_statistics(read(spark, sf_dir, "documents")), "quality-stats")
    model = quality_qda.fit(stats, read(spark, sf_dir, "labels").where(~held_out()))
    return quality_qda.score_statistics(stats, model).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= quality_qda.CUT).cast("int").alias("predicted"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_leaks.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_hash")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_tiles.near_duplicates(read(spark, sf_dir, "documents"), words=4, radius=4).select(
        "doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.token_digests(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = F.coalesce("clean", F.lit(""))
    return line_spread.without_repeated_lines(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.length(clean).cast("bigint").alias("clean_chars"),
        F.sha2(clean, 256).alias("clean_sha256"))


OP8_SQL = f"""
WITH pieces AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents),
spread AS (
  SELECT trim(raw) AS line FROM pieces WHERE trim(raw) <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= {line_spread.MIN_SITES}),
marked AS (
  SELECT doc_id, raw, place, line IS NOT NULL AS hit
  FROM pieces LEFT JOIN spread ON trim(raw) = line),
sums AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (hit) AS n_hit,
         sum(length(raw)) AS all_chars, coalesce(sum(length(raw)) FILTER (NOT hit), 0) AS kept_chars,
         coalesce(string_agg(raw, chr(10) ORDER BY place) FILTER (NOT hit), '') AS kept
  FROM marked GROUP BY doc_id),
done AS (
  SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines,
         n_lines IS NULL OR kept_chars < {1 - line_spread.MAX_SHARE} * all_chars AS whole,
         n_hit, kept, coalesce(text, '') AS text
  FROM documents d LEFT JOIN sums USING (doc_id))
SELECT doc_id, n_lines::BIGINT AS n_lines,
       (CASE WHEN whole THEN 0 ELSE n_hit END)::BIGINT AS n_removed,
       length(CASE WHEN whole THEN text ELSE kept END)::BIGINT AS clean_chars,
       sha256(CASE WHEN whole THEN text ELSE kept END) AS clean_sha256
FROM done
"""


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure_pii.find_spans(read(spark, sf_dir, "documents")).select(
        "doc_id", *[f"n_{k}" for k in disclosure_pii.KINDS], "base_sha256", "spans")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_fingerprint.edit_likeness(read(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_negatives.hard_negatives(read(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, list_inner_product(a.q, c.q)::BIGINT AS score
  FROM vectors a JOIN vectors c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scores s USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
WHERE rank <= 3
"""


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    apart = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = segment_language.fit(docs.where(~apart), segment_language.pieces(public_tokenizers.path(PIECES)))
    return segment_language.languages(docs, model).select(
        "doc_id", apart.alias("held_out"), "lang_pred", "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


# The CRC of a conv_id's digits is worked out bit by bit (3988292384 is the reversed polynomial).
OP13_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         (xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT),
              lambda crc, byte: list_reduce(range(8)::UBIGINT[], lambda c, i:
                CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, xor(crc, byte)),
              4294967295::UBIGINT), 4294967295::UBIGINT) % 9)::BIGINT AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND pos <= h
  UNION ALL
  SELECT c.conv_id, 1, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos > h),
ordered AS (
  SELECT conv_id, row_number() OVER w AS depth, octet_length(encode(text)) AS bytes,
         md5(octet_length(encode(role)) || ':' || role || text) AS name
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
lists AS (
  SELECT c.conv_id, coalesce(names, []) AS names, coalesce(sizes, []) AS sizes
  FROM convs c LEFT JOIN (SELECT conv_id, list(name ORDER BY depth) AS names, list(bytes ORDER BY depth) AS sizes
                          FROM ordered GROUP BY 1) l USING (conv_id)),
paths AS (
  SELECT conv_id, depth, md5(array_to_string(names[1:depth], ',')) AS node,
         md5(array_to_string(names[1:depth - 1], ',')) AS up,
         CASE WHEN depth = 0 THEN 0 ELSE sizes[depth] END AS bytes, depth = len(names) AS is_end
  FROM (SELECT *, unnest(range(len(names) + 1)) AS depth FROM lists)),
nodes AS (
  SELECT depth, node, min(conv_id) AS conv_id, min(up) AS up, min(bytes) AS bytes, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM paths GROUP BY depth, node),
children AS (SELECT depth - 1 AS depth, up AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
counted AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (depth, node)),
sums AS (
  SELECT p.depth, p.node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * c.bytes) AS saved
  FROM counted c JOIN paths p ON p.conv_id = c.conv_id AND p.depth <= c.depth GROUP BY 1, 2)
SELECT c.conv_id, c.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves,
       saved::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums USING (depth, node)
LEFT JOIN nodes above ON above.depth = c.depth - 1 AND above.node = c.up AND c.depth > 0
"""


# Operators that SQL cannot express have none; tests/llm holds them against brute force.
Q = {
    "op1_main_text": (op1, None),
    "op2_url_verdict": (op2, None),
    "op3_warc_records": (op3, None),
    "op4_quality_scores": (op4, None),
    "op5_benchmark_leaks": (op5, None),
    "op6_simhash_components": (op6, None),
    "op7_bpe_digests": (op7, None),
    "op8_line_spread": (op8, OP8_SQL),
    "op9_personal_data": (op9, None),
    "op10_phrase_fingerprints": (op10, None),
    "op11_hard_negatives": (op11, OP11_SQL),
    "op12_language": (op12, None),
    "op13_prefix_trie": (op13, OP13_SQL),
}
