"""One query for each operator, over its whole table, with production parameters; and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontam, fim, importance, linededup, lm, ngram_join, sharding, topk, toxicity, warc
from .common import table

BPE_VOCABULARY = "byte_bpe_50k.json"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law (bytes), shard, slot, grown_shard."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), n_shards=40)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the five nearest found of every fiftieth vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_VOCABULARY))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return decontam.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, class_id, n_links."""
    return ngram_join.join_similar(table(spark, sf_dir, "documents"))[2]


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, n_lines, n_kept, n_equal, n_near."""
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows for each page: its metadata and conversion records, the blocks as digests and lengths."""
    made = warc.derive(warc.responses_of_pages(table(spark, sf_dir, "pages")))
    return made.select(F.col("source_id").alias("page_id"), "record_type", "record_id", "refers_to", "target_uri", "content_type", "payload_digest", "block_digest", F.octet_length("block").alias("content_length"), F.sha2("record", 256).alias("record_sha256"))


def op7_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each call or orphan result in the conversations, the canonical JSON as a digest."""
    calls, results = chat.calls_of_turns(table(spark, sf_dir, "conversations"))
    return chat.link(calls, results, chat.REPLY_SCHEMA).select("conv_id", "call_id", "status", "level", "valid", F.sha2("linked_json", 256).alias("json_sha256"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: how it was cut, the output and the text restored from it as digests."""
    cut = fim.transform(table(spark, sf_dir, "documents"), unit="line", seed=7, fim_percent=100, spm_percent=50)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, n_features, weight, score, rank (null: not drawn); the target is the benchmark."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), most=1, buckets=10_000, seed=2024, least_words=20, percent=10)


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the ten highest integer inner products of every hundredth vector with all others."""
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_nearest_neighbours, op3_bpe, op4_line_dedup, op5_decontamination, op6_warc_derivatives, op7_tool_calls, op8_lm_scoring, op9_toxicity, op10_ngram_join, op11_fill_in_middle, op12_importance_resampling, op13_exact_topk)}

_LINES = f"""
WITH line AS (SELECT doc_id, pos, trim(parts[pos]) AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE doc_id IS NOT NULL))),
placed AS (SELECT doc_id, pos, line, length(line) AS n, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS nth FROM line WHERE length(line) >= {linededup.MIN_CHARS}),
known AS (SELECT line, n, doc_id AS first, pos AS place, CASE WHEN n < {linededup.LONG} THEN 1 ELSE 2 END AS edits, n // CASE WHEN n < {linededup.LONG} THEN 2 ELSE 3 END AS part FROM placed WHERE nth = 1),
pair AS (SELECT a.line AS p, b.line AS q, a.first AS fp, b.first AS fq, a.place AS pp, b.place AS pq FROM known a JOIN known b ON b.n BETWEEN a.n AND a.n + a.edits AND a.line <> b.line
  AND (left(a.line, a.part) = left(b.line, a.part) OR right(a.line, a.n - a.edits * a.part) = right(b.line, a.n - a.edits * a.part) OR (a.edits = 2 AND contains(substr(b.line, a.part - 2, a.part + 8), substr(a.line, a.part + 1, a.part))))
  WHERE levenshtein(a.line, b.line) <= a.edits),
late AS (SELECT DISTINCT CASE WHEN (fp, pp, p) < (fq, pq, q) THEN q ELSE p END AS line FROM pair),
lost AS (SELECT doc_id, count(*) FILTER (nth > 1) AS n_equal, count(*) FILTER (nth = 1 AND t.line IS NOT NULL) AS n_near FROM placed p LEFT JOIN late t ON t.line = p.line WHERE nth > 1 OR t.line IS NOT NULL GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n_lines FROM line GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, (coalesce(n_lines, 0) - coalesce(n_equal, 0) - coalesce(n_near, 0))::BIGINT AS n_kept, coalesce(n_equal, 0)::BIGINT AS n_equal, coalesce(n_near, 0)::BIGINT AS n_near
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN counted USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

_CALLS = """
WITH turns AS (SELECT conv_id, turn, text, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM conversations WHERE role = 'user'),
call AS (SELECT conv_id, conv_id || '-' || turn AS call_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS depth FROM turns),
result AS (SELECT conv_id, conv_id || '-' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant')
SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id,
  CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  (2 * c.depth)::INTEGER AS level,
  c.call_id IS NOT NULL AND length(c.text) BETWEEN 1 AND 400 AS valid,
  sha256('{' || CASE WHEN c.call_id IS NULL THEN '' ELSE '"arguments":{"text":' || to_json(c.text)::VARCHAR || ',"turn":' || c.turn || '},' END || '"id":"' || coalesce(c.call_id, r.call_id) || '"'
    || CASE WHEN c.call_id IS NULL THEN '' ELSE ',"name":"reply"' END || CASE WHEN r.call_id IS NULL THEN '' ELSE ',"result":' || to_json(r.text)::VARCHAR END || '}') AS json_sha256
FROM call c FULL OUTER JOIN result r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
"""

_MIDDLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS unit, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT doc_id, text, unit, len(unit) AS n, [('0x' || substr(h, k * 8 - 7, 8))::BIGINT FOR k IN [1, 2, 3, 4]] AS h FROM t),
placed AS (SELECT doc_id, text, unit, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
piece AS (SELECT doc_id, text, n, form, array_to_string(unit[1:a], '') AS p, array_to_string(unit[a + 1:b], '') AS m, array_to_string(unit[b + 1:], '') AS s FROM placed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM piece
"""

_TOP = """
WITH fine AS (SELECT vec_id::BIGINT AS vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pair AS (SELECT DISTINCT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pair)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

#: Without SQL (tested by brute force or a round trip): op1 (CRC-32), op2 (approximate), op3, op6 (base 32, HTML), op8 and op9 (trained models), op12 (CRC-32).
ORACLE_SQL: dict[str, str] = {"op4_line_dedup": _LINES, "op7_tool_calls": _CALLS, "op11_fill_in_middle": _MIDDLE, "op13_exact_topk": _TOP}
