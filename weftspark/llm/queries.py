"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.llm import decontam, hpylm, langid, packing, puquality, repetition, simhash, tokenbin, toolchat, toxicity
from weftspark.llm.common import scratch_path, table
from weftspark.llm.sampling import fold


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.repetition(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenbin.write_token_files(table(spark, sf_dir, "documents"), scratch_path(spark, "planes"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenbin.read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score_texts(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.first)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.judge(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = puquality.judge(docs, puquality.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


#: Schemas of the tools that op10 reads out of the plain conversations.
TOOLS = {
    "ask": {"type": "object", "properties": {"limit": {"type": "integer", "minimum": 0, "maximum": 49}, "query": {"type": "string", "minLength": 1}}, "required": ["limit", "query"], "additionalProperties": False},
    "look": {"type": "object", "properties": {"limit": {"type": "integer"}, "query": {"type": "string", "maxLength": 400}}, "required": ["query"], "additionalProperties": False},
}


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations have no calls of their own, so turns are read as such.

    A user turn is a call whose arguments hold its text; an assistant turn is the
    result of the call one turn before, and the call after it waits for it; others
    are messages. Arrival swaps each even turn with the odd one after it, which the order has to undo.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    key = lambda back: F.concat_ws(":", "conv_id", F.col("turn") - back)
    events = turns.select(
        "conv_id",
        F.col("turn").bitwiseXOR(F.lit(1).cast("long")).alias("at"),
        F.when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("message").alias("kind"),
        "role",
        F.when(F.col("role") == "user", key(0)).when(F.col("role") == "assistant", key(1)).alias("call_id"),
        F.when(F.col("role") == "user", F.when(F.length("text") % 2 == 0, "ask").otherwise("look")).alias("name"),
        F.when(F.col("role") == "user", F.to_json(F.struct(F.col("text").alias("query"), (F.length("text") % 60).alias("limit")))).alias("arguments"),
        F.when(F.col("role") != "user", F.col("text")).alias("content"),
        F.when(F.col("role") == "user", F.array(key(2))).alias("depends_on"),
    )
    return toolchat.serialise(events, TOOLS).withColumn("errors", F.array_join("errors", "; "))


QUERIES = {
    "op1_repetition": op1_repetition,
    "op2_token_planes": op2_token_planes,
    "op3_packing": op3_packing,
    "op4_language_model": op4_language_model,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_tool_calls": op10_tool_calls,
}

ORACLES = {
    # a repeat of over 100 words is a window of 101 words that occurs twice
    "op1_repetition": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lines AS (
  SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), at8 AS (
  SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS p FROM d WHERE len(w) >= 8
), twice AS (
  SELECT r, list(p) AS ps FROM (SELECT r, p, array_to_string(list_slice(w, p, p + 7), ' ') AS g FROM at8) GROUP BY r, g HAVING count(*) > 1
), covered AS (
  SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(generate_series(p, p + 7)) AS q FROM (SELECT r, unnest(ps) AS p FROM twice)) GROUP BY r
), at101 AS (
  SELECT r, w, unnest(generate_series(1, len(w) - 100)) AS p FROM d JOIN covered USING (r) WHERE len(w) >= 102
), long AS (
  SELECT DISTINCT r FROM (SELECT r, md5(array_to_string(list_slice(w, p, p + 100), ' ')) AS g FROM at101) GROUP BY r, g HAVING count(*) > 1
), counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, long.r IS NOT NULL AS is_long
  FROM d JOIN lines USING (r) LEFT JOIN covered USING (r) LEFT JOIN long USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_repeat_words > 20 * n_words OR is_long) AS kept
FROM counts
""",
    "op5_decontamination": r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT item, w, CAST(least(8, len(w)) AS BIGINT) AS k FROM items WHERE len(w) > 0
), parts AS (
  SELECT item, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM sized
), windows AS (
  SELECT DISTINCT item, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g FROM parts
), ks AS (SELECT DISTINCT k FROM windows
), places AS (
  SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM lowered, ks WHERE len(w) >= k
), grams AS (
  SELECT doc_id, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g FROM places
), found AS (
  SELECT doc_id, p, k, item FROM grams JOIN windows USING (k, g)
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS q FROM found) GROUP BY 1
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1
)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM lowered l LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op10_tool_calls": r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, role, text, xor(turn, 1) AS "at" FROM conversations
), calls AS (
  SELECT conv_id, turn, "at", conv_id || ':' || turn AS call_id, CASE WHEN length(text) % 2 = 0 THEN 'ask' ELSE 'look' END AS name, length(text) AS n, text FROM turns WHERE role = 'user'
), results AS (
  SELECT conv_id, turn - 1 AS turn, "at", conv_id || ':' || (turn - 1) AS call_id, text FROM turns WHERE role = 'assistant'
), pairs AS (
  SELECT c.conv_id, c.turn, c."at" AS call_at, r."at" AS result_at FROM calls c LEFT JOIN results r USING (conv_id, turn)
), chain AS (
  SELECT p.*, p.call_at * 1000000 AS k FROM pairs p LEFT JOIN calls b ON b.conv_id = p.conv_id AND b.turn = p.turn - 2 WHERE b.turn IS NULL
  UNION ALL
  SELECT p.*, greatest(p.call_at * 1000000, 1 + CASE WHEN c.result_at IS NULL THEN c.k ELSE greatest(c.result_at * 1000000, c.k + 1) END) FROM chain c JOIN pairs p ON p.conv_id = c.conv_id AND p.turn = c.turn + 2
), judged AS (
  SELECT *, CASE WHEN name = 'ask' THEN concat_ws('; ', CASE WHEN n % 60 > 49 THEN '$.limit: over maximum' END, CASE WHEN n < 1 THEN '$.query: under minLength' END)
                 ELSE concat_ws('; ', CASE WHEN n > 400 THEN '$.query: over maxLength' END) END AS errors FROM calls
)
SELECT j.conv_id, CAST(k // 1000000 AS BIGINT) AS order_turn, CAST(k % 1000000 AS INTEGER) AS order_step, j."at", 'call' AS kind, j.call_id,
       CASE WHEN result_at IS NULL THEN 'unanswered' ELSE 'linked' END AS status, CAST(1 AS BIGINT) AS copies, errors = '' AS valid, errors,
       '{"arguments":{"limit":' || n % 60 || ',"query":' || CAST(to_json(text) AS VARCHAR) || '},"id":"' || call_id || '","name":"' || name || '","role":"user","type":"call"}' AS json
FROM judged j JOIN chain c USING (conv_id, turn)
UNION ALL
SELECT r.conv_id, CAST(CASE WHEN k IS NULL THEN r."at" ELSE greatest(r."at" * 1000000, k + 1) // 1000000 END AS BIGINT), CAST(CASE WHEN k IS NULL THEN 0 ELSE greatest(r."at" * 1000000, k + 1) % 1000000 END AS INTEGER), r."at", 'result', r.call_id,
       CASE WHEN k IS NULL THEN 'orphan' ELSE 'linked' END, CAST(1 AS BIGINT), k IS NOT NULL, '',
       '{"content":' || CAST(to_json(r.text) AS VARCHAR) || ',"id":"' || r.call_id || '","name":' || coalesce('"' || name || '"', 'null') || ',"role":"assistant","type":"result"}'
FROM results r LEFT JOIN chain c USING (conv_id, turn) LEFT JOIN calls n USING (conv_id, turn)
UNION ALL
SELECT conv_id, "at", 0, "at", 'message', NULL, 'message', CAST(1 AS BIGINT), true, '', '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"' || role || '","type":"message"}'
FROM turns WHERE role NOT IN ('user', 'assistant')
""",
}
