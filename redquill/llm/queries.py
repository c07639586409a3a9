"""The registered queries of this package: thin contracts over the operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redquill.llm import capsim, chat, linededup, media, mixing, packing, secrets, simhash, substring, toxicity
from redquill.llm.runtime import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), carry_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    scored = toxicity.classified(docs, labels, keep_text=False)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "toxic")


def op3_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capsim.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_aggregate(list_transform(e, lambda x: (x IS NULL OR isnan(x) OR isinf(x))::INT), 'max') = 0
         AND list_aggregate(list_transform(e, lambda x: (x <> 0)::INT), 'max') = 1),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a)
SELECT v.vec_id, (SELECT count(*) FROM pairs WHERE pairs.a = v.vec_id)::BIGINT AS n_links, min(reach.b) AS component_id, v.vec_id = min(reach.b) AS kept
FROM v JOIN reach ON reach.a = v.vec_id GROUP BY v.vec_id
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS k
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS p FROM d WHERE len(w) >= 13)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT win.doc_id, unnest(generate_series(p, p + 12)) AS i FROM win JOIN least USING (k) WHERE m < win.doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d),
marked AS (SELECT words.doc_id, words.i, word, gone.i IS NOT NULL AS g FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i),
sums AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE g) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT g) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_counts(table(spark, sf_dir, "documents"))


TOOLS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}}},
    "measure": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}, "unit": {"enum": ["words", "chars"]}, "scale": {"type": "number", "minimum": 0}}},
    "lookup": {"type": "object", "required": ["keys"], "properties": {"keys": {"type": "array", "items": {"type": "string", "minLength": 1}}}},
}


def tool_conversations(conversations: DataFrame) -> DataFrame:
    """The table as tool use, by rule: a user turn calls a tool, the assistant turn after it is the result.

    Calls follow the one two turns earlier. By hash of the text some lack their id, name an unknown
    tool or break their schema; results of turns without a call stand alone.
    """
    h = F.pmod(F.xxhash64("text"), F.lit(100))
    quoted = F.to_json(F.struct(F.col("text").alias("query"), (F.length("text") % 60).alias("limit")))
    arguments = (
        F.when(h < 40, quoted)
        .when(h < 70, F.to_json(F.struct(F.col("text"), F.when(h % 2 == 0, F.lit("words")).otherwise(F.lit("lines")).alias("unit"), (F.length("text") / 2).alias("scale"))))
        .otherwise(F.to_json(F.struct(F.split("text", " ").alias("keys"))))
    )
    name = F.when(h < 40, "search").when(h < 70, "measure").when(h < 97, "lookup").otherwise("translate")
    call = lambda turn: F.concat_ws("_", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    calls = F.to_json(F.struct(F.array(F.struct(F.when(h != 41, call(F.col("turn"))).alias("id"), name.alias("name"), arguments.alias("arguments"), F.when(F.col("turn") >= 2, call(F.col("turn") - 2)).alias("after"))).alias("tool_calls")))
    result = F.to_json(F.struct(call(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content")))
    return conversations.select("conv_id", "turn", "role", F.when(F.col("role") == "user", calls).when(F.col("role") == "assistant", result).otherwise(F.col("text")).alias("text"))


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(tool_conversations(table(spark, sf_dir, "conversations")), TOOLS)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op8_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"), tensors=False)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.remove_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_toxicity, op3_cap_filters, op4_substring_dedup, op5_mixing, op6_tool_calls, op7_secrets, op8_progressive_jpeg, op9_simhash, op10_line_dedup, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op3_cap_filters": OP3_SQL, "op4_substring_dedup": OP4_SQL}
