"""Registered queries of the text review engine, and their SQL for DuckDB.

The SQL works from tokens and neighbours, not from the expressions that the queries use, so that
agreement means something. Where the tables hold no case, both sides change the text by one rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redquill.functions import composed
from redquill.functions import text as fn
from redquill.operators import administrative, answers, arbitrate, chunking, detectors, evaluate, lexical, localize, reviewing
from redquill.plans.rules import rule_findings
from redquill.sources.blocks import blocks_from_text, inspect

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def register(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spoiled(docs: DataFrame) -> DataFrame:
    """The text with a space before commas and two after stops."""
    return docs.withColumn("text", F.replace(F.replace("text", F.lit(", "), F.lit(" , ")), F.lit(". "), F.lit(".  ")))


def blocks_sql(text: str = "text") -> str:
    return f"""blocks AS (SELECT doc_id, block_ord, text FROM (SELECT doc_id, unnest(string_split({text}, chr(10))) AS text, generate_subscripts(string_split({text}, chr(10)), 1) - 1 AS block_ord FROM documents) WHERE text <> '')"""


SPOILED = "replace(replace(text, ', ', ' , '), '. ', '.  ')"


def tokens_sql(pattern: str, name: str = "tok") -> str:
    return f"""{name} AS (SELECT doc_id, block_ord, i, t, (sum(length(t)) OVER w - length(t))::INT AS s, lag(t) OVER w AS before, lead(t) OVER w AS after
  FROM (SELECT doc_id, block_ord, unnest(r) AS t, generate_subscripts(r, 1) AS i FROM (SELECT doc_id, block_ord, regexp_extract_all(text, '{pattern}') AS r FROM blocks))
  WINDOW w AS (PARTITION BY doc_id, block_ord ORDER BY i))"""


@query(f"WITH {blocks_sql()} SELECT doc_id, block_ord::INT AS block_ord, text, 'paragraph' AS kind FROM blocks")
def blocks_scan(spark, d):
    return blocks_from_text(documents(spark, d)).select("doc_id", "block_ord", "text", "kind")


@query(rf"WITH {blocks_sql()} SELECT doc_id, count(*) AS n_paragraphs, 0::BIGINT AS n_table_cells, sum(length(text))::BIGINT AS n_chars, sum(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')))::BIGINT AS n_words FROM blocks GROUP BY doc_id")
def doc_inspect(spark, d):
    return inspect(blocks_from_text(documents(spark, d)))


WORDS_SQL = tokens_sql(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+")


@query(
    rf"""WITH {blocks_sql()}, {tokens_sql("[A-Za-zÀ-ỹĐđ]+|[^A-Za-zÀ-ỹĐđ]+")},
w AS (SELECT *, lead(t, 2) OVER (PARTITION BY doc_id, block_ord ORDER BY i) AS w2 FROM tok)
SELECT lower(t) AS w1, lower(w2) AS w2, count(*) AS n FROM w WHERE regexp_full_match(t, '[A-Za-zÀ-ỹĐđ]+') AND w2 IS NOT NULL AND trim(after, ' ' || chr(9) || chr(13)) = '' GROUP BY 1, 2"""
)
def token_bigrams(spark, d):
    return detectors.bigram_counts(blocks_from_text(documents(spark, d)))


def _findings(blocks: DataFrame, found) -> DataFrame:
    return detectors.explode(blocks, found).select("doc_id", "block_ord", "start", "end", "source_text", "suggestion", "detector_id")


D1_SQL = f"""SELECT doc_id, block_ord, s AS start, s + length(t) AS "end", t AS source_text, ' ' AS suggestion, 'spacing.multiple.v1' AS detector_id FROM sp WHERE t LIKE '  %'"""
D2_SQL = r"""SELECT doc_id, block_ord, s AS start, s + length(t) + 1 AS "end", t || left(after, 1) AS source_text, left(after, 1) AS suggestion, 'punctuation.leading_space.v2' AS detector_id
FROM sp2 WHERE regexp_full_match(t, '[ \x{a0}]+') AND left(after, 1) IN (',', '.', ';', ':', '!', '?') AND NOT starts_with(after, '..')"""
D3_SQL = r"""SELECT doc_id, block_ord, s + length(t) - 1 AS start, s + length(t) AS "end", right(t, 1) AS source_text, right(t, 1) || ' ' AS suggestion, 'punctuation.missing_space.v2' AS detector_id
FROM (SELECT *, right(t, 1) AS p, left(after, 1) AS n, CASE WHEN length(t) > 1 THEN t[length(t) - 1] ELSE right(coalesce(before, ''), 1) END AS b FROM pu WHERE regexp_full_match(t, '[,.;:!?]+') AND after IS NOT NULL)
WHERE NOT regexp_full_match(n, '[\s\p{Nd}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]') AND n NOT IN ('/', '\', ')', ']', '}', '»', '”', '’', '"', '''')
AND NOT (p = '.' AND regexp_full_match(b, '[\p{L}\p{N}]') AND regexp_full_match(n, '\p{L}')) AND NOT (p = '.' AND b IN (',', '.', ';', ':', '!', '?')) AND NOT (p = ':' AND n IN ('/', '\'))"""
D4_SQL = r"""SELECT doc_id, block_ord, s - length(before) AS start, s + length(t) AS "end", before || t AS source_text, '' AS suggestion, 'word.repeated.v2' AS detector_id
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, block_ord, island ORDER BY i) AS k FROM
  (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, block_ord ORDER BY i) AS island FROM
    (SELECT *, coalesce(lower(t) = lower(lag(t, 2) OVER (PARTITION BY doc_id, block_ord ORDER BY i)) AND regexp_full_match(before, '[ \x{a0}]+') AND regexp_full_match(t, '[A-Za-zÀ-ỹĐđ]+'), false) AS same FROM tok WHERE true)
    WHERE regexp_full_match(t, '[\p{L}\p{N}_]+')))
WHERE k % 2 = 0"""
SPACES_SQL = f"{tokens_sql(' +|[^ ]+', 'sp')}, {tokens_sql('[ ' + chr(92) + 'x{a0}]+|[^ ' + chr(92) + 'x{a0}]+', 'sp2')}, {tokens_sql('[,.;:!?]+|[^,.;:!?]+', 'pu')}, {WORDS_SQL}"


def _detector_sql(body: str, text: str = "text") -> str:
    return f"WITH {blocks_sql(text)}, {SPACES_SQL} SELECT doc_id, block_ord::INT AS block_ord, start::INT AS start, \"end\"::INT AS \"end\", source_text, suggestion, detector_id FROM ({body})"


@query(_detector_sql(D1_SQL, SPOILED))
def det_spacing_multiple(spark, d):
    return _findings(blocks_from_text(spoiled(documents(spark, d))), detectors.spacing_multiple(F.col("text")))


@query(_detector_sql(D2_SQL, SPOILED))
def det_leading_space(spark, d):
    return _findings(blocks_from_text(spoiled(documents(spark, d))), detectors.leading_space(F.col("text")))


@query(_detector_sql(D3_SQL))
def det_missing_space(spark, d):
    return _findings(blocks_from_text(documents(spark, d)), detectors.missing_space(F.col("text")))


@query(_detector_sql(D4_SQL))
def det_repeated_word(spark, d):
    return _findings(blocks_from_text(documents(spark, d)), detectors.repeated_word(F.col("text")))


CONFUSED = {"the and": ("then and", "phrase"), "of the": ("off the", "phrase"), "thand": ("than", "word"), "of the and": ("of then and", "phrase")}


@query(
    rf"""WITH {blocks_sql()}, {WORDS_SQL},
lex(wrong, "right") AS (VALUES {", ".join(f"('{k}', '{v[0]}')" for k, v in CONFUSED.items())}),
g AS (SELECT doc_id, block_ord, s, unnest([t, t || after || lead(t, 2) OVER w, t || after || lead(t, 2) OVER w || lead(t, 3) OVER w || lead(t, 4) OVER w]) AS x, t FROM tok WINDOW w AS (PARTITION BY doc_id, block_ord ORDER BY i)),
f AS (SELECT * FROM g JOIN lex ON lower(x) = wrong WHERE regexp_full_match(t, '[\p{{L}}\p{{N}}_]+'))
SELECT doc_id, block_ord::INT AS block_ord, s AS start, (s + length(x))::INT AS "end", x AS source_text, 'confusion.' || replace(wrong, ' ', '_') || '.v1' AS detector_id,
CASE WHEN length(x) > 1 AND x = upper(x) THEN upper("right") WHEN left(x, 1) <> lower(left(x, 1)) THEN upper(left("right", 1)) || substr("right", 2) ELSE "right" END AS suggestion FROM f"""
)
def det_confusion(spark, d):
    from redquill.sources.lexicon import confusion_table

    found = detectors.confusions(blocks_from_text(documents(spark, d)), confusion_table(spark, CONFUSED))
    return found.select("doc_id", "block_ord", "start", "end", "source_text", "detector_id", "suggestion")


@query(
    rf"""WITH {blocks_sql("replace(text, 'he', 'ngế')")}, {tokens_sql("[A-Za-zÀ-ỹĐđ]+|[^A-Za-zÀ-ỹĐđ]+")},
w AS (SELECT *, lower(t) AS l FROM tok WHERE regexp_full_match(t, '[A-Za-zÀ-ỹĐđ]+') AND length(t) >= 2 AND regexp_matches(lower(t), '[{fn.MARKED}]')),
f AS (SELECT *, CASE WHEN regexp_matches(l, '^ng[{detectors.FRONT}]') THEN left(t, 2) || CASE WHEN left(t, 2) = upper(left(t, 2)) THEN 'H' ELSE 'h' END || substr(t, 3)
 WHEN regexp_matches(l, '^g[{detectors.NOT_I}]') THEN left(t, 1) || CASE WHEN left(t, 1) = upper(left(t, 1)) THEN 'H' ELSE 'h' END || substr(t, 2)
 WHEN regexp_matches(l, '^c[{detectors.FRONT}]') THEN CASE WHEN left(t, 1) = 'C' THEN 'K' ELSE 'k' END || substr(t, 2)
 WHEN regexp_matches(l, '^q') AND NOT regexp_matches(l, '^q[uúùủũụưứừửữự]') THEN left(t, 1) || CASE WHEN left(t, 1) = 'Q' THEN 'U' ELSE 'u' END || substr(t, 2) END AS fix FROM w)
SELECT doc_id, block_ord::INT AS block_ord, s AS start, (s + length(t))::INT AS "end", t AS source_text, fix AS suggestion, 'syllable.onset.v2' AS detector_id FROM f WHERE fix IS NOT NULL"""
)
def det_syllable_onset(spark, d):
    docs = documents(spark, d).withColumn("text", F.replace("text", F.lit("he"), F.lit("ngế")))
    return _findings(blocks_from_text(docs), detectors.syllable_onset(F.col("text")))


ALL_SQL = f"""WITH RECURSIVE {blocks_sql(SPOILED)}, {SPACES_SQL},
every AS (SELECT *, 0 AS o FROM ({D1_SQL}) UNION ALL SELECT *, 1 FROM ({D2_SQL}) UNION ALL SELECT *, 2 FROM ({D3_SQL}) UNION ALL SELECT *, 3 FROM ({D4_SQL})),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, block_ord ORDER BY start, "end" DESC, o) AS n FROM every),
walk AS (SELECT doc_id, block_ord, n, start, "end", source_text, suggestion, detector_id, true AS kept, "end" AS last FROM placed WHERE n = 1
  UNION ALL SELECT p.doc_id, p.block_ord, p.n, p.start, p."end", p.source_text, p.suggestion, p.detector_id, p.start >= w.last, CASE WHEN p.start >= w.last THEN p."end" ELSE w.last END
  FROM walk w JOIN placed p ON p.doc_id = w.doc_id AND p.block_ord = w.block_ord AND p.n = w.n + 1)
"""


def _arbitrated(spark, d) -> DataFrame:
    blocks = blocks_from_text(spoiled(documents(spark, d)))
    rows = blocks.withColumn("_f", detectors.technical(F.col("text")).cast(detectors.FINDING))
    return detectors.explode(rows, arbitrate.in_start_order(F.col("_f"), detectors.FINDING))


@query(ALL_SQL + """SELECT doc_id, block_ord::INT AS block_ord, start::INT AS start, "end"::INT AS "end", source_text, suggestion, detector_id FROM walk WHERE kept""")
def arbitrate_rules(spark, d):
    return _arbitrated(spark, d).select("doc_id", "block_ord", "start", "end", "source_text", "suggestion", "detector_id")


@query(ALL_SQL + "SELECT 'technical' AS category, detector_id, count(*) AS n FROM walk WHERE kept GROUP BY detector_id")
def findings_by_category(spark, d):
    return _arbitrated(spark, d).groupBy("category", "detector_id").agg(F.count("*").alias("n"))


@query(ALL_SQL + "SELECT 'rule' AS origin, count(*) AS n FROM walk WHERE kept")
def findings_by_origin(spark, d):
    return _arbitrated(spark, d).groupBy("origin").agg(F.count("*").alias("n"))


@query()
def rule_pipeline(spark, d):
    return rule_findings(blocks_from_text(documents(spark, d)))


@query(f"""WITH {blocks_sql()}, {SPACES_SQL}, a AS ({D4_SQL}), b AS (SELECT doc_id, block_ord, s AS start, s + length(t) AS "end" FROM tok WHERE length(t) = 4)
SELECT a.doc_id, a.block_ord::INT AS block_ord, a.start::INT AS start, a."end"::INT AS "end" FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.doc_id = b.doc_id AND a.block_ord = b.block_ord AND a.start < b."end" AND b.start < a."end")""")
def interval_anti_merge(spark, d):
    blocks = blocks_from_text(documents(spark, d))
    # Tokens of four characters, of blocks that can have a finding.
    four = r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_]{4}(?![\p{L}\p{N}_])|(?<![^\p{L}\p{N}_])[^\p{L}\p{N}_]{4}(?![^\p{L}\p{N}_])"
    kept = detectors.words(blocks.where(F.col("text").rlike(detectors.REPEATED)), four).select("doc_id", "block_ord", "start", "end")
    return arbitrate.interval_anti(detectors.explode(blocks, detectors.repeated_word(F.col("text"))), kept).select("doc_id", "block_ord", "start", "end")


@query(
    f"""WITH {blocks_sql()}, {SPACES_SQL}, a AS ({D4_SQL}), c AS (SELECT a.*, k, CASE WHEN k = 0 THEN 'llm.discovery.x.v2' ELSE detector_id END AS det, CASE WHEN k = 1 THEN 0.5 ELSE 0.9 END AS conf FROM a, range(3) r(k)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_ord, start, "end", suggestion ORDER BY det LIKE 'llm.discovery%', conf DESC, k) AS rn FROM c)
SELECT doc_id, block_ord::INT AS block_ord, start::INT AS start, det AS detector_id, conf::DOUBLE AS confidence FROM n WHERE rn = 1"""
)
def dedup_exact(spark, d):
    found = detectors.explode(blocks_from_text(documents(spark, d)), detectors.repeated_word(F.col("text")))
    copies = found.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("detector_id", F.when(F.col("k") == 0, "llm.discovery.x.v2").otherwise(F.col("detector_id")))
    copies = copies.withColumn("confidence", F.when(F.col("k") == 1, 0.5).otherwise(0.9)).withColumn("id", F.concat_ws(":", "id", "k"))
    return arbitrate.dedup_exact(copies).select("doc_id", "block_ord", "start", "detector_id", "confidence")


MIXED = ("spelling", "compound_word", "grammar", "word_choice", "capitalization", "technical", "custom_rule")
MIXED_SQL = "list_extract([" + ", ".join(f"'{c}'" for c in MIXED) + "], (start % 7)::INT + 1)"


def _mixed(spark, d) -> DataFrame:
    """Repeated words as findings of seven categories, every third by a review."""
    found = detectors.explode(blocks_from_text(documents(spark, d)), detectors.repeated_word(F.col("text")))
    category = F.element_at(F.array(*[F.lit(c) for c in MIXED]), (F.col("start") % 7 + 1).cast("int"))
    return found.withColumn("category", category).withColumn("detector_id", F.when(F.col("start") % 3 == 0, "llm.discovery.x.v2").otherwise(F.col("detector_id"))).withColumn("confidence", (F.col("start") % 4) / 4)


@query(f"""WITH {blocks_sql()}, {SPACES_SQL}, a AS (SELECT *, {MIXED_SQL} AS category, start % 3 = 0 AS found FROM ({D4_SQL})),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY NOT found, "end" - start, list_position(['custom_rule', 'technical', 'capitalization', 'word_choice', 'grammar', 'compound_word', 'spelling'], category) DESC, start, start % 4 DESC, 'document:p' || block_ord || ':') AS n FROM a)
SELECT doc_id, block_ord::INT AS block_ord, start::INT AS start, "end"::INT AS "end", category FROM n WHERE n <= 20""")
def quota_topk(spark, d):
    return arbitrate.quota(_mixed(spark, d), 20).select("doc_id", "block_ord", "start", "end", "category")


@query(f"""WITH {blocks_sql()}, {SPACES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_ord, start) AS n FROM ({D4_SQL}))
SELECT doc_id, block_ord::INT AS block_ord, start::INT AS start, "end"::INT AS "end" FROM n WHERE n <= 5""")
def rule_limit(spark, d):
    found = detectors.explode(blocks_from_text(documents(spark, d)), detectors.repeated_word(F.col("text")))
    return arbitrate.rule_limit(found, 5).select("doc_id", "block_ord", "start", "end")


@query(f"""WITH {blocks_sql()}, {SPACES_SQL}, c AS (SELECT *, (start % 6)::INT AS k, trim(source_text) AS m FROM ({D4_SQL}))
SELECT doc_id, block_ord::INT AS block_ord, start::INT AS start, CASE k WHEN 0 THEN 'Sai: “' || m || '” (thừa khoảng trắng trước dấu câu) → Đề xuất: “x”' WHEN 1 THEN 'Sai: “' || m || '” → Đề xuất: “x”' WHEN 2 THEN 'Sai: “' || m || '” → Đề xuất: xoá phần được bôi màu'
WHEN 3 THEN 'Lưu ý: “' || m || '” → Từ chưa có trong từ điển tiếng Việt (kiểm tra lại chính tả hoặc tên riêng)' WHEN 4 THEN 'Lưu ý: “' || m || '” → why' ELSE 'Sai: “' || m || '” → Đề xuất: xoá phần được bôi màu' END AS comment,
CASE WHEN start % 10 = 9 THEN 'red' ELSE 'yellow' END AS colour FROM c""")
def comment_render(spark, d):
    found = detectors.explode(blocks_from_text(documents(spark, d)), detectors.repeated_word(F.col("text"))).withColumn("k", F.col("start") % 6)
    k = F.col("k")
    detector = F.when(k == 0, "punctuation.leading_space.v2").when(k == 3, "dictionary.unknown.v1").otherwise("other.v1")
    comment = fn.comment_text(F.col("source_text"), F.when(k < 2, "x").otherwise(""), detector, F.when(k == 4, "why").otherwise(""), F.when(k == 2, "repetition").otherwise("technical"))
    return found.select("doc_id", "block_ord", "start", comment.alias("comment"), fn.highlight((F.col("start") % 10) / 10).alias("colour"))


@query(rf"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{fn.WORD}')) AS w FROM documents), b AS (SELECT w, lower(strip_accents(replace(replace(w, 'đ', 'd'), 'Đ', 'D'))) AS b FROM w WHERE regexp_full_match(w, '[a-zA-Z]+'))
SELECT w, (CASE WHEN (starts_with(b, 'gi') OR starts_with(b, 'qu')) AND regexp_matches(substr(b, 3), '[aeiouy]') THEN 2 ELSE coalesce(nullif(instr(translate(b, 'eiouy', 'aaaaa'), 'a'), 0), length(b) + 1) - 1 END)::INT AS n FROM b""")
def onset_length(spark, d):
    words = documents(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(f"({fn.WORD})"), F.lit(1))).alias("w")).where("w rlike '^[a-zA-Z]+$'").distinct()
    return words.select("w", fn.onset_length(F.col("w")).alias("n"))


@query("SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1) // 3)::INT AS batch FROM conversations")
def classifier_batches(spark, d):
    return reviewing.batches(spark.read.parquet(f"{d}/conversations.parquet"), "conv_id", "turn", "text", size=3).select("conv_id", "turn", "batch")


@query("""SELECT doc_id, count(*) AS chunks, sum(k + 1)::BIGINT AS blocks, sum(CASE WHEN (doc_id + k) % 4 = 0 THEN 0 ELSE k + 1 END)::BIGINT AS reviewed_blocks, count(*) FILTER (WHERE (doc_id + k) % 4 = 0 AND k = 0) AS timeouts, count(*) FILTER (WHERE (doc_id + k) % 4 = 0 AND k = 1) AS invalid_outputs,
count(*) FILTER (WHERE (doc_id + k) % 4 = 0 AND k = 2) AS inference_errors, count(*) FILTER (WHERE (doc_id + k) % 3 = 0) AS retried, count(*) FILTER (WHERE (doc_id + k) % 3 = 0 AND (doc_id + k) % 4 <> 0) AS recovered, CASE WHEN bool_or((doc_id + k) % 4 = 0) THEN 'partial' ELSE 'complete' END AS status FROM documents, range(3) r(k) GROUP BY doc_id""")
def review_coverage(spark, d):
    rows = documents(spark, d).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("chunk"))
    at = F.col("doc_id") + F.col("chunk")
    kinds = F.element_at(F.array(F.lit("timeout"), F.lit("invalid_output"), F.lit("inference_error")), F.col("chunk") + 1)
    return reviewing.coverage(rows.select("doc_id", "chunk", (F.col("chunk") + 1).alias("blocks"), F.when(at % 4 == 0, kinds).alias("failure"), (at % 3 == 0).alias("retried")))


@query("SELECT doc_id, k::INT AS item_ord, (k % 2)::INT AS line, (row_number() OVER (PARTITION BY doc_id, k % 2, k % 3 ORDER BY k) - 1)::INT AS nth FROM documents, range(12) r(k)")
def occurrence_assign(spark, d):
    k = F.col("item_ord")
    items = documents(spark, d).select(F.col("doc_id").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("item_ord")).select("*", (k % 2).alias("line"), (k % 3).cast("string").alias("src"), F.lit("x").alias("fix"))
    return reviewing.occurrences(items).select(F.col("chunk").alias("doc_id"), "item_ord", "line", "nth")


@query("SELECT doc_id, (doc_id % 5 <> 0 AND doc_id % 3 = 0) AS approved FROM documents")
def quality_gate(spark, d):
    i, h = F.col("doc_id"), F.sha2(F.col("doc_id").cast("string"), 256)
    profile = lambda memory, p: F.struct(memory.cast("double").alias("machine_memory_mb"), F.lit(20).alias("documents"), p.alias("precision"), F.lit(0.85).alias("recall"), F.lit(180.0).alias("p95_seconds"), F.lit(1.0).alias("peak_rss_mb"), h.alias("report_sha256"))
    profiles = F.array(profile(F.lit(8000), F.lit(0.95)), profile(F.when(i % 3 == 0, 16000).otherwise(8000), F.when(i % 5 == 0, 0.5).otherwise(0.9)))
    return documents(spark, d).select("doc_id", reviewing.quality_approved(h, profiles).alias("approved"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM s GROUP BY user_id, s""")
def activity_sessions(spark, d):
    found = reviewing.silences(spark.read.parquet(f"{d}/events.parquet"), "user_id", "ts")
    return found.select("user_id", "n", F.unix_micros(F.col("first").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last").cast("timestamp")).alias("last_us"))


@query()
def segments(spark, d):
    return reviewing.segments(blocks_from_text(documents(spark, d)), 100)


@query()
def noise_apply(spark, d):
    return documents(spark, d).select("doc_id", reviewing.noisy(F.col("text"), F.col("doc_id"), "heavy").alias("text"))


@query(f"""WITH {blocks_sql()}, {SPACES_SQL}, a AS ({D4_SQL}), v AS (SELECT *, CASE WHEN start % 4 = 3 THEN NULL WHEN start % 2 = 0 THEN 'keep' ELSE 'drop' END AS verdict, (start % 10) / 10.0 AS sure FROM a)
SELECT doc_id, block_ord::INT AS block_ord, start::INT AS start, CASE WHEN verdict = 'keep' AND sure >= 0.5 THEN 'llm' ELSE 'rule' END AS origin FROM v WHERE NOT coalesce(verdict = 'drop' AND sure >= 0.5, false)""")
def verdict_filter(spark, d):
    found = detectors.explode(blocks_from_text(documents(spark, d)), detectors.repeated_word(F.col("text"))).withColumn("id", F.concat_ws("/", "doc_id", "id"))
    verdicts = found.where("start % 4 != 3").select(F.col("id").alias("candidate_id"), F.when(F.col("start") % 2 == 0, "keep").otherwise("drop").alias("verdict"), ((F.col("start") % 10) / 10).alias("confidence"))
    return arbitrate.verdict_filter(found, verdicts, 0.5).select("doc_id", "block_ord", "start", "origin")


@query(f"""WITH {blocks_sql()}, {SPACES_SQL}, a AS ({D4_SQL}) SELECT a.doc_id, a.block_ord::INT AS block_ord, start::INT AS start FROM a JOIN blocks b ON a.doc_id = b.doc_id AND a.block_ord = b.block_ord
WHERE substr(replace(b.text, 'the the', 'the  the'), start + 1, "end" - start) = source_text""")
def anchor_revalidate(spark, d):
    blocks = blocks_from_text(documents(spark, d))
    found = detectors.explode(blocks, detectors.repeated_word(F.col("text")))
    changed = blocks.withColumn("text", F.replace("text", F.lit("the the"), F.lit("the  the")))
    return arbitrate.anchored(found, changed).select("doc_id", "block_ord", "start")


@query(f"""WITH {blocks_sql()}, {SPACES_SQL}, a AS ({D4_SQL}) SELECT a.doc_id, a.block_ord::INT AS block_ord, start::INT AS start,
substr(b.text, greatest(0, start - 240) + 1, least(length(b.text), "end" + 240) - greatest(0, start - 240)) AS context,
((length(left(b.text, start)) - length(replace(left(b.text, start), source_text, ''))) // length(source_text))::INT AS occurrence_index,
'Sai: “' || trim(source_text) || '” → Đề xuất: xoá phần được bôi màu' AS comment
FROM a JOIN blocks b ON a.doc_id = b.doc_id AND a.block_ord = b.block_ord""")
def finding_context(spark, d):
    blocks = blocks_from_text(documents(spark, d))
    rows = blocks.select("doc_id", "block_id", "block_ord", "text", F.explode(detectors.repeated_word(F.col("text"))).alias("f"))
    t, f = F.col("text"), F.col("f")
    return rows.select(
        "doc_id", "block_ord", f["start"].alias("start"), fn.context(t, f["start"], f["end"]).alias("context"), fn.occurrence_index(t, f["source_text"], f["start"]).alias("occurrence_index"),
        fn.comment_text(f["source_text"], f["suggestion"], f["detector_id"], F.lit("")).alias("comment"),
    )


# Accents that both sides strip; ß stays. Distances are between neighbouring lines, so no text is cut.
PLAIN_SQL = "lower(strip_accents(replace(replace(text, 'đ', 'd'), 'Đ', 'D')))"


@query(f"""SELECT doc_id, {PLAIN_SQL} AS plain, greatest(1, (octet_length(encode(text)) + 2) // 3)::INT AS tokens, translate(text, '{fn.SWAPPED[0]}', '{fn.SWAPPED[1]}') AS swapped FROM documents""")
def scalar_functions(spark, d):
    t = F.col("text")
    bare = F.translate(t, "çÇëïîÿäöüûÄÖÜÛñÑËÏÎŸåÅ", "cCeiiyaouuAOUUnNEIIYaA")
    return documents(spark, d).select("doc_id", F.lower(fn.strip_diacritics(bare)).alias("plain"), fn.token_estimate(t).alias("tokens"), fn.tone_swap(t).alias("swapped"))


@query(r"""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x) > 3)) AS w FROM documents), p AS (SELECT DISTINCT unnest(w) AS w FROM w)
SELECT w, levenshtein(w, reverse(w))::INT AS distance FROM p""")
def edit_distance(spark, d):
    words = documents(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("w")).where("length(w) > 3").distinct()
    return words.select("w", F.levenshtein("w", F.reverse("w")).alias("distance"))


@query(
    rf"""WITH {blocks_sql()}, x AS (SELECT doc_id, block_ord, trim(text) AS h, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda t: t <> '') AS toks FROM blocks),
y AS (SELECT *, list_filter(list_transform(toks, lambda t: regexp_replace(t, '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g')), lambda t: regexp_full_match(t, '\p{{L}}+')) AS al FROM x)
SELECT doc_id, block_ord::INT AS block_ord FROM y WHERE h <> '' AND len(toks) <= 12 AND NOT regexp_matches(h, '[.!?]$') AND len(al) > 0
AND (len(list_filter(al, lambda t: t = upper(t) AND t <> lower(t))) = len(al) OR len(list_filter(al, lambda t: regexp_matches(t, '^\p{{Lu}}'))) * 2 >= len(al))"""
)
def heading_detect(spark, d):
    return blocks_from_text(documents(spark, d)).where(fn.is_heading(F.col("text"))).select("doc_id", "block_ord")


@query(
    """WITH e AS (SELECT doc_id, k, s, CASE k WHEN 0 THEN upper(s) WHEN 1 THEN replace(s, ' ', '  ') WHEN 2 THEN replace(s, ' ', '') ELSE s || 'x' END AS g FROM (SELECT doc_id, replace(text, 'ß', 's') AS s FROM documents), range(4) r(k))
SELECT doc_id, k::INT AS k, CASE WHEN lower(s) = lower(g) THEN 'capitalization' WHEN lower(regexp_replace(s, '\\s+', ' ', 'g')) = lower(regexp_replace(g, '\\s+', ' ', 'g')) THEN 'technical' WHEN lower(regexp_replace(s, '\\s+', '', 'g')) = lower(regexp_replace(g, '\\s+', '', 'g')) THEN 'compound_word' ELSE 'grammar' END AS category FROM e""".replace("\\\\", "\\")
)
def canonicalize_edit(spark, d):
    rows = documents(spark, d).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), F.replace("text", F.lit("ß"), F.lit("s")).alias("s"))
    s, k = F.col("s"), F.col("k")
    g = F.when(k == 0, F.upper(s)).when(k == 1, F.replace(s, F.lit(" "), F.lit("  "))).when(k == 2, F.replace(s, F.lit(" "), F.lit(""))).otherwise(F.concat(s, F.lit("x")))
    return rows.select("doc_id", "k", fn.canonical_edit(s, g, F.lit("grammar"), F.lit("x"))["category"].alias("category"))


# Evaluation on annotations and findings that follow from the ids.
TRUTH_SQL = """truth AS (SELECT doc_id, 'b' || (k % 3) AS block_id, k * 10 AS start, k * 10 + 3 AS "end", 'abc' AS source_text, 'g' || k AS gt_id,
CASE (doc_id + k) % 5 WHEN 0 THEN 'must_not_warn' WHEN 1 THEN 'optional' ELSE 'required' END AS disposition, CASE k % 2 WHEN 0 THEN 'spelling' ELSE 'grammar' END AS category, k % 3 = 0 AS anything
FROM documents, range(8) r(k) WHERE (doc_id * 7 + k * 3) % 4 < 3),
run AS (SELECT doc_id, 'b' || (k % 3) AS block_id, k * 10 AS start, k * 10 + 3 AS "end", 'abc' AS source_text, 'f' || j AS finding_id, j AS finding_ord, 'technical' AS category,
CASE WHEN (doc_id + j) % 3 = 0 THEN 'abc' ELSE 'abd' END AS suggestion, 0.5 + ((doc_id + j) % 6) / 10.0 AS confidence FROM (SELECT doc_id, j, j % 8 AS k FROM documents, range(12) r(j)) WHERE (doc_id + j) % 4 <> 3)"""
OUTCOMES_SQL = f"""WITH {TRUTH_SQL},
m AS (SELECT run.*, t.gt_id, t.disposition, t.category AS gc, t.gt_id IS NOT NULL AND t.disposition <> 'must_not_warn' AND CASE WHEN t.anything THEN suggestion <> run.source_text ELSE suggestion = 'abd' END AS ok
  FROM run LEFT JOIN truth t ON run.doc_id = t.doc_id AND run.block_id = t.block_id AND run.start = t.start AND run."end" = t."end" AND run.source_text = t.source_text),
r AS (SELECT *, CASE WHEN gt_id IS NULL THEN 'unmatched_prediction' WHEN disposition = 'must_not_warn' THEN 'explicit_negative'
  WHEN EXISTS (SELECT 1 FROM m x WHERE x.doc_id = m.doc_id AND x.gt_id = m.gt_id AND x.finding_ord < m.finding_ord AND x.ok) THEN 'duplicate_prediction'
  WHEN NOT ok THEN 'suggestion_mismatch' WHEN disposition = 'optional' THEN 'accepted_optional' ELSE 'accepted_required' END AS reason FROM m),
o AS (SELECT doc_id, CASE reason WHEN 'accepted_required' THEN 'tp' WHEN 'accepted_optional' THEN 'optional' ELSE 'fp' END AS outcome, reason, coalesce(gc, category) AS category, gt_id, finding_id, confidence::DOUBLE AS confidence FROM r
  UNION ALL SELECT doc_id, 'fn', 'missed_required', category, gt_id, NULL, NULL FROM truth WHERE disposition = 'required' AND NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = truth.doc_id AND r.gt_id = truth.gt_id AND reason = 'accepted_required'))
"""


def _evaluation(spark, d) -> tuple[DataFrame, DataFrame]:
    ids = documents(spark, d).select("doc_id")
    k, j, doc = F.col("k"), F.col("j"), F.col("doc_id")
    anchor = [F.concat(F.lit("b"), k % 3).alias("block_id"), (k * 10).alias("start"), (k * 10 + 3).alias("end"), F.lit("abc").alias("source_text")]
    truth = ids.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)))).where((doc * 7 + k * 3) % 4 < 3)
    truth = truth.select("doc_id", *anchor, F.concat(F.lit("g"), k).alias("gt_id"), F.when((doc + k) % 5 == 0, "must_not_warn").when((doc + k) % 5 == 1, "optional").otherwise("required").alias("disposition"), F.when(k % 2 == 0, "spelling").otherwise("grammar").alias("category"), F.when(k % 3 != 0, F.array(F.lit("abd"))).alias("accepted_suggestions"))
    run = ids.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("k", j % 8).where((doc + j) % 4 != 3)
    run = run.select("doc_id", *anchor, F.concat(F.lit("f"), j).alias("finding_id"), j.alias("finding_ord"), F.lit("technical").alias("category"), F.when((doc + j) % 3 == 0, "abc").otherwise("abd").alias("suggestion"), (0.5 + ((doc + j) % 6) / 10).alias("confidence"))
    return truth, run


@query(OUTCOMES_SQL + "SELECT * FROM o")
def eval_outcomes(spark, d):
    return evaluate.outcomes(*_evaluation(spark, d))


@query(
    OUTCOMES_SQL
    + """, keys AS (SELECT 'total' AS level, '' AS key UNION ALL SELECT DISTINCT 'document', doc_id::VARCHAR FROM (SELECT doc_id FROM truth UNION SELECT doc_id FROM o) UNION ALL SELECT DISTINCT 'category', category FROM (SELECT category FROM truth UNION SELECT category FROM o)),
t AS (SELECT level, key, count(*) FILTER (WHERE disposition = 'required') AS gt_required, count(*) FILTER (WHERE disposition = 'optional') AS gt_optional, count(*) FILTER (WHERE disposition = 'must_not_warn') AS gt_must_not_warn
  FROM keys LEFT JOIN truth ON level = 'total' OR level = 'document' AND key = doc_id::VARCHAR OR level = 'category' AND key = category GROUP BY level, key),
p AS (SELECT level, key, count(*) FILTER (WHERE outcome IN ('tp', 'fp', 'optional')) AS findings, count(*) FILTER (WHERE outcome IN ('tp', 'fp')) AS scored_findings, count(*) FILTER (WHERE outcome = 'tp') AS true_positive, count(*) FILTER (WHERE outcome = 'fp') AS false_positive,
  count(*) FILTER (WHERE outcome = 'fn') AS false_negative, count(*) FILTER (WHERE outcome = 'optional') AS optional_accepted, count(*) FILTER (WHERE reason = 'explicit_negative') AS explicit_negative_hits
  FROM keys LEFT JOIN o ON level = 'total' OR level = 'document' AND key = doc_id::VARCHAR OR level = 'category' AND key = category GROUP BY level, key),
q AS (SELECT *, CASE WHEN true_positive + false_positive > 0 THEN true_positive / (true_positive + false_positive) WHEN gt_required = 0 THEN 1.0 ELSE 0.0 END AS precision, CASE WHEN true_positive + false_negative > 0 THEN true_positive / (true_positive + false_negative) ELSE 1.0 END AS recall FROM t JOIN p USING (level, key))
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM q"""
)
def eval_scores(spark, d):
    truth, run = _evaluation(spark, d)
    return evaluate.scores(truth, evaluate.outcomes(truth, run))


@query(
    OUTCOMES_SQL
    + "SELECT CASE WHEN confidence >= 0.9 THEN 'certain' ELSE 'uncertain' END AS band, count(*) AS findings, count(*) FILTER (WHERE outcome = 'tp') AS true_positive, count(*) FILTER (WHERE outcome = 'fp') AS false_positive, count(*) FILTER (WHERE outcome = 'tp') / count(*) FILTER (WHERE outcome IN ('tp', 'fp')) AS precision FROM o WHERE finding_id IS NOT NULL GROUP BY 1"
)
def eval_bands(spark, d):
    return evaluate.bands(evaluate.outcomes(*_evaluation(spark, d)))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'missing_in_run' WHEN doc_id % 7 = 0 THEN 'missing_in_truth' ELSE 'hash' END AS problem FROM documents WHERE (doc_id % 5 = 0) <> (doc_id % 7 = 0) OR (doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 3 = 0)")
def eval_doc_mismatch(spark, d):
    docs = documents(spark, d).select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("source_sha256"))
    other = docs.withColumn("source_sha256", F.when(F.col("doc_id") % 3 == 0, "other").otherwise(F.col("source_sha256")))
    return evaluate.document_mismatch(docs.where("doc_id % 7 != 0"), other.where("doc_id % 5 != 0"))


@query(f"WITH {TRUTH_SQL} SELECT disposition, count(*) AS n FROM truth GROUP BY disposition")
def gt_dispositions(spark, d):
    return _evaluation(spark, d)[0].groupBy("disposition").agg(F.count("*").alias("n"))


@query(
    f"""WITH {TRUTH_SQL}, t AS (SELECT doc_id, block_id, start, CASE WHEN doc_id % 11 = 0 THEN "end" + 1 ELSE "end" END AS e, source_text, gt_id FROM truth UNION ALL SELECT doc_id, block_id, start, "end" + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END, source_text, gt_id FROM truth WHERE doc_id % 13 = 0)
SELECT doc_id, 'duplicate_id' AS problem, count(*) AS n FROM t GROUP BY doc_id, gt_id HAVING count(*) > 1 UNION ALL SELECT doc_id, 'duplicate_anchor', count(*) FROM t GROUP BY doc_id, block_id, start, e, source_text HAVING count(*) > 1
UNION ALL SELECT doc_id, 'anchor_length', count(*) FROM t WHERE e - start <> length(source_text) GROUP BY doc_id"""
)
def gt_violations(spark, d):
    truth = _evaluation(spark, d)[0].withColumn("end", F.col("end") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0))
    return evaluate.truth_violations(truth.unionByName(truth.where("doc_id % 13 = 0")))


@query("SELECT event_type, value AS percentile FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE i = floor((n - 1) * 0.95 + 0.5)")
def latency_percentile(spark, d):
    return evaluate.nearest_rank(spark.read.parquet(f"{d}/events.parquet"), "event_type", "value", 0.95)


@query("SELECT conv_id, string_agg(n || '|' || text, chr(10) ORDER BY n) AS payload FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations WHERE text IS NOT NULL) GROUP BY conv_id")
def chunk_payload(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet").where("text is not null")
    return reviewing.payload(turns, "conv_id", "turn")


@query(r"SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zÀ-ỹĐđ]+')) AS w FROM documents) WHERE regexp_full_match(lower(w), '[a-zà-ỹđ]{2,7}')")
def lexicon_build(spark, d):
    from redquill.sources.lexicon import build

    found = documents(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(f"({fn.WORD})"), F.lit(1))).alias("w"))
    return build(found, "[a-zà-ỹđ]{2,7}")


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)


# Words with e for ẻ are looked up among those with e for ẽ and the plain ones.
@query(
    rf"""WITH raw AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{fn.WORD}'))) AS p FROM documents),
words AS (SELECT DISTINCT translate(p, 'e', 'ẻ') AS w FROM raw), syllables AS (SELECT p AS cand FROM raw UNION SELECT translate(p, 'e', 'ẽ') FROM raw),
horns(n, a, b) AS (VALUES {_values((n, *x) for n, x in enumerate(lexical.DOUBLE_HORN))}), reps(n, a, b) AS (VALUES {_values((n, *x) for n, x in enumerate(lexical.REPLACEMENTS))}), fams(f) AS (VALUES {_values((v,) for v in fn.VOWELS)}),
chars AS (SELECT w, i, substr(w, i, 1) AS c FROM (SELECT w, unnest(generate_series(1, length(w))) AS i FROM words)),
cands AS (SELECT w, 0 AS k, 0 AS i, 0 AS j, translate(w, '{fn.SWAPPED[0]}', '{fn.SWAPPED[1]}') AS cand FROM words WHERE translate(w, '{fn.SWAPPED[0]}', '{fn.SWAPPED[1]}') <> w
  UNION ALL SELECT w, 1, n, 0, replace(w, a, b) FROM words JOIN horns ON contains(w, a)
  UNION ALL SELECT w, 2, n, 0, left(w, instr(w, a) - 1) || b || substr(w, instr(w, a) + length(a)) FROM words JOIN reps ON contains(w, a)
  UNION ALL SELECT w, 3, i, j, left(w, i - 1) || substr(f, j, 1) || substr(w, i + 1) FROM chars JOIN fams ON contains(f, c) CROSS JOIN range(1, 7) r(j) WHERE substr(f, j, 1) <> c),
best AS (SELECT w, cand, min(k * 1000000 + i * 1000 + j) AS rank FROM cands WHERE cand IN (SELECT cand FROM syllables) GROUP BY w, cand)
SELECT w, cand, (row_number() OVER (PARTITION BY w ORDER BY rank))::INT AS n FROM best"""
)
def suggest_corrections(spark, d):
    raw = documents(spark, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({fn.WORD})"), F.lit(1))).alias("p")).distinct()
    words = raw.select(F.translate("p", "e", "ẻ").alias("w"))
    syllables = raw.select(F.col("p").alias("w")).union(raw.select(F.translate("p", "e", "ẽ"))).distinct()
    found = lexical.corrections(words, syllables)
    return found.select("w", "cand", F.row_number().over(Window.partitionBy("w").orderBy("rank")).alias("n"))


# Both greedy rules of chunking: the state of a block follows from the one before it in its document.
def _walk_sql(size: str, first: str, after: str) -> str:
    return f"""WITH RECURSIVE {blocks_sql()}, b AS MATERIALIZED (SELECT doc_id, block_ord, {size} AS size, row_number() OVER (PARTITION BY doc_id ORDER BY block_ord) AS n FROM blocks),
walk AS (SELECT doc_id, block_ord, n, 0 AS chunk, {first} FROM b WHERE n = 1 UNION ALL SELECT b.doc_id, b.block_ord, b.n, {after} FROM walk w JOIN b ON b.doc_id = w.doc_id AND b.n = w.n + 1)
SELECT doc_id, block_ord::INT AS block_ord, chunk::INT AS chunk FROM walk"""


@query(_walk_sql("length(text)", "size AS held", "CASE WHEN w.held + b.size > 4000 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.held + b.size > 4000 THEN b.size ELSE w.held + b.size END"))
def chunk_pack_chars(spark, d):
    return chunking.packed(blocks_from_text(documents(spark, d)))


@query(_walk_sql("greatest(1, (octet_length(encode(text)) + 2) // 3)", "size AS held, true AS free", "CASE WHEN w.free AND w.held + b.size <= 400 THEN w.chunk ELSE w.chunk + 1 END, b.size, NOT (w.free AND w.held + b.size <= 400)"))
def chunk_pairs(spark, d):
    return chunking.paired(blocks_from_text(documents(spark, d)), fn.token_estimate(F.col("text")))


@query()
def sentences(spark, d):
    return chunking.sentences(blocks_from_text(documents(spark, d)))


@query()
def det_administrative(spark, d):
    """The text with a citation before every stop; see the tests for phrases and golden findings."""
    docs = documents(spark, d).withColumn("text", F.replace("text", F.lit(". "), F.lit(" chương iv và quận 1. ")))
    return administrative.findings(blocks_from_text(docs))


# Every line is a target; an answer names the first word of each, with a wrong line number for every second one.
@query(
    rf"""WITH l AS (SELECT doc_id, ls, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents) WHERE len(ls) <= 32),
w AS (SELECT *, regexp_extract(text, '{fn.WORD}') AS s FROM l)
SELECT doc_id AS chunk_id, i::INT AS item_ord, doc_id || '#' || i AS block_id, (instr(text, s) - 1)::INT AS start, (instr(text, s) - 1 + length(s))::INT AS "end", s AS source_text, s || 'x' AS suggestion, 'spelling' AS category, 'spelling' AS reason_code, 0.9::DOUBLE AS confidence
FROM w WHERE s <> '' AND length(s) < 200 AND (i % 2 = 0 OR len(list_filter(ls, lambda x: contains(x, s))) = 1)"""
)
def review_items(spark, d):
    lines = F.filter(F.split("text", "\n", -1), lambda x: x != "")
    targets = F.transform(lines, lambda x, i: F.struct(F.concat(F.col("doc_id").cast("string"), F.lit("#"), i.cast("string")).alias("block_id"), F.lit(0).alias("source_start"), x.alias("text")))
    word = lambda t: F.regexp_extract(t["text"], fn.WORD, 0)
    answer = F.to_json(F.transform("targets", lambda t, i: F.struct((i + 1 + (i % 2) * 1000).alias("l"), word(t).alias("s"), F.concat(word(t), F.lit("x")).alias("r"))))
    return answers.anchored(documents(spark, d).select(F.col("doc_id").alias("chunk_id"), targets.alias("targets")).withColumn("items", answer))


# Batches of eight ids; every third answer leaves out its least candidate and so doesn't count.
@query(
    """SELECT doc_id // 8 AS batch, doc_id::VARCHAR AS candidate_id, CASE WHEN doc_id % 2 = 0 THEN 'keep' ELSE 'drop' END AS verdict, (doc_id % 10)::DOUBLE / 10 AS confidence FROM documents WHERE (doc_id // 8) % 3 <> 0"""
)
def verdict_answers(spark, d):
    ids = documents(spark, d).groupBy(F.floor(F.col("doc_id") / 8).alias("batch")).agg(F.array_sort(F.collect_set("doc_id")).alias("ids"))
    given = F.when(F.col("batch") % 3 == 0, F.slice("ids", 2, 8)).otherwise(F.col("ids"))
    items = F.transform(given, lambda i: F.struct(i.cast("string").alias("candidate_id"), F.when(i % 2 == 0, "keep").otherwise("drop").alias("verdict"), ((i % 10) / 10).alias("confidence")))
    return answers.verdicts(ids.select("batch", F.col("ids").cast("array<string>").alias("accepted"), F.to_json(F.struct(items.alias("verdicts"))).alias("content")))


# Every word twice around another, both changed: one edit while it is short, else one for each.
@query(
    rf"""WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{fn.WORD}'))) AS w FROM documents), p AS (SELECT w, regexp_replace(w, '^([^e]*)e', '\1é') AS g, length(w) AS n FROM w WHERE contains(w, 'e'))
SELECT w, 0 AS "offset", w || ' hay ' || w AS source_text, g || ' hay ' || g AS suggestion FROM p WHERE 2 * n + 5 <= 32
UNION ALL SELECT w, unnest([0, n + 5])::INT, w, g FROM p WHERE 2 * n + 5 > 32 AND n <= 32"""
)
def localized_edits(spark, d):
    words = documents(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(f"({fn.WORD})"), F.lit(1))).alias("w")).select(F.lower("w").alias("w")).distinct().where(F.contains("w", F.lit("e")))
    twice = lambda c: F.concat(c, F.lit(" hay "), c)
    pairs = words.select("w", twice(F.col("w")).alias("source_text"), twice(F.regexp_replace("w", "^([^e]*)e", "$1é")).alias("suggestion"), F.lit("spelling").alias("reason_code"))
    # Words are few bytes and much work: adaptive execution would put them into a few tasks.
    pairs = pairs.repartition(max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # An outer explode: a plain one has the edits worked out once more in a filter.
    return localize.localized(pairs).select("w", F.explode_outer("edits").alias("e")).where("e is not null").select("w", "e.*")


@query("SELECT doc_id, nfc_normalize(t) AS text, length(t) AS n_source, length(nfc_normalize(t)) AS n_places, length(t) AS last_end FROM (SELECT doc_id, replace(text, 'é', 'e' || chr(769)) AS t FROM documents)")
def composed_text(spark, d):
    apart = documents(spark, d).select("doc_id", F.replace("text", F.lit("é"), F.lit("e\u0301")).alias("t")).withColumn("c", composed.composed(F.col("t"), whole=True))
    n = F.array_size("c.places")  # null for a null in every mode; the last end of no places is 0
    return apart.select("doc_id", "c.text", F.length("t").cast("long").alias("n_source"), n.cast("long").alias("n_places"), F.coalesce(F.array_max(F.transform("c.places", lambda p: p["e"])), n).cast("long").alias("last_end"))
