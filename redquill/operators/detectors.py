"""Detectors as array expressions: every block row gets its findings, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redquill.functions.text import EDGE, MARKED, SPACE, WORD, match_case, spans

RULE_VERSION = "rules-0.2.0"
MULTIPLE = " {2,}"
LEADING = r"[ \x{a0}]+(?:[,;:!?]|\.(?!\.))"
MISSING = r"[,.;:!?](?=[^" + SPACE + r"\p{Nd},.;:!?])(?![/\\)\]}»”’\"'])(?<!(?<=[\p{L}\p{N}])\.(?=\p{L}))(?<!(?<=[,.;:!?])\.)(?<!:(?=[/\\]))"
REPEATED = r"(?iu)(?<!" + EDGE + ")(" + WORD + r")([ \x{a0}]+)\1(?!" + EDGE + ")"
FINDING = "array<struct<start:int,end:int,source_text:string,category:string,detector_id:string,suggestion:string,confidence:double,detector_ord:int>>"


def _finding(start: Column, end: Column, source: Column, category: str, detector: Column, suggestion: Column, confidence: float, order: int) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), source.alias("source_text"), F.lit(category).alias("category"), detector.alias("detector_id"), suggestion.alias("suggestion"), F.lit(confidence).alias("confidence"), F.lit(order).alias("detector_ord"))


def _each(found: Column, category: str, detector: str, suggestion, confidence: float, order: int) -> Column:
    return F.transform(found, lambda m: _finding(m["start"], m["end"], m["source_text"], category, F.lit(detector), suggestion(m), confidence, order))


def spacing_multiple(text: Column) -> Column:
    return _each(spans(text, MULTIPLE), "technical", "spacing.multiple.v1", lambda m: F.lit(" "), 1.0, 0)


def leading_space(text: Column) -> Column:
    return _each(spans(text, LEADING), "technical", "punctuation.leading_space.v2", lambda m: F.right(m["source_text"], F.lit(1)), 1.0, 1)


def missing_space(text: Column) -> Column:
    return _each(spans(text, MISSING), "technical", "punctuation.missing_space.v2", lambda m: F.concat(m["source_text"], F.lit(" ")), 1.0, 2)


def repeated_word(text: Column) -> Column:
    """The separator and the second word; n equal words in a row give floor(n / 2)."""

    def one(m: Column) -> Column:
        start = m["start"] + F.length(F.regexp_extract(m["source_text"], "^" + WORD, 0))
        return _finding(start, m["end"], F.call_function("substring", m["source_text"], start - m["start"] + 1), "technical", F.lit("word.repeated.v2"), F.lit(""), 1.0, 3)

    return F.transform(spans(text, REPEATED), one)


# Onsets before a front vowel: pattern, length of the onset, letter put after it or in its place.
FRONT = "iíìỉĩịeéèẻẽẹêếềểễệyýỳỷỹỵ"
NOT_I = "".join(c for c in FRONT if c not in "iíìỉĩị")


def onset_repair(word: Column) -> Column:
    """The repaired word, or null: ngh, gh and k before front vowels, qu after q."""
    low, at = F.lower(word), lambda i: F.call_function("substring", word, F.lit(i))
    upper = lambda c: (c == F.upper(c)) & (c != F.lower(c))
    put = lambda n, c: F.concat(F.call_function("left", word, F.lit(n)), F.when(upper(F.call_function("left", word, F.lit(n))), F.lit(c.upper())).otherwise(F.lit(c)), at(n + 1))
    fixed = (
        F.when(low.rlike(f"^ng[{FRONT}]"), put(2, "h"))
        .when(low.rlike(f"^g[{NOT_I}]"), put(1, "h"))
        .when(low.rlike(f"^c[{FRONT}]"), F.concat(F.when(upper(F.substring(word, 1, 1)), F.lit("K")).otherwise(F.lit("k")), at(2)))
        .when(low.rlike("^q(?![uúùủũụưứừửữự])"), put(1, "u"))
    )
    return F.when((F.length(word) >= 2) & low.rlike(f"[{MARKED}]"), fixed)


# Words that can need a repair: by their onset, so that no other word enters the fold.
ONSET = f"(?<!{WORD[:-1]})(?iu:ng[{FRONT}]|g[{NOT_I}]|c[{FRONT}]|q){WORD[:-1]}*"


def syllable_onset(text: Column) -> Column:
    found = F.transform(spans(text, ONSET), lambda m: F.struct(m.alias("m"), onset_repair(m["source_text"]).alias("fix")))
    return F.transform(F.filter(found, lambda f: f["fix"].isNotNull()), lambda f: _finding(f["m"]["start"], f["m"]["end"], f["m"]["source_text"], "spelling", F.lit("syllable.onset.v2"), f["fix"], 0.99, 5))


def technical(text: Column) -> Column:
    return F.concat(spacing_multiple(text), leading_space(text), missing_space(text), repeated_word(text))


def explode(blocks: DataFrame, findings: Column) -> DataFrame:
    """One row a finding, with its id, rule version and block."""
    # An outer explode: a plain one has the findings worked out once more in a filter.
    rows = blocks.select("doc_id", "block_id", "block_ord", F.explode_outer(findings).alias("f")).where("f is not null").select("doc_id", "block_id", "block_ord", "f.*")
    return rows.select(F.concat_ws(":", "block_id", "start", "end", "detector_id").alias("id"), "*", F.lit("rule").alias("origin"), F.lit(RULE_VERSION).alias("rule_version"))


def words(blocks: DataFrame, pattern: str = WORD) -> DataFrame:
    """doc_id, block_ord, pos, start, end, word."""
    found = blocks.select("doc_id", "block_id", "block_ord", F.posexplode_outer(spans(F.col("text"), pattern)).alias("pos", "m")).where("m is not null")
    return found.select("doc_id", "block_id", "block_ord", "pos", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.source_text").alias("word"))


BROADCAST_ENTRIES = 500_000
FIRST_WORDS = 500  # so many at most stand in a pattern


def confusions(blocks: DataFrame, table: DataFrame) -> DataFrame:
    """Known wrong phrases by equi-join on word n-grams, up to the longest phrase of the table; only candidates' own text is joined.

    N-grams begin with a word that begins a phrase, or with any word if a table has very many of those.
    """
    word, gap = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]+"
    longest, entries, dots = table.agg(F.max(F.regexp_count("wrong", F.lit(word))), F.count("*"), F.max(F.contains("wrong", F.lit("\u0307")))).first()
    firsts = [r[0] for r in table.select(F.regexp_extract("wrong", word, 0)).distinct().limit(FIRST_WORDS + 1).collect() if r[0]]
    # A capital I with a dot is no match for its small form, which are two characters.
    begin = word if dots or not 0 < len(firsts) <= FIRST_WORDS else f"(?iu)(?<!{EDGE})(?:{'|'.join(sorted(firsts))})(?!{EDGE})"
    longest = longest or 1
    tokens = blocks.select("doc_id", "block_id", "block_ord", spans(F.col("text"), begin).alias("w"), F.split("text", begin, -1).alias("gaps"))

    # What follows a first word, as far as a phrase can go: gaps and the next first words. Every gap is taken a few times.
    def with_tail(m: Column, i: Column) -> Column:
        parts = [F.coalesce(c, F.lit("")) for j in range(1, longest) for c in (F.get(F.col("gaps"), i + j), F.get(F.col("w"), i + j)["source_text"])]
        return F.struct(m["start"].alias("start"), m["source_text"].alias("first"), F.concat(F.lit(""), *parts).alias("tail"))

    def grams(m: Column) -> Column:
        more = [F.concat(m["first"], F.nullif(F.regexp_extract(m["tail"], f"^(?:{gap}{word}){{{k}}}", 0), F.lit(""))) for k in range(1, longest)]
        return F.transform(F.array_compact(F.array(m["first"], *more)), lambda t: F.struct(m["start"].alias("start"), (m["start"] + F.length(t)).alias("end"), t.alias("source_text")))

    # An outer explode: a plain one has the grams worked out once more in a filter.
    found = F.flatten(F.transform(F.transform("w", with_tail), grams))
    rows = tokens.select("doc_id", "block_id", "block_ord", F.explode_outer(found).alias("g")).where("g is not null").select("doc_id", "block_id", "block_ord", "g.*")
    # A lexicon goes to the grams; only one that is too large for that has them shuffled.
    found = rows.join(F.broadcast(table) if entries <= BROADCAST_ENTRIES else table, F.lower("source_text") == F.col("wrong"))
    return found.select("doc_id", "block_id", "block_ord", "start", "end", "source_text", F.lit("spelling").alias("category"), F.concat(F.lit("confusion."), F.replace("wrong", F.lit(" "), F.lit("_")), F.lit(".v1")).alias("detector_id"), match_case(F.col("source_text"), F.col("right")).alias("suggestion"), F.lit(0.98).alias("confidence"), F.lit(4).alias("detector_ord"))


def _neighbours(words: Column, gaps: Column) -> Column:
    """Pairs (l, r) of words next to one another with nothing but white space between, made inside the row."""
    n = F.size(words) - 1
    z = F.arrays_zip(F.slice(words, 1, n).alias("l"), F.slice(words, 2, n).alias("r"), F.slice(gaps, 2, n).alias("gap"))
    return F.when(n > 0, F.filter(z, lambda p: p["gap"].rlike(f"^[{SPACE}]*$")))


def bigram_counts(blocks: DataFrame) -> DataFrame:
    """w1, w2, n: how often lower-case words stand next to one another; only the pairs leave a block's row."""
    words, gaps = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.split("text", WORD, -1)
    held = blocks.select(words.alias("w"), gaps.alias("g"))
    pairs = held.select(F.explode(_neighbours(F.col("w"), F.col("g"))).alias("p"))
    return pairs.groupBy(F.lower("p.l").alias("w1"), F.lower("p.r").alias("w2")).agg(F.count("*").alias("n"))


def bigrams(blocks: DataFrame) -> DataFrame:
    """Adjacent words with nothing but white space between: doc_id, block_ord, w1, w2, start, end, source_text."""
    held = blocks.select("doc_id", "block_id", "block_ord", spans(F.col("text"), WORD).alias("w"), F.split("text", WORD, -1).alias("g"))
    pairs = held.select("doc_id", "block_id", "block_ord", F.explode(_neighbours(F.col("w"), F.col("g"))).alias("p"))
    l, r = F.col("p.l"), F.col("p.r")
    return pairs.select("doc_id", "block_id", "block_ord", l["source_text"].alias("w1"), r["source_text"].alias("w2"), l["start"].alias("start"), r["end"].alias("end"), F.concat(l["source_text"], "p.gap", r["source_text"]).alias("source_text"))
