"""Reviews of whole documents: segments, batches, coverage, occurrences, gates, synthetic noise and watchdogs.

Defined cases: null and empty texts have no segments and no noise; a null in a gate fails it; ties are
broken by the last column of every order; no rows give no rows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redquill.functions.text import strip_diacritics

SEGMENT = "array<struct<start:int,end:int,text:string>>"
BOUNDARIES = tuple(re.compile(p) for p in (r"[.!?…](?:\s+|$)", r"\n+", r"\s+"))


def tokens_of(text: str) -> int:
    return max(1, (len(text.encode("utf-8", "surrogatepass")) + 2) // 3)


def largest_prefix(text: str, start: int, limit: int) -> int:
    """The end of the longest piece from ``start`` of at most ``limit`` tokens; one character at least."""
    room, end = 3 * limit, start
    for c in text[start : start + room]:
        room -= len(c.encode("utf-8", "surrogatepass"))
        if room < 0:
            break
        end += 1
    return max(end, start + 1)


def preferred_boundary(text: str, start: int, end: int) -> int:
    """The last end of a sentence, line or word in the last two fifths of a piece; else its end."""
    least = start + max(1, int((end - start) * 0.6))
    for pattern in BOUNDARIES:
        ends = [m.end() for m in pattern.finditer(text[least:end])]
        if ends:
            return least + ends[-1]
    return end


def segment_spans(text: str | None, limit: int) -> list[tuple[int, int]]:
    """Pieces of at most ``limit`` tokens that cover a text once."""
    text, out, start = text or "", [], 0
    while start < len(text):
        end = largest_prefix(text, start, limit)
        if end < len(text):
            end = preferred_boundary(text, start, end)
        out.append((start, end))
        start = end
    return out


def segments(blocks: DataFrame, limit: int = 400) -> DataFrame:
    """doc_id, block_ord, segment_id, start, end, text of every segment."""

    @F.pandas_udf(SEGMENT)
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b, "text": t[a:b]} for a, b in segment_spans(t, limit)])

    rows = blocks.select("doc_id", "block_id", "block_ord", F.explode(split("text")).alias("s"))
    return rows.select("doc_id", "block_ord", F.concat(F.col("block_id"), F.lit("@"), F.col("s.start"), F.lit(":"), F.col("s.end")).alias("segment_id"), "s.*")


def batches(rows: DataFrame, by: str, *order: str, size: int = 8) -> DataFrame:
    """``rows`` with batch: their number by ``order`` within ``by``, ``size`` to a batch."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) / size).cast("int"))


def payload(rows: DataFrame, by: str, order: str, text: str = "text") -> DataFrame:
    """``by``, payload: a group's texts in order, each a line of its number and text."""
    held = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("t"))
    return held.select(by, F.array_join(F.transform("t", lambda t, i: F.concat((i + 1).cast("string"), F.lit("|"), t[text])), "\n").alias("payload"))


def occurrences(items: DataFrame) -> DataFrame:
    """``items`` (chunk, line, src, fix, item_ord, ...) with nth: equal proposals of a line take its occurrences in turn."""
    return items.withColumn("nth", F.row_number().over(Window.partitionBy("chunk", "line", "src", "fix").orderBy("item_ord")) - 1)


def coverage(chunks: DataFrame) -> DataFrame:
    """One row a document of chunks (doc_id, chunk, blocks, failure, retried): totals, failures by kind, and the status."""
    kind = lambda k: F.count_if(F.col("failure") == k)
    out = chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.sum("blocks").alias("blocks"), F.sum(F.when(F.col("failure").isNull(), F.col("blocks")).otherwise(0)).alias("reviewed_blocks"), kind("timeout").alias("timeouts"), kind("invalid_output").alias("invalid_outputs"),
        kind("inference_error").alias("inference_errors"), F.count_if("retried").alias("retried"), F.count_if(F.col("retried") & F.col("failure").isNull()).alias("recovered"),
    )
    return out.withColumn("status", F.when(F.col("reviewed_blocks") == F.col("blocks"), "complete").otherwise("partial"))


def quality_approved(corpus_hash: Column, profiles: Column) -> Column:
    """At least two measured profiles, all good enough, one on a small machine and one on a larger one."""
    hexed = lambda c: F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))

    def good(p: Column) -> Column:
        fine = (p["documents"] >= 20) & p["precision"].between(0.9, 1) & p["recall"].between(0.85, 1) & (p["p95_seconds"] > 0) & (p["p95_seconds"] <= 180) & (p["peak_rss_mb"] > 0) & (p["peak_rss_mb"] < float("inf"))
        return F.coalesce(fine, F.lit(False)) & hexed(p["report_sha256"])

    memory = lambda low, high: F.exists(profiles, lambda p: F.coalesce(p["machine_memory_mb"].between(low, high), F.lit(False)))
    return F.coalesce(hexed(corpus_hash) & (F.size(profiles) >= 2) & F.forall(profiles, good) & memory(7000, 9216) & memory(15000, 18432), F.lit(False))


# Ranges of a model's settings.
RANGES = {"memory_mb": (1, 1_000_000), "context_size": (512, 32_768), "batch_size": (1, 64), "max_tokens": (32, 4096), "review_chunk_tokens": (64, 32_768), "timeout_seconds": (1, 900)}


def runtime_approved(settings: DataFrame) -> Column:
    """Whether the settings that are given (columns of ``settings``) lie in range and leave room for a document."""
    out = F.coalesce(F.col("context_size"), F.lit(2048)) - F.coalesce(F.col("max_tokens"), F.lit(512)) - 256 >= 64
    for name, (low, high) in RANGES.items():
        if name in settings.columns:
            out = out & F.coalesce(F.col(name).between(low, high), F.lit(True))
    return out


def regression_scores(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """precision and recall over the distinct rows of two tables of one shape."""
    names = expected.columns
    hits = actual.select(*names).intersect(expected).agg(F.count("*").alias("hits"))
    total = hits.crossJoin(actual.select(*names).distinct().agg(F.count("*").alias("found"))).crossJoin(expected.distinct().agg(F.count("*").alias("wanted")))  # three single rows
    return total.select("hits", "found", "wanted", F.when(F.col("found") > 0, F.col("hits") / F.col("found")).otherwise(1.0).alias("precision"), F.when(F.col("wanted") > 0, F.col("hits") / F.col("wanted")).otherwise(1.0).alias("recall"))


# How likely each kind of noise is.
NOISE = {"light": {"strip": 0.05, "swap": 0.01, "delete": 0.01, "glue": 0.02}, "heavy": {"strip": 0.12, "swap": 0.03, "delete": 0.03, "glue": 0.05}}


def noisy(text: Column, key: Column, level: str = "light", seed: int = 42) -> Column:
    """``text`` with stripped marks, swapped and lost letters and lost blanks, by hashes of (seed, key, place, token).

    Tokens of one character stay. Confusion groups and keyboard neighbours are left to the caller's own tables.
    """
    p = NOISE[level]
    chance = lambda kind, i, t: F.pmod(F.xxhash64(F.lit(seed), F.lit(kind), key, i, t), F.lit(1_000_000)) / 1_000_000
    place = lambda kind, i, t, low, n: (low + F.pmod(F.xxhash64(F.lit(seed), F.lit(kind), i, t, key), F.greatest(n, F.lit(1)).cast("long"))).cast("int")
    sub = lambda c, *at: F.call_function("substring", c, *at)

    def one(t: Column, i: Column) -> Column:
        stripped = F.when((F.length(t) > 1) & (chance("strip", i, t) < p["strip"]), strip_diacritics(t)).otherwise(t)
        n = F.length(t)
        at = place("swap at", i, t, 2, n - 2)
        swapped = F.when((n >= 3) & (chance("swap", i, t) < p["swap"]), F.concat(sub(stripped, F.lit(1), at - 1), sub(stripped, at + 1, F.lit(1)), sub(stripped, at, F.lit(1)), sub(stripped, at + 2))).otherwise(stripped)
        gone = place("delete at", i, t, 2, n - 1)
        return F.when((n >= 3) & (chance("delete", i, t) < p["delete"]), F.concat(sub(swapped, F.lit(1), gone - 1), sub(swapped, gone + 1))).otherwise(swapped)

    tokens = F.split(text, " ", -1)
    glued = F.transform(F.transform(tokens, lambda t, i: F.struct(one(t, i).alias("t"), ((i > 0) & (chance("glue", i, t) >= p["glue"])).alias("gap"))), lambda x: F.concat(F.when(x["gap"], " ").otherwise(""), x["t"]))
    return F.array_join(glued, "")


def silences(events: DataFrame, key: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """``key``, start, end, n: stretches of activity without a pause of ``gap`` or more."""
    w = F.session_window(at, gap)
    return events.where(F.col(at).isNotNull()).groupBy(key, w).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last")).select(key, "first", "last", "n")
