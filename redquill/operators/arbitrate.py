"""Overlap resolution, deduplication, quotas and verdicts.

The greedy choices are ordered folds over the findings of one block, held as an array in the
block's row: four orders of one idea. A block's findings are bounded by its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIORITY = {"spelling": 4, "compound_word": 3, "capitalization": 2, "technical": 1}


# The order of categories in reviews.
REVIEW_PRIORITY = {"spelling": 6, "compound_word": 5, "grammar": 4, "word_choice": 3, "capitalization": 2, "technical": 1, "custom_rule": 0}


def priority(category: Column, values: dict[str, int] = PRIORITY) -> Column:
    out = F.lit(0)
    for name, value in values.items():
        out = F.when(category == name, F.lit(value)).otherwise(out)
    return out


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def in_start_order(findings: Column, kind: str) -> Column:
    """By start, category, length; a finding stays if it starts at or after the end of the last that did."""
    keyed = F.array_sort(F.transform(findings, lambda f: F.struct(f["start"], -priority(f["category"]), f["start"] - f["end"], f["detector_ord"], f.alias("f"))))
    none = F.array().cast(kind)

    def step(state: Column, x: Column) -> Column:
        good = x["f"]["start"] >= state["last"]
        return F.struct(F.when(good, x["f"]["end"]).otherwise(state["last"]).alias("last"), F.when(good, F.array_append(state["kept"], x["f"])).otherwise(state["kept"]).alias("kept"))

    return F.aggregate(keyed, F.struct(F.lit(-1).alias("last"), none.alias("kept")), step, lambda s: s["kept"])


def greedy(findings: Column, kind: str, *order) -> Column:
    """By ``order`` (functions of a finding); a finding stays if it overlaps none that did; by start at the end."""
    keyed = F.array_sort(F.transform(findings, lambda f: F.struct(*[o(f).alias(f"k{i}") for i, o in enumerate(order)], f.alias("f"))))
    kept = F.aggregate(keyed, F.array().cast(kind), lambda kept, x: F.when(F.exists(kept, lambda k: _overlaps(k, x["f"])), kept).otherwise(F.array_append(kept, x["f"])))
    return F.array_sort(kept)


def longest_first(findings: Column, kind: str) -> Column:
    return greedy(findings, kind, lambda f: f["start"] - f["end"], lambda f: f["start"])


def review_order(findings: Column, kind: str) -> Column:
    """Shorter first, then discoveries, category, confidence and id (in a block, ids differ from start to detector)."""
    return greedy(findings, kind, lambda f: f["end"] - f["start"], lambda f: F.when(f["detector_id"].startswith("llm.discovery"), 0).otherwise(1), lambda f: -priority(f["category"], REVIEW_PRIORITY), lambda f: -f["confidence"], lambda f: F.concat_ws(":", f["start"].cast("string"), f["end"].cast("string"), f["detector_id"]))


def interval_anti(findings: DataFrame, kept: DataFrame) -> DataFrame:
    """Findings that overlap none of ``kept`` in their block.

    One sort a block: of those that start before a finding's end, the greatest end tells whether one overlaps it.
    """
    block = ("doc_id", "block_ord")
    marks = kept.select(*block, F.col("start").alias("_at"), F.col("end").alias("_end"), F.lit(False).alias("_own")).dropna()
    rows = findings.withColumn("_at", F.col("end")).withColumn("_own", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    reach = F.max("_end").over(Window.partitionBy(*block).orderBy("_at").rangeBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_reach", reach).where(F.col("_own") & F.coalesce(F.col("_reach") <= F.col("start"), F.lit(True))).drop("_at", "_end", "_own", "_reach")


def dedup_exact(findings: DataFrame) -> DataFrame:
    """One finding a (document, block, span, suggestion): rules before discoveries, then confidence, then id."""
    w = Window.partitionBy("doc_id", "block_ord", "start", "end", "suggestion").orderBy(F.col("detector_id").startswith("llm.discovery"), F.desc("confidence"), "id")
    return findings.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def quota(findings: DataFrame, limit: int) -> DataFrame:
    """Of each document the first ``limit`` in the order of the review quota; in the order of the document at the end of a sort by it."""
    w = Window.partitionBy("doc_id").orderBy(~F.col("detector_id").startswith("llm.discovery."), F.col("end") - F.col("start"), -priority(F.col("category"), REVIEW_PRIORITY), "start", F.desc("confidence"), "id")
    return findings.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def rule_limit(findings: DataFrame, limit: int) -> DataFrame:
    """Of each document the first ``limit`` findings by block and start."""
    w = Window.partitionBy("doc_id").orderBy("block_ord", "start", "end", "detector_id")
    return findings.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def unwritten(findings: DataFrame, written: DataFrame) -> DataFrame:
    """Findings whose (doc_id, id) isn't among the written ones."""
    return findings.join(written.select("doc_id", "id"), ["doc_id", "id"], "left_anti")


def verdict_filter(findings: DataFrame, verdicts: DataFrame, least: float) -> DataFrame:
    """Kept findings turn to origin llm; confident drops go; without a verdict, or an unsure one, nothing changes."""
    v = verdicts.select(F.col("candidate_id").alias("id"), "verdict", F.col("confidence").alias("sure"))
    sure = F.col("verdict").isNotNull() & (F.col("sure") >= least)
    out = findings.join(v, "id", "left").where(~F.coalesce(sure & (F.col("verdict") == "drop"), F.lit(False)))
    return out.withColumn("origin", F.when(F.coalesce(sure & (F.col("verdict") == "keep"), F.lit(False)), "llm").otherwise(F.col("origin"))).drop("verdict", "sure")


def anchored(findings: DataFrame, blocks: DataFrame) -> DataFrame:
    """Findings whose text still stands at their place."""
    b = blocks.select("doc_id", "block_ord", F.col("text").alias("_text"))
    same = F.call_function("substring", F.col("_text"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("source_text")
    return findings.join(b, ["doc_id", "block_ord"]).where(same).drop("_text")


def not_ignored(source: Column, ignored: list[str], pattern: str) -> Column:
    """Whether a text, or any word in it, isn't on the request's list of ignored words."""
    words = F.array(*[F.lit(w.strip().lower()) for w in ignored]) if ignored else F.array().cast("array<string>")
    own = F.transform(F.regexp_extract_all(source, F.lit(f"({pattern})"), F.lit(1)), F.lower)
    return ~F.array_contains(words, F.lower(source)) & ~F.arrays_overlap(own, words)


def without_ignored(findings: DataFrame, ignored: list[str], pattern: str) -> DataFrame:
    """Findings whose text, or any word of it, isn't on the request's list of ignored words."""
    return findings.where(not_ignored(F.col("source_text"), ignored, pattern))
