"""Scoring a run against ground truth by exact anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANCHOR = ["doc_id", "block_id", "start", "end", "source_text"]


def outcomes(truth: DataFrame, run: DataFrame) -> DataFrame:
    """doc_id, outcome, reason, category, gt_id, finding_id, confidence.

    ``run`` has finding_ord, the order in its document. An annotation is used up by the first
    finding that it accepts; a null list of accepted suggestions takes any real change.
    """
    g = truth.select(*ANCHOR, "gt_id", "disposition", F.col("category").alias("gt_category"), "accepted_suggestions")
    rows = run.join(g, ANCHOR, "left")
    fits = F.when(F.col("accepted_suggestions").isNull(), F.col("suggestion") != F.col("source_text")).otherwise(F.array_contains("accepted_suggestions", F.col("suggestion")))
    accepted = F.coalesce((F.col("disposition") != "must_not_warn") & fits, F.lit(False))
    before = Window.partitionBy("doc_id", "gt_id").orderBy("finding_ord").rowsBetween(Window.unboundedPreceding, -1)
    used = F.col("gt_id").isNotNull() & F.coalesce(F.max(accepted.cast("int")).over(before) == 1, F.lit(False))
    reason = (
        F.when(F.col("gt_id").isNull(), "unmatched_prediction")
        .when(F.col("disposition") == "must_not_warn", "explicit_negative")
        .when(used, "duplicate_prediction")
        .when(~accepted, "suggestion_mismatch")
        .when(F.col("disposition") == "optional", "accepted_optional")
        .otherwise("accepted_required")
    )
    found = rows.withColumn("reason", reason).withColumn("outcome", F.when(F.col("reason") == "accepted_optional", "optional").when(F.col("reason") == "accepted_required", "tp").otherwise("fp"))
    found = found.select("doc_id", "outcome", "reason", F.coalesce("gt_category", "category").alias("category"), "gt_id", "finding_id", "confidence")
    met = found.where("outcome = 'tp'").select("doc_id", "gt_id")
    missed = truth.where("disposition = 'required'").join(met, ["doc_id", "gt_id"], "left_anti")
    return found.unionByName(missed.select("doc_id", F.lit("fn").alias("outcome"), F.lit("missed_required").alias("reason"), "category", "gt_id", F.lit(None).cast("string").alias("finding_id"), F.lit(None).cast("double").alias("confidence")))


def _ratios(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    p = F.when(tp + fp > 0, tp / (tp + fp)).when(F.col("gt_required") == 0, 1.0).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)
    return df.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Counters and ratios for everything, by document and by category, in one grouping-sets pass."""
    events = found.select(F.col("doc_id").cast("string").alias("doc"), "category", "outcome", "reason", F.lit(None).cast("string").alias("disposition")).unionByName(
        truth.select(F.col("doc_id").cast("string").alias("doc"), "category", F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("reason"), "disposition")
    )
    n = lambda c: F.count_if(c)
    grouped = events.groupingSets([[], ["doc"], ["category"]], "doc", "category").agg(
        F.grouping_id().alias("_g"),
        n(F.col("disposition") == "required").alias("gt_required"),
        n(F.col("disposition") == "optional").alias("gt_optional"),
        n(F.col("disposition") == "must_not_warn").alias("gt_must_not_warn"),
        n(F.col("outcome").isin("tp", "fp", "optional")).alias("findings"),
        n(F.col("outcome").isin("tp", "fp")).alias("scored_findings"),
        n(F.col("outcome") == "tp").alias("true_positive"),
        n(F.col("outcome") == "fp").alias("false_positive"),
        n(F.col("outcome") == "fn").alias("false_negative"),
        n(F.col("outcome") == "optional").alias("optional_accepted"),
        n(F.col("reason") == "explicit_negative").alias("explicit_negative_hits"),
    )
    level = F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "document").otherwise("category")
    key: Column = F.coalesce("doc", "category", F.lit(""))
    return _ratios(grouped.select(level.alias("level"), key.alias("key"), *[c for c in grouped.columns if c not in ("_g", "doc", "category")]))


def bands(found: DataFrame, certain: float = 0.9) -> DataFrame:
    """Predictions by band of confidence; a band without scored findings has precision 1."""
    rows = found.where("finding_id is not null").withColumn("band", F.when(F.col("confidence") >= certain, "certain").otherwise("uncertain"))
    out = rows.groupBy("band").agg(F.count("*").alias("findings"), F.count_if(F.col("outcome") == "tp").alias("true_positive"), F.count_if(F.col("outcome") == "fp").alias("false_positive"))
    return out.withColumn("precision", F.when(F.col("true_positive") + F.col("false_positive") > 0, F.col("true_positive") / (F.col("true_positive") + F.col("false_positive"))).otherwise(1.0))


def document_mismatch(truth_docs: DataFrame, run_docs: DataFrame) -> DataFrame:
    """doc_id, problem: documents on one side only, or with different source hashes."""
    both = truth_docs.select("doc_id", F.col("source_sha256").alias("a")).join(run_docs.select("doc_id", F.col("source_sha256").alias("b")), "doc_id", "full_outer")
    return both.select("doc_id", F.when(F.col("b").isNull(), "missing_in_run").when(F.col("a").isNull(), "missing_in_truth").when(F.col("a") != F.col("b"), "hash").alias("problem")).where("problem is not null")


def truth_violations(truth: DataFrame) -> DataFrame:
    """doc_id, problem, n: repeated ids, repeated anchors, anchors of another length than their text."""
    ids = truth.groupBy("doc_id", "gt_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit("duplicate_id").alias("problem"), "n")
    anchors = truth.groupBy(*ANCHOR).agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit("duplicate_anchor").alias("problem"), "n")
    lengths = truth.where("end - start != length(source_text)").groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit("anchor_length").alias("problem"), "n")
    return ids.unionByName(anchors).unionByName(lengths)


def nearest_rank(df: DataFrame, by: str, value: str, rank: float) -> DataFrame:
    """The value at place int((n - 1) * rank + 0.5) of each group in order."""
    w = Window.partitionBy(by)
    placed = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    return placed.where(F.col("_i") == F.floor((F.col("_n") - 1) * rank + 0.5)).select(by, F.col(value).alias("percentile"))
