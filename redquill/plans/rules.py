"""The rule pipeline: detect, arbitrate, explode, in one pass over the blocks and without a shuffle; and all rules with their tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redquill.functions.composed import composed, source_span
from redquill.functions.text import WORD
from redquill.operators import administrative, arbitrate, detectors, lexical


def rule_findings(blocks: DataFrame) -> DataFrame:
    """Disjoint findings of the language-neutral and onset rules."""
    found = blocks.withColumn("_f", F.concat(detectors.technical(F.col("text")), detectors.syllable_onset(F.col("text"))).cast(detectors.FINDING))
    return detectors.explode(found, arbitrate.in_start_order(F.col("_f"), detectors.FINDING))


# Characters that composition leaves as they are: Latin letters and marks of punctuation.
COMPOSED_ALREADY = r"^[\x{00}-\x{24f}\x{1ea0}-\x{1ef9}\x{2010}-\x{2027}\x{20ab}]*$"


@dataclass(frozen=True)
class Rules:
    """What a review runs: lexicons (w), known confusions (wrong, right), phrases of the administration, ignored words.

    ``limit`` ends a document's scan after the block in which so many findings were made, and keeps so many.
    """

    syllables: DataFrame | None = None
    compounds: DataFrame | None = None
    confusions: DataFrame | None = None
    entities: DataFrame | None = None
    ignored: tuple[str, ...] = ()
    technical: bool = True
    onsets: bool = True
    administrative: bool = True
    limit: int | None = None


def reviewed(blocks: DataFrame, rules: Rules) -> DataFrame:
    """Disjoint findings of all rules, in the coordinates of the text as it was given.

    Detectors see composed text. Only findings are gathered by block, which bounds them; texts stay where they are,
    but for blocks that composition changes. Defined cases: a rule without its table doesn't run; null texts have
    no findings; rows with equal (doc_id, block_id) are one block; no rows give no rows.
    """
    held = blocks.withColumn("_c", composed(F.when(~F.col("text").rlike(COMPOSED_ALREADY), F.col("text")))).withColumn("_source", F.col("text"))
    held = held.withColumn("text", F.coalesce("_c.text", "text"))
    plain = held.select("doc_id", "block_id", "block_ord", "text")
    none = F.array().cast(detectors.FINDING)
    own = F.concat(detectors.technical(F.col("text")) if rules.technical else none, detectors.syllable_onset(F.col("text")) if rules.onsets else none).cast(detectors.FINDING)
    columns = ("doc_id", "block_id", "block_ord", "start", "end", "source_text", "category", "detector_id", "suggestion", "confidence", "detector_ord")
    parts = [plain.select("doc_id", "block_id", "block_ord", F.explode_outer(own).alias("f")).where("f is not null").select("doc_id", "block_id", "block_ord", "f.*")]
    if rules.confusions is not None:
        parts.append(detectors.confusions(plain, rules.confusions))
    if rules.syllables is not None and rules.compounds is not None:
        parts.append(lexical.bigram_tones(plain, rules.syllables, rules.compounds, rules.confusions))
        parts.append(lexical.dictionary(plain, rules.syllables, rules.compounds))
    if rules.administrative:
        found = administrative.findings(plain, rules.entities).withColumn("detector_ord", F.lit(6))
        parts.append(found.withColumn("block_id", F.lit(None).cast("string")))
    rows = lexical.union(*[p.select(*columns) for p in parts])
    if rules.ignored:
        mechanical = F.col("detector_id").startswith("spacing.") | F.col("detector_id").startswith("punctuation.")
        rows = rows.where(mechanical | arbitrate.not_ignored(F.col("source_text"), list(rules.ignored), WORD))
    fields = F.struct(*[F.col(c) for c in columns[3:]])
    by_block = rows.groupBy("doc_id", "block_ord").agg(F.max("block_id").alias("block_id"), F.collect_list(fields).cast(detectors.FINDING).alias("fs"))
    if rules.limit is not None:
        before = Window.partitionBy("doc_id").orderBy("block_ord").rowsBetween(Window.unboundedPreceding, -1)
        by_block = by_block.withColumn("_n", F.coalesce(F.sum(F.size("fs")).over(before), F.lit(0))).where(F.col("_n") < rules.limit).drop("_n")
    kept = by_block.withColumn("fs", arbitrate.in_start_order(F.col("fs"), detectors.FINDING))
    # Back to the characters of the text as it was; few blocks have others.
    changed = held.where("_c is not null and _c.text != _source").select("doc_id", "block_ord", F.col("_c.places").alias("_places"), "_source")
    kept = kept.join(changed, ["doc_id", "block_ord"], "left")

    def placed(f: Column) -> Column:
        s = source_span(F.col("_source"), F.col("_places"), f["start"], f["end"])
        there = f.withField("start", s["start"]).withField("end", s["end"]).withField("source_text", s["source_text"])
        return F.when(F.col("_places").isNull(), f).otherwise(there)

    kept = kept.withColumn("fs", F.transform("fs", placed)).withColumn("block_id", F.coalesce("block_id", F.concat(F.lit("document:p"), F.col("block_ord"))))
    out = detectors.explode(kept, F.col("fs"))
    return out if rules.limit is None else arbitrate.rule_limit(out, rules.limit)
