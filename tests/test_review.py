"""The text review engine: golden findings, invariants and evaluation rules."""

import re

import pytest
from pyspark.sql import functions as F

from redquill.functions import text as fn
from redquill.operators import arbitrate, detectors, evaluate
from redquill.plans.rules import rule_findings
from redquill.sources import lexicon
from redquill.sources.blocks import blocks_from_text, inspect

DOCS = [(1, "Hai  ba , bốn,năm\n\nđi đi đi ngế cế"), (2, "😀 xin xin chào ."), (3, ""), (4, None), (5, "a.b http://x, 3,5 TP.HCM !?")]


def blocks(spark, rows=DOCS):
    return blocks_from_text(spark.createDataFrame(rows, "doc_id long, text string"))


def found(spark, expression, rows=DOCS):
    return sorted((r.doc_id, r.block_ord, r.start, r.end, r.suggestion) for r in detectors.explode(blocks(spark, rows), expression).collect())


def test_blocks_keep_the_order_of_empty_lines(spark):
    assert sorted((r.doc_id, r.block_ord) for r in blocks(spark).collect()) == [(1, 0), (1, 2), (2, 0), (5, 0)]
    assert {r.doc_id: r.n_words for r in inspect(blocks(spark)).collect()}[2] == 3


def test_technical_findings_have_code_point_offsets(spark):
    t = F.col("text")
    assert found(spark, detectors.spacing_multiple(t)) == [(1, 0, 3, 5, " ")]
    assert (2, 0, 14, 16, ".") in found(spark, detectors.leading_space(t))
    assert found(spark, detectors.missing_space(t)) == [(1, 0, 13, 14, ", ")]
    assert found(spark, detectors.repeated_word(t)) == [(1, 2, 2, 5, ""), (2, 0, 5, 9, "")]


def test_onsets(spark):
    assert [(x[2], x[4]) for x in found(spark, detectors.syllable_onset(F.col("text")))] == [(9, "nghế"), (13, "kế")]


def test_findings_are_disjoint_and_anchored(spark):
    rows = rule_findings(blocks(spark)).join(blocks(spark).select("doc_id", "block_ord", "text"), ["doc_id", "block_ord"]).collect()
    assert rows
    for r in rows:
        assert r.text[r.start : r.end] == r.source_text
        assert not any(o.id != r.id and o.doc_id == r.doc_id and o.block_ord == r.block_ord and o.start < r.end and r.start < o.end for o in rows)


def test_greedy_orders_differ(spark):
    f = [(0, 4, "a", "technical", "x", "", 1.0, 0), (3, 10, "b", "spelling", "y", "", 1.0, 1), (4, 6, "c", "spelling", "z", "", 1.0, 2)]
    df = spark.createDataFrame([(f,)], f"f {detectors.FINDING}")
    starts = lambda c: [x.start for x in df.select(c.alias("o")).first().o]
    assert starts(arbitrate.in_start_order(F.col("f"), detectors.FINDING)) == [0, 4]
    assert starts(arbitrate.longest_first(F.col("f"), detectors.FINDING)) == [3]
    assert starts(arbitrate.review_order(F.col("f"), detectors.FINDING)) == [0, 4]


def test_confusions_take_the_casing(spark):
    table = lexicon.confusion_table(spark, {"chia sẽ": ("chia sẻ", "x")}, {"dành": ("giành", "y")})
    rows = detectors.confusions(blocks(spark, [(1, "Chia sẽ. CHIA SẼ, dành")]), table).collect()
    assert sorted((r.start, r.suggestion) for r in rows) == [(0, "Chia sẻ"), (9, "CHIA SẺ"), (18, "giành")]


def test_empty_lexicons_are_errors(spark, tmp_path):
    (tmp_path / "w.txt").write_text("\n \n")
    with pytest.raises(lexicon.LexiconError):
        lexicon.word_list(spark, str(tmp_path / "w.txt"))
    with pytest.raises(lexicon.LexiconError):
        lexicon.confusion_table(spark, {})


def test_vietnamese_functions(spark):
    df = spark.createDataFrame([("Đường phố Hỏi ngã",)], "t string")
    r = df.select(fn.strip_diacritics(F.col("t")).alias("a"), fn.tone_swap(F.col("t")).alias("b"), fn.detone(F.col("t")).alias("c")).first()
    assert (r.a, r.b, r.c) == ("Duong pho Hoi nga", "Đường phố Hõi ngả", "Đương phô Hoi nga")


def test_nth_occurrence(spark):
    df = spark.createDataFrame([("aXaaXa", "a", n) for n in range(5)], "t string, s string, n int")
    assert [r.o for r in df.select(fn.nth_occurrence(F.col("t"), F.col("s"), F.col("n")).alias("o")).collect()] == [m.start() for m in re.finditer("a", "aXaaXa")] + [-1]


def test_outcomes_by_order_of_findings(spark):
    truth = spark.createDataFrame([(1, "b", 0, 1, "x", "g", "required", "spelling", ["y"])], "doc_id long, block_id string, start int, end int, source_text string, gt_id string, disposition string, category string, accepted_suggestions array<string>")
    schema = "doc_id long, block_id string, start int, end int, source_text string, finding_id string, finding_ord int, category string, suggestion string, confidence double"
    run = spark.createDataFrame([(1, "b", 0, 1, "x", f"f{i}", i, "grammar", s, 0.9) for i, s in enumerate("zyzy")] + [(1, "b", 5, 6, "x", "f9", 9, "grammar", "y", 0.1)], schema)
    got = {r.finding_id: r.reason for r in evaluate.outcomes(truth, run).collect()}
    assert got == {"f0": "suggestion_mismatch", "f1": "accepted_required", "f2": "duplicate_prediction", "f3": "duplicate_prediction", "f9": "unmatched_prediction"}
    none = evaluate.scores(truth, evaluate.outcomes(truth, run.limit(0))).where("level = 'total'").first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)


def test_stream(spark, tmp_path):
    from redquill.streaming.incremental import stream_findings

    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    q = stream_findings(spark, str(tmp_path / "in"), docs.schema).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("found").count() == rule_findings(blocks(spark)).count()
