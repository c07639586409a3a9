"""What large tables and long texts ask of the review operators."""

import json
import tracemalloc
from unicodedata import normalize

from pyspark.sql import functions as F

from redquill import queries
from redquill.functions import composed
from redquill.functions import text as fn
from redquill.operators import answers, arbitrate, detectors, localize
from redquill.sources.blocks import blocks_from_text


def test_composed_text_holds_no_object_a_character(spark):
    texts = ["é và một câu dài hơn " * 2000] * 30 + [None, "", "́a", "क़", "가"]
    tracemalloc.start()
    found = composed.composed_array(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = sum(len(t or "") for t in texts)
    assert most < 60 * n, most / n
    assert found[0].as_py()["text"] == normalize("NFC", texts[0]) and found[30].as_py() is None and found[31].as_py() == {"text": "", "places": []}
    held = [p for p in composed.pieces(texts * 3)]
    assert [t for p in held for t in p] == texts * 3 and all(len(p) == 1 or sum(len(t or "") for t in p) <= composed.PIECE for p in held)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("c", composed.composed(F.col("t"))).orderBy("i").select("c.text", F.size("c.places").alias("n")).collect()
    assert [r.text for r in rows] == [None if t is None else "क़" if t == "क़" else t if t == "가" else normalize("NFC", t) for t in texts]


def exchanges(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Window") + df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_spans_of_many_matches_are_those_of_few(spark):
    texts = [None, "", "  ", "a", "a b", "é " * 63, "é " * 64 + "x", "é ể " * 500, " y" * 129]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(fn.spans(F.col("t"), r"\p{L}").alias("m")).collect()
    assert [[tuple(x) for x in r.m] for r in rows] == [[(i, i + 1, c) for i, c in enumerate(t or "") if c != " "] for t in texts]


def test_findings_meet_intervals_in_one_sort(spark):
    found = spark.createDataFrame([(1, 0, a, a + n) for a in range(0, 40, 2) for n in (0, 1, 5)] + [(2, 0, 1, 3), (None, 0, 1, 3), (1, 1, 0, 9)], "doc_id long, block_ord int, start int, end int")
    kept = spark.createDataFrame([(1, 0, 3, 6), (1, 0, 4, 5), (1, 0, 20, 30), (1, 0, 21, 21), (None, 0, 1, 3), (1, 1, 9, 12), (1, 1, 0, 0)], "doc_id long, block_ord int, start int, end int")
    spans = [tuple(r) for r in kept.collect()]
    want = sorted(str(tuple(f)) for f in found.collect() if not any(f[0] is not None and (f[0], f[1]) == k[:2] and f[2] < k[3] and k[2] < f[3] for k in spans))
    out = arbitrate.interval_anti(found, kept)
    assert sorted(str(tuple(r)) for r in out.collect()) == want and out.columns == found.columns
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_grams_meet_a_lexicon_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "Of the, of  THE and the and\nnothing ſee thand_ of off the and"), (2, None), (3, "ſhe İs K")], "doc_id long, text string")
    table = spark.createDataFrame([("the and", "then and", "r"), ("of the", "off the", "r"), ("of  the and", "x", "r"), ("thand", "than", "r"), ("k", "q", "r"), ("the", "thee", "r")], "wrong string, right string, reason string")
    found = detectors.confusions(blocks_from_text(docs), table)
    got = sorted((r.doc_id, r.block_ord, r.start, r.end, r.source_text) for r in found.collect())
    assert got == [(1, 0, 0, 6, "Of the"), (1, 0, 3, 6, "the"), (1, 0, 8, 19, "of  THE and"), (1, 0, 12, 15, "THE"), (1, 0, 12, 19, "THE and"), (1, 0, 20, 23, "the"), (1, 0, 20, 27, "the and"), (1, 1, 26, 29, "the"), (1, 1, 26, 33, "the and"), (3, 0, 7, 8, "K")]
    assert not exchanges(found)
    dotted = spark.createDataFrame([("i̇s k", "x", "r")], "wrong string, right string, reason string")
    assert [r.source_text for r in detectors.confusions(blocks_from_text(docs), dotted).collect()] == ["İs K"]


def test_items_stay_in_their_row(spark):
    targets = [("b0", 0, "mot hai mot"), ("b1", 100, "ba bon")]
    items = json.dumps([{"l": 1, "s": "mot", "r": "một"}, {"l": 1, "s": "mot", "r": "một"}, {"l": 7, "s": "bon", "r": "x"}, {"l": 2, "s": "bon", "r": "x"}])
    rows = spark.createDataFrame([(0, items, targets), (0, items, targets), (1, items, None)], "chunk_id int, items string, targets array<struct<block_id:string,source_start:int,text:string>>")
    out = answers.anchored(rows)
    assert sorted((r.item_ord, r.block_id, r.start) for r in out.collect()) == [(0, "b0", 0)] * 2 + [(1, "b0", 8)] * 2 + [(2, "b1", 103)] * 2
    assert not exchanges(out)


def test_regions_are_proposed_last_and_words_fill_all_tasks(spark, tmp_path):
    assert {e["kind"] for e in localize.proposals("trể hay trể", "trễ hay trễ", "spelling", False)} == {0, 1}
    assert {e["kind"] for e in localize.proposals("trể hay trể", "trễ hay trễ", "spelling", True)} == {2}
    spark.createDataFrame([(1, "the they these there")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.localized_edits(spark, str(tmp_path))
    assert "RoundRobinPartitioning" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.w, r.offset) for r in found.collect()) == [("the", 0), ("there", 0), ("these", 0), ("they", 0)]
