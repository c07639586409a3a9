"""Model answers, localised edits and composed text on small fixtures of our own."""

import json
from unicodedata import normalize

import duckdb
from pyspark.sql import functions as F

from redquill import queries
from redquill.functions import composed
from redquill.operators import answers, chunking, localize

TARGETS = "array<struct<block_id:string,source_start:int,text:string>>"


def test_items_take_places(spark):
    targets = [("b0", 0, "mot hai mot"), ("b1", 100, "ba bon"), ("b2", 7, "ba")]
    items = [
        {"l": 1, "s": "mot", "r": "một"}, {"l": 1, "s": "mot", "r": "một"}, {"l": 1, "s": "mot", "r": "một"}, {"l": 9, "s": "bon", "r": "bốn"}, {"l": 9, "s": "ba", "r": "bà"}, {"l": 2, "s": "bon", "r": "bốn"},
        {"l": True, "s": "hai", "r": "x"}, {"l": 1.0, "s": "hai", "r": "x"}, {"l": "1", "s": "hai", "r": "x"}, {"l": 1, "s": 5, "r": "x"}, {"l": 1, "s": "hai", "r": None}, {"l": 1, "s": "hai", "r": "hai"},
        {"l": 1, "s": "hai"}, 7, None, {"l": 1, "s": "hai", "r": "a\x01"}, {"l": 1, "s": "hai", "r": "\ud800"}, {"l": 1, "s": "hai", "r": "y" * 201}, {"l": -1, "s": "", "r": "x"},
    ]
    contents = [(0, json.dumps(items), targets), (1, json.dumps({"errors": items[:1]}), targets), (2, json.dumps(items[:1] * 33), targets), (3, "nothing", targets), (4, None, targets), (5, json.dumps(items), []), (6, "[]", None)]
    rows = chunking.responses(spark.createDataFrame(contents, f"chunk_id int, content string, targets {TARGETS}"))
    got = sorted((r.chunk_id, r.item_ord, r.block_id, r.start, r.end, r.suggestion, r.reason_code) for r in answers.anchored(rows).collect())
    assert got == [
        (0, 0, "b0", 0, 3, "một", "diacritic"), (0, 1, "b0", 8, 11, "một", "diacritic"), (0, 3, "b1", 103, 106, "bốn", "diacritic"), (0, 12, "b0", 4, 7, "", "spelling"), (1, 0, "b0", 0, 3, "một", "diacritic"),
    ]


def test_verdicts_cover_their_batch(spark):
    v = lambda i, verdict="keep", confidence=0.5, **more: {"candidate_id": i, "verdict": verdict, "confidence": confidence, **more}
    good = [v("a"), v("b", "drop", 1), v("b", "keep", 0), v("z")]
    cases = [good, [v("a")], [v("a"), v("b", "maybe")], [v("a"), v("b", confidence=True)], [v("a"), v("b", confidence=1.5)], [v("a"), v("b", note=1)], [v("a"), v("b", confidence="0.5")], {}, None, [v("a"), 3, v("b", confidence=0.25)]]
    rows = [(n, ["a", "b"], json.dumps({"verdicts": c})) for n, c in enumerate(cases)] + [(90, ["a"], "{"), (91, ["a"], None), (92, ["a"], "[]")]
    got = answers.verdicts(spark.createDataFrame(rows, "batch int, accepted array<string>, content string")).collect()
    assert sorted((r.batch, r.candidate_id, r.verdict, r.confidence) for r in got) == [(0, "a", "keep", 0.5), (0, "b", "drop", 1.0), (9, "a", "keep", 0.5), (9, "b", "keep", 0.25)]


def test_edits_are_localised(spark):
    cases = [
        ("trung", "chung", "spelling", [(0, "trung", "chung")]),
        ("trể", "tệ", "spelling", []),
        ("chúng tôi đến trể", "chúng tôi đến trễ", "spelling", [(14, "trể", "trễ")]),
        ("nhà máy sản suất xi măng ở đây rồi", "nhà máy sản xuất xi măng ở đây rồi", "spelling", [(12, "suất", "xuất")]),
        ("sản suất của nhà máy bị trể rất nhiều", "sản xuất của nhà máy bị trễ rất nhiều", "spelling", [(4, "suất", "xuất"), (24, "trể", "trễ")]),
        ("một một", "một", "repetition", [(0, "một một", "một")]),
        ("xyz", "", "spelling", []),
        ("xyz", "", "repetition", [(0, "xyz", "")]),
        ("x" * 17, "", "repetition", []),
        ("BÁO CÁO", "Báo cáo", "capitalization", []),
        ("hoàn toàn khác với câu này rồi đó nhé", "zzzz", "grammar", []),
        ("hoà", normalize("NFD", "hoà"), "spelling", []),
        ("", "x", "spelling", []),
        (None, "x", "spelling", []),
        ("x", None, "spelling", []),
        ("sai", "xai", None, [(0, "sai", "xai")]),
    ]
    rows = localize.localized(spark.createDataFrame([(n, *c[:3]) for n, c in enumerate(cases)], "n int, source_text string, suggestion string, reason_code string")).orderBy("n").collect()
    for r, (*_, want) in zip(rows, cases):
        assert [tuple(e) for e in r.edits] == want, r
        assert all(r.source_text[e.offset : e.offset + len(e.source_text)] == e.source_text for e in r.edits)


def test_composed_text_keeps_its_places(spark):
    texts = ["", None, "abc", normalize("NFD", "Tiếng Việt đẹp"), "́á", "ệx"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("c", composed.composed(F.col("t"))).orderBy("i").collect()
    for r in rows:
        if r.t is None:
            assert r.c is None
            continue
        assert r.c.text == normalize("NFC", r.t) and len(r.c.places) == len(r.c.text)
        assert all(normalize("NFC", r.t[p.s : p.e]) == c for c, p in zip(r.c.text, r.c.places))
    whole = spark.createDataFrame([(texts[3], 6, 10), ("abc", 5, 9), ("", 0, 1)], "t string, a int, b int").withColumn("c", composed.composed(F.col("t")))
    got = [r[0] for r in whole.select(composed.source_span(F.col("t"), F.col("c.places"), F.col("a"), F.col("b"))).collect()]
    assert normalize("NFC", got[0].source_text) == "Việt" and (got[1].start, got[1].end, got[2].start) == (5, 9, 0)


def test_composed_text_is_its_sql_on_odd_texts(spark, tmp_path):
    jamo, signs, mark = "\u1100\u1161\u1100\u1161\u11a8", "\u09c7\u09be \u0dd9\u0dcf\u0dca", "e\u0f73\u0301"
    texts = [None, "", "é", "\u0301é", normalize("NFD", "Tiếng Việt 한국어 क़"), jamo, signs, mark, "\n", "é" + jamo + signs + mark + "é"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(queries.REGISTRY["composed_text"][1]).fetchall())
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for mode in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", mode)
            assert sorted(tuple(r) for r in queries.composed_text(spark, str(tmp_path)).collect()) == want
    finally:
        spark.conf.set("spark.sql.ansi.enabled", ansi)
    for t in texts[1:]:
        text, starts, ends = composed.composed_text(t, whole=True)
        assert text == normalize("NFC", t) and all(normalize("NFC", t[s:e]).count(c) for c, s, e in zip(text, starts, ends))
