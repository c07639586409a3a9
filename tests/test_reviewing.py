"""Review operators on small fixtures of our own."""

from pyspark.sql import functions as F

from redquill.functions import text as fn
from redquill.operators import arbitrate, chunking, detectors, reviewing
from redquill.sources.blocks import blocks_from_text


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_segments_cover_a_text_once(spark):
    texts = ["", None, "short", "One sentence here. Another one follows it, and so on. " * 20, "x" * 500, "é" * 301, "a b\nc " * 90]
    for t in texts:
        for limit in (1, 10, 50):
            spans = reviewing.segment_spans(t, limit)
            assert "".join((t or "")[a:b] for a, b in spans) == (t or "")
            assert all(reviewing.tokens_of(t[a:b]) <= limit or b - a == 1 for a, b in spans)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = reviewing.segments(blocks_from_text(docs), 10).collect()
    assert {r.doc_id for r in rows} == {2, 3, 4, 5, 6} and all(r.segment_id.endswith(f"@{r.start}:{r.end}") for r in rows)


def test_tones_merge_token_by_token(spark):
    pairs = [("BÁO CÁO  15/QĐ nội dung", "bảo cáo 15/QD nỗi dùng", "BẢO CÁO  15/QĐ nỗi dùng"), ("Một hai", "một", "Một hai"), ("Trường hợp", "trướng hop", "Trướng hợp"), ("", "", "")]
    rows = spark.createDataFrame(pairs, "s string, c string, want string").select(fn.merge_tone_only(F.col("s"), F.col("c")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)


def test_onsets_and_rimes(spark):
    words = {"nghe": 3, "giấu": 2, "quyết": 2, "gì": 1, "ăn": 0, "Đi": 1, "tr": 2}
    got = spark.createDataFrame(list(words.items()), "w string, n int").select("w", "n", fn.onset_length(F.col("w")).alias("got")).collect()
    assert all(r.n == r.got for r in got)
    cases = [("chanh", "tranh", True, False), ("sao", "sau", False, True), ("sao", "xau", False, False), ("a b", "c b", False, False)]
    for s, g, onset, rime in cases:
        r = one(spark, o=fn.onset_only(F.lit(s), F.lit(g)), r=fn.rime_only(F.lit(s), F.lit(g)))
        assert (r.o, r.r) == (onset, rime), (s, g)


def test_reviews_keep_by_their_own_priorities(spark):
    rows = [(0, 4, "technical", "a.v1", 1.0), (0, 4, "grammar", "b.v1", 0.5), (10, 12, "custom_rule", "llm.discovery.x.v2", 0.1), (11, 13, "spelling", "c.v1", 1.0), (20, 30, "spelling", "d.v1", 1.0), (24, 25, "technical", "e.v1", 0.2)]
    found = spark.createDataFrame([(a, b, "x", c, d, "", s, 0) for a, b, c, d, s in rows], "start int, end int, source_text string, category string, detector_id string, suggestion string, confidence double, detector_ord int")
    held = found.groupBy().agg(F.collect_list(F.struct(*found.columns)).cast(detectors.FINDING).alias("f"))
    kept = held.select(F.explode(arbitrate.review_order(F.col("f"), detectors.FINDING)).alias("k")).select("k.*").collect()
    assert [(r.start, r.category) for r in kept] == [(0, "grammar"), (10, "custom_rule"), (24, "technical")]


def test_noise_is_the_same_for_the_same_seed(spark):
    docs = spark.createDataFrame([(i, "Nội dung của văn bản được kiểm tra rất kỹ " * 30) for i in range(20)] + [(90, None), (91, ""), (92, "a b")], "doc_id long, text string")
    twice = [{r.doc_id: r.n for r in docs.select("doc_id", reviewing.noisy(F.col("text"), F.col("doc_id"), level, seed).alias("n")).collect()} for level, seed in (("heavy", 1), ("heavy", 1), ("heavy", 2))]
    assert twice[0] == twice[1] != twice[2] and twice[0][90] is None and twice[0][91] == ""
    assert sum(twice[0][i] != twice[0][i + 1] for i in range(19)) > 15


def test_gates_scores_and_answers(spark):
    base = spark.createDataFrame([(2048, 512, 8), (600, 512, 8), (None, None, None), (2048, 512, 65)], "context_size int, max_tokens int, batch_size int")
    assert [r.ok for r in base.select(reviewing.runtime_approved(base).alias("ok")).collect()] == [True, False, True, False]
    a, b = (spark.createDataFrame(x, "d string, s string") for x in ([("x", "1"), ("x", "2"), ("x", "2")], [("x", "2"), ("y", "3")]))
    r = reviewing.regression_scores(a, b).first()
    assert (r.hits, r.found, r.wanted, r.precision, r.recall) == (1, 2, 2, 0.5, 0.5)
    assert one(spark, b=fn.json_body(F.lit("```json\n[1]\n```"))).b == "[1]" and one(spark, r=fn.review_reason(F.lit(None).cast("string"))).r.startswith("Nội dung cần")
    contents = spark.createDataFrame([(0, r'[{"s":"\ud800"}]'), (1, "[" * 5000), (2, None)], "i int, content string")
    got = {r.i: r["items"] for r in chunking.responses(contents).collect()}
    assert got == {0: r'[{"s": "\ud800"}]', 1: None, 2: None}


def test_words_to_ignore_and_long_phrases(spark):
    docs = spark.createDataFrame([(1, "we saw it in the the end, in  THE the End")], "doc_id long, text string")
    table = spark.createDataFrame([("in the the end", "in the end", "r"), ("saw", "seen", "r")], "wrong string, right string, reason string")
    found = detectors.confusions(blocks_from_text(docs), table)
    assert sorted((r.source_text, r.suggestion) for r in found.collect()) == [("in the the end", "in the end"), ("saw", "seen")]
    assert [r.source_text for r in arbitrate.without_ignored(found, ["Saw"], fn.WORD).collect()] == ["in the the end"]
