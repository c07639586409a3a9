"""All rules in one plan, on small fixtures of our own."""

from unicodedata import normalize

from redquill.plans.rules import Rules, reviewed
from redquill.sources.blocks import blocks_from_text


def words(spark, *entries):
    return spark.createDataFrame([(w,) for w in entries], "w string")


def found(spark, texts, lexicon=False, **given):
    tables = (words(spark, "bổ", "sung", "sửa", "chữa", "chửa", "hướng", "dẫn", "đề", "điều"), words(spark, "bổ sung", "sửa chữa")) if lexicon else ()
    rules = Rules(*tables, confusions=spark.createDataFrame([("hướng dẩn", "hướng dẫn"), ("sửa chửa", "sửa chữa")], "wrong string, right string"), **given)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = reviewed(blocks_from_text(docs), rules).collect()
    for r in rows:
        assert texts[r.doc_id].split("\n")[r.block_ord][r.start : r.end] == r.source_text and r.block_id == f"document:p{r.block_ord}"
    return sorted((r.doc_id, r.block_ord, r.start, r.end, r.detector_id, r.suggestion) for r in rows)


def test_all_rules_and_places(spark):
    plain = "sửa chửa  hướng dẩn điều 12\n\nbổ sung sung đề"
    want = [(0, 0, 0, 8, "confusion.sửa_chửa.v1", "sửa chữa"), (0, 0, 8, 10, "spacing.multiple.v1", " "), (0, 0, 10, 19, "confusion.hướng_dẩn.v1", "hướng dẫn"), (0, 0, 20, 27, "administrative.citation.v1", "Điều 12"), (0, 2, 7, 12, "word.repeated.v2", "")]
    got = found(spark, [plain, None, ""], lexicon=True)
    assert [x[:3] + x[4:5] for x in got] == [x[:3] + x[4:5] for x in want]
    # The same findings in decomposed text, at places of their own.
    apart = found(spark, [normalize("NFD", plain)])
    assert [(x[1], x[4], normalize("NFC", x[5])) for x in apart] == [(x[1], x[4], x[5]) for x in got]


def test_ignored_words_and_limits(spark):
    text = "sửa chửa  hướng dẩn điều 12\nbổ sung sung  đề"
    assert [x[4] for x in found(spark, [text], ignored=("Chửa", "dẩn", "điều"))] == ["spacing.multiple.v1", "word.repeated.v2", "spacing.multiple.v1"]
    assert len(found(spark, [text], limit=2)) == 2 and {x[1] for x in found(spark, [text], limit=4)} == {0}
    assert found(spark, [text], technical=False, administrative=False, ignored=("chửa", "dẩn", "sung")) == []
