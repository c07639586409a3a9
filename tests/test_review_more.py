"""Administrative capitalisation, sentences, chunks and model responses."""

from pyspark.sql import functions as F

from redquill.operators import administrative, chunking
from redquill.sources.blocks import blocks_from_text

ENTITIES = {"central_agencies": [["văn phòng chính phủ", "Văn phòng Chính phủ"]], "ministry_fields": [["y tế", "Y tế"]], "local_fields": [["y tế", "Y tế"]], "titles_and_honors": [["huân chương sao vàng", "Huân chương Sao Vàng"]], "reverence_and_events": [["đảng ta", "Đảng ta"]]}


def blocks(spark, *texts):
    return blocks_from_text(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_administrative_findings(spark):
    texts = ("văn phòng  chính phủ và bộ y tế, Bộ Y tế", "VĂN PHÒNG CHÍNH PHỦ chi cục y tế đảng ta", "Ủy Ban Nhân Dân quận 1, điều 12 chương iv điểm A", "quốc hội khóa xv ngày quốc khánh 2/9", None, "")
    found = administrative.findings(blocks(spark, *texts), administrative.entity_table(spark, ENTITIES)).collect()
    assert all(texts[r.doc_id][r.start : r.end] == r.source_text for r in found)
    assert [(r.doc_id, r.source_text, r.detector_id.split(".")[1], r.suggestion) for r in sorted(found, key=lambda r: (r.doc_id, r.start))] == [
        (0, "văn phòng  chính phủ", "agency_central", "Văn phòng Chính phủ"), (0, "bộ y tế", "ministry", "Bộ Y tế"), (1, "chi cục y tế", "agency_local", "Chi cục Y tế"), (1, "đảng ta", "reverence_or_event", "Đảng ta"),
        (2, "Ủy Ban Nhân Dân", "committee", "Ủy ban nhân dân"), (2, "quận 1", "unit_with_number", "Quận 1"), (2, "điều 12", "citation", "Điều 12"), (2, "chương iv", "citation", "Chương IV"), (2, "điểm A", "citation", "Điểm a"),
        (3, "quốc hội khóa xv", "congress_term", "Quốc hội khóa XV"), (3, "ngày quốc khánh 2/9", "holiday", "ngày Quốc khánh 2/9"),
    ]


def test_sentences_cover_all_words(spark):
    long = " ".join(f"w{i}" + ("," if i % 12 == 11 else "") for i in range(120))
    texts = ("Một. Hai! Ba?  bốn", long, "x " * 100, "", None)
    rows = chunking.sentences(blocks(spark, *texts)).collect()
    assert [(r.start, r.end) for r in sorted(rows, key=lambda r: r.start) if r.doc_id == 0] == [(0, 4), (5, 9), (10, 13), (15, 18)]
    for n, text in enumerate(texts[:3]):
        own = sorted((r.start, r.end, r.text) for r in rows if r.doc_id == n)
        assert all(text[a:b] == t and t == t.strip() for a, b, t in own)
        assert " ".join(t for _, _, t in own).split() == text.split()
    assert max(len(r.text.split()) for r in rows) <= 45


def test_chunks(spark):
    b = blocks(spark, "aaaa\nbbb\ncccccccccccc\nd\ne", "x")
    chunks = lambda df: {d: [r.chunk for r in sorted(df.collect(), key=lambda r: r.block_ord) if r.doc_id == d] for d in (0, 1)}
    assert chunks(chunking.packed(b, 8)) == {0: [0, 0, 1, 2, 2], 1: [0]}
    assert chunks(chunking.paired(b, F.length("text"), 8)) == {0: [0, 0, 1, 2, 2], 1: [0]}


def test_responses(spark):
    texts = ['[{"a": 1}]', '[{"s": "x\ny"}, {"b": 2', '[{"s": "a]}"}, {"b"', "{", None, "junk"]
    rows = chunking.responses(spark.createDataFrame(list(enumerate(texts)), "i int, content string")).orderBy("i").collect()
    assert [r["items"] for r in rows] == ['[{"a": 1}]', '[{"s": "x y"}]', '[{"s": "a]}"}]', None, None, None]
