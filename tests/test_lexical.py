"""Dictionary operators against plain Python over the same lexicon."""

from redquill.operators import lexical
from redquill.sources.blocks import blocks_from_text

SYLLABLES = ["bổ", "sung", "hướng", "dẫn", "dễ", "hiểu", "sửa", "chữa", "chửa", "sữa", "đề", "xuất", "nghiệp", "thường", "hợp", "trí", "bố", "kỹ", "thuật", "kỷ", "luật"]
COMPOUNDS = ["bổ sung", "hướng dẫn", "dễ hiểu", "sửa chữa", "đề xuất", "bố trí", "kỹ thuật", "kỷ luật"]


def words(spark, entries):
    return spark.createDataFrame([(w,) for w in entries], "w string")


def lexicons(spark):
    return words(spark, SYLLABLES), words(spark, COMPOUNDS)


def test_corrections_in_order(spark):
    rows = lexical.corrections(words(spark, ["nghiêp", "thừơng", "dẩn", "xung", "zzz", ""]), words(spark, SYLLABLES)).orderBy("w", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r.w, []).append(r.cand)
    assert got == {"nghiêp": ["nghiệp"], "thừơng": ["thường"], "dẩn": ["dẫn"], "xung": ["sung"]}


def test_splits(spark):
    found = lexical.splits(words(spark, ["bổsung", "dẫnsung", "sửachửa", "đềsuất", "a", "xyz"]), *lexicons(spark)).collect()
    assert {r.w: (r.at, r.cand) for r in found} == {
        "bổsung": (2, "bổ sung"), "sửachửa": (None, "sửa chữa"), "đềsuất": (None, "đề xuất"),
    }


def test_dictionary_findings(spark):
    docs = spark.createDataFrame([(1, "BổSung hướng dẩn, NGHIÊP ế"), (2, None), (3, "plain text")], "doc_id long, text string")
    got = sorted((r.start, r.source_text, r.detector_id, r.suggestion, r.confidence) for r in lexical.dictionary(blocks_from_text(docs), *lexicons(spark)).collect())
    assert got == [
        (0, "BổSung", "dictionary.syllable.v1", "Bổ Sung", 0.95), (13, "dẩn", "dictionary.syllable.v1", "dẫn", 0.95),
        (18, "NGHIÊP", "dictionary.syllable.v1", "NGHIỆP", 0.95), (25, "ế", "dictionary.unknown.v1", "", 0.8),
    ]
    left = lexical.dictionary(blocks_from_text(docs), *lexicons(spark), ignored=["Dẩn"]).count()
    assert left == 3


def test_pairs_with_wrong_tones(spark):
    docs = spark.createDataFrame([(1, "Sữa  chửa kỷ thuật kỷ luật")], "doc_id long, text string")
    found = lexical.bigram_tones(blocks_from_text(docs), *lexicons(spark)).collect()
    assert sorted((r.start, r.end, r.detector_id, r.suggestion) for r in found) == [(0, 9, "confusion.sữa_chửa.v1", "Sửa chữa"), (10, 18, "confusion.kỷ_thuật.v1", "kỹ thuật")]
    more = lexical.tone_confusions(spark.createDataFrame([("kỹ", "luật"), ("kỷ", "luật")], "n1 string, n2 string"), *lexicons(spark)).collect()
    assert [(r.n1, r.cand) for r in more] == [("kỹ", "kỷ luật")]
