"""Capitalisation of administrative names: phrase tables and numbered units, citations, terms and holidays.

Phrases are found by an equi-join on their first word, restricted to words that start a phrase, and
then compared whole; patterns are array expressions on the block row. The longest finding wins.

Defined cases: null and empty texts have no findings; a phrase in capitals or already as proposed is none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redquill.functions.text import EDGE, spans
from redquill.operators import arbitrate
from redquill.operators.detectors import FINDING, SPACE
from redquill.sources.lexicon import LexiconError

# Groups of the entity file in the order of their detectors.
GROUPS = (
    ("agency_central", ("central_agencies",)), ("ministry", ("ministry_fields",)), ("agency_local", ("local_fields",)), ("corporation", ("state_corporations",)), ("institution", ("major_institutions",)),
    ("law", ("laws_and_codes",)), ("geography", ("geographic_regions",)), ("position_or_honor", ("high_level_positions", "titles_and_honors", "reverence_and_events")),
)
PREFIXES = {"ministry": (("bộ", "Bộ"),), "agency_local": (("sở", "Sở"), ("phòng", "Phòng"), ("chi cục", "Chi cục"), ("cục", "Cục"), ("ban", "Ban"))}
REVERENCE = ("đảng", "bác hồ", "hồ chí minh", "tết", "cách mạng", "chiến dịch", "quân đội nhân dân", "công an nhân dân")
HOLIDAYS = {
    "quốc khánh 2/9": "Quốc khánh 2/9", "quốc tế lao động 1/5": "Quốc tế Lao động 1/5", "giải phóng miền nam 30/4": "Giải phóng miền Nam 30/4", "thương binh - liệt sĩ 27/7": "Thương binh - Liệt sĩ 27/7",
    "thương binh-liệt sĩ 27/7": "Thương binh - Liệt sĩ 27/7", "nhà giáo việt nam 20/11": "Nhà giáo Việt Nam 20/11", "thầy thuốc việt nam 27/2": "Thầy thuốc Việt Nam 27/2",
    "phụ nữ việt nam 20/10": "Phụ nữ Việt Nam 20/10", "quốc tế phụ nữ 8/3": "Quốc tế Phụ nữ 8/3", "thành lập quân đội nhân dân việt nam 22/12": "Thành lập Quân đội nhân dân Việt Nam 22/12",
    "giỗ tổ hùng vương": "Giỗ Tổ Hùng Vương", "toàn quốc kháng chiến 19/12": "Toàn quốc kháng chiến 19/12", "bác hồ ra đi tìm đường cứu nước 5/6": "Bác Hồ ra đi tìm đường cứu nước 5/6",
}
UNITS = ("quận", "phường", "tổ dân phố", "thôn", "ấp", "xóm", "khu phố", "quân khu", "quân đoàn")
CITED = ("điều", "khoản", "điểm", "phụ lục", "chương", "mục", "phần")
TERMS = {
    "quốc hội khóa": "Quốc hội khóa", "đại hội đại biểu toàn quốc lần thứ": "Đại hội đại biểu toàn quốc lần thứ", "đại hội đảng toàn quốc lần thứ": "Đại hội Đảng toàn quốc lần thứ",
    "ban chấp hành trung ương đảng khóa": "Ban Chấp hành Trung ương Đảng khóa", "hội đồng nhân dân khóa": "Hội đồng nhân dân khóa",
}
COMMITTEES = ("ủy ban nhân dân", "hội đồng nhân dân")
BLANK = f"[{SPACE}]"
WORDS = r"[\p{L}\p{N}_]+"


def entity_table(spark: SparkSession, entities: dict[str, list[list[str]]]) -> DataFrame:
    """ord, rule_id, phrase (lower case, single spaces), proper, first, n_words of an entity file's groups."""
    rows = []
    for rule, names in GROUPS:
        for wrong, right in (pair for name in names for pair in entities.get(name, [])):
            for low, proper in PREFIXES.get(rule, (("", ""),)):
                phrase, target = f"{low} {wrong}".strip().lower(), f"{proper} {right}".strip()
                own = "reverence_or_event" if rule == "position_or_honor" and any(k in target.lower() for k in REVERENCE) else rule
                rows.append((len(rows), own, " ".join(phrase.split()), target))
    if not rows:
        raise LexiconError("no administrative entities")
    table = spark.createDataFrame(rows, "ord int, rule_id string, phrase string, proper string")
    found = F.regexp_extract_all("phrase", F.lit(f"({WORDS})"), F.lit(1))
    return table.select("*", F.get(found, F.lit(0)).alias("first"), F.size(found).alias("n_words"))


def _finding(start: Column, end: Column, source: Column, rule: Column, suggestion: Column, order: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), source.alias("source_text"), F.lit("capitalization").alias("category"), F.concat(F.lit("administrative."), rule, F.lit(".v1")).alias("detector_id"), suggestion.alias("suggestion"), F.lit(0.98).alias("confidence"), order.alias("detector_ord"))


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(c, f"{BLANK}+", " ")


def phrase_findings(blocks: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, block_ord, f: every place of every phrase, whatever its casing and white space."""
    firsts = [r.first for r in table.select("first").distinct().limit(10_001).collect()]
    if len(firsts) > 10_000:
        raise LexiconError("more than 10,000 words start a phrase")
    known = F.array(*[F.lit(w) for w in firsts])
    tokens = blocks.select("doc_id", "block_ord", "text", spans(F.col("text"), WORDS).alias("w"))
    places = F.filter(F.transform("w", lambda t, i: F.struct(i.alias("i"), F.lower(t["source_text"]).alias("first"))), lambda p: F.array_contains(known, p["first"]))
    starts = tokens.select("doc_id", "block_ord", "text", "w", F.explode(places).alias("p")).select("doc_id", "block_ord", "text", "w", "p.i", "p.first")
    start, end = F.get("w", F.col("i"))["start"], F.get("w", F.col("i") + F.col("n_words") - 1)["end"]
    rows = starts.join(table, "first").withColumn("start", start).withColumn("end", end).where("end is not null")
    rows = rows.withColumn("source", F.call_function("substring", F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))).where(F.lower(_squeezed(F.col("source"))) == F.col("phrase"))
    return rows.select("doc_id", "block_ord", _finding(F.col("start"), F.col("end"), F.col("source"), F.col("rule_id"), F.col("proper"), F.col("ord")).alias("f"))


def _pattern(names: tuple[str, ...], tail: str = "") -> str:
    inner = "|".join(n.replace(" - ", f"{BLANK}*-{BLANK}*").replace(" ", f"{BLANK}+") for n in names)
    return f"(?iu)(?<!{EDGE})(?:{inner}){tail}(?!{EDGE})"


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.call_function("substring", c, F.lit(2)))


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def pattern_findings(text: Column) -> Column:
    """Findings of committees, numbered units, citations, congress terms and holidays."""
    number = f"{BLANK}+([0-9ivxlcdm]+)"
    parts = lambda m: (F.regexp_replace(m["source_text"], f"{BLANK}+[^{SPACE}]+$", ""), F.regexp_extract(m["source_text"], f"([^{SPACE}]+)$", 1))

    def each(pattern: str, rule: str, order: int, suggest) -> Column:
        return F.transform(spans(text, pattern), lambda m: _finding(m["start"], m["end"], m["source_text"], F.lit(rule), suggest(m), F.lit(order)))

    def committee(m: Column) -> Column:
        return F.when(F.contains(F.lower(m["source_text"]), F.lit("ủy ban")), "Ủy ban nhân dân").otherwise("Hội đồng nhân dân")

    def unit(m: Column) -> Column:
        name, value = parts(m)
        return F.concat(_capital(F.lower(name)), F.lit(" "), value)

    def citation(m: Column) -> Column:
        name, value = parts(m)
        low = F.lower(name)
        shaped = F.when(low.isin("phụ lục", "chương", "phần") & F.lower(value).rlike("^[ivxlcdm]+$"), F.upper(value)).when(low == "điểm", F.lower(value)).otherwise(value)
        return F.concat(_capital(low), F.lit(" "), shaped)

    def term(m: Column) -> Column:
        name, value = parts(m)
        return F.concat(_lookup(TERMS, _squeezed(F.lower(name))), F.lit(" "), F.upper(value))

    def holiday(m: Column) -> Column:
        key = _squeezed(F.regexp_replace(F.lower(m["source_text"]), f"^ngày{BLANK}+", ""))
        return F.concat(F.lit("ngày "), _lookup(HOLIDAYS, key))

    every = F.concat(
        each(_pattern(COMMITTEES), "committee", 10_001, committee),
        each(_pattern(UNITS, rf"{BLANK}+(\p{{Nd}}+|[a-zđ])"), "unit_with_number", 10_002, unit),
        each(_pattern(CITED, f"{BLANK}+([0-9ivxlcdm]+|[a-zđ])"), "citation", 10_003, citation),
        each(_pattern(tuple(TERMS), number), "congress_term", 10_004, term),
        each(_pattern(tuple("ngày " + h for h in HOLIDAYS if "-liệt" not in h)), "holiday", 10_005, holiday),
    )
    return F.filter(every, lambda f: f["suggestion"].isNotNull())


def resolved(findings: Column) -> Column:
    """Findings that change something and aren't in capitals throughout; the longest wins, then the first."""
    letters = lambda c: F.regexp_replace(c, r"\P{L}", "")

    def wanted(f: Column) -> Column:
        own = letters(f["source_text"])
        return (_squeezed(f["source_text"]) != f["suggestion"]) & ~((F.length(own) >= 2) & ~own.rlike(r"\P{Lu}"))

    return arbitrate.greedy(F.filter(findings, wanted), FINDING, lambda f: f["start"] - f["end"], lambda f: f["start"], lambda f: f["detector_ord"])


def findings(blocks: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """doc_id, block_ord, f: the resolved findings of all rules; phrases are gathered by block, bounded by its text."""
    own = blocks.select("doc_id", "block_ord", pattern_findings(F.col("text")).cast(FINDING).alias("fs")).where("size(fs) > 0")
    if table is not None:
        phrases = phrase_findings(blocks, table).groupBy("doc_id", "block_ord").agg(F.collect_list("f").cast(FINDING).alias("ps"))
        none = F.array().cast(FINDING)
        own = own.join(phrases, ["doc_id", "block_ord"], "full").select("doc_id", "block_ord", F.concat(F.coalesce("fs", none), F.coalesce("ps", none)).alias("fs"))
    return own.select("doc_id", "block_ord", F.explode(resolved(F.col("fs"))).alias("f")).select("doc_id", "block_ord", "f.*")


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
