"""Text functions as Catalyst expressions. All offsets are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Vietnamese vowels by tone (none, huyền, sắc, hỏi, ngã, nặng).
VOWELS = ("aàáảãạ", "ăằắẳẵặ", "âầấẩẫậ", "eèéẻẽẹ", "êềếểễệ", "iìíỉĩị", "oòóỏõọ", "ôồốổỗộ", "ơờớởỡợ", "uùúủũụ", "ưừứửữự", "yỳýỷỹỵ")
PLAIN = dict(zip("aăâeêioôơuưy", "aaaeeiooouuy"))
WORD = r"[A-Za-zÀ-ỹĐđ]+"
EDGE = r"[\p{L}\p{N}_]"
MARKED = "đ" + "".join(v if v[0] not in "aeiouy" else v[1:] for v in VOWELS)
SPAN = "array<struct<start:int,end:int,source_text:string>>"


def _both(pairs: list[tuple[str, str]]) -> tuple[str, str]:
    every = [*pairs, *((a.upper(), b.upper()) for a, b in pairs)]
    return "".join(a for a, _ in every), "".join(b for _, b in every)


DIACRITICS = _both([(c, PLAIN[v[0]]) for v in VOWELS for c in v if c != PLAIN[v[0]]] + [("đ", "d")])
TONES = _both([(c, v[0]) for v in VOWELS for c in v[1:]])
SWAPPED = _both([(a, b) for v in VOWELS for a, b in ((v[3], v[4]), (v[4], v[3]))])


AT_ONCE = 64  # matches of one fold of spans


def spans(text: Column, pattern: str) -> Column:
    """Non-overlapping matches as (start, end, source_text): running folds over gaps and matches.

    Matches are taken ``AT_ONCE`` together and then moved behind those before them, since a fold copies what it has
    at each step. Every step binds what the next one uses more than once.
    """
    found = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps")))

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["gap"])
        end = start + F.length(row["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), row["hit"].alias("source_text"))
        return F.struct(end.alias("at"), F.array_append(state["all"], one).alias("all"))

    def part(f: Column, i: Column) -> Column:
        take = lambda c: F.slice(c, i * AT_ONCE + 1, F.lit(AT_ONCE))
        rows = F.filter(F.arrays_zip(take(f["gaps"]).alias("gap"), take(f["hits"]).alias("hit")), lambda r: r["hit"].isNotNull())
        return F.aggregate(rows, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("all")), step)

    def moved(parts: Column) -> Column:
        at = F.aggregate(parts, F.array(F.lit(0)), lambda at, p: F.array_append(at, F.element_at(at, -1) + p["at"]))
        own = lambda p, by: F.transform(p["all"], lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["source_text"].alias("source_text")))
        return F.flatten(F.zip_with(parts, F.slice(at, 1, F.size(parts)), own))

    parts = F.transform(found, lambda f: F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(f["hits"]), F.lit(AT_ONCE)).cast("int")), lambda i: part(f, i)))
    return F.when(text.rlike(pattern), F.transform(parts, moved)[0]).otherwise(F.array().cast(SPAN))


def strip_diacritics(text: Column) -> Column:
    return F.translate(text, *DIACRITICS)


def detone(text: Column) -> Column:
    return F.translate(text, *TONES)


def tone_swap(text: Column) -> Column:
    """hỏi for ngã and the other way round."""
    return F.translate(text, *SWAPPED)


def match_case(source: Column, target: Column) -> Column:
    """The casing of ``source`` (all capitals, or a capital first) on ``target``."""
    capitals = (F.length(source) > 1) & (source == F.upper(source)) & (source != F.lower(source))
    first = F.substring(source, 1, 1)
    titled = (first == F.upper(first)) & (first != F.lower(first))
    return F.when((source == "") | (target == ""), target).when(capitals, F.upper(target)).when(titled, F.concat(F.upper(F.substring(target, 1, 1)), F.call_function("substring", target, F.lit(2)))).otherwise(target)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.octet_length(text) + 2) / 3)).cast("int")


def nth_occurrence(text: Column, needle: Column, n: Column) -> Column:
    """Start of the n-th (from 0) non-overlapping occurrence; -1 if there is none."""
    start = F.lit(0)
    step = lambda at, _: F.when(at < 0, at).otherwise(F.call_function("locate", needle, text, at + 1) - 1 + F.length(needle))
    end = F.aggregate(F.sequence(F.lit(0), n), start, lambda at, i: F.when(at < 0, at).when(F.call_function("locate", needle, text, at + 1) == 0, F.lit(-1)).otherwise(step(at, i)))
    return F.when(end < 0, F.lit(-1)).otherwise(end - F.length(needle))


def occurrence_index(text: Column, needle: Column, start: Column) -> Column:
    """How many non-overlapping occurrences end at or before ``start``."""
    head = F.call_function("substring", text, F.lit(1), start)
    return F.floor((F.length(head) - F.length(F.replace(head, needle, F.lit("")))) / F.length(needle)).cast("int")


def context(text: Column, start: Column, end: Column, width: int = 240) -> Column:
    left = F.greatest(F.lit(0), start - width)
    return F.call_function("substring", text, left + 1, F.least(F.length(text), end + width) - left)


def canonical_edit(source: Column, suggestion: Column, category: Column, reason: Column) -> Column:
    """(category, reason_code) from the shape of a replacement."""
    squeeze = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
    bare = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    pick = lambda a, b: F.struct(F.lit(a).alias("category"), F.lit(b).alias("reason_code"))
    return (
        F.when(F.lower(source) == F.lower(suggestion), pick("capitalization", "capitalization"))
        .when(squeeze(source) == squeeze(suggestion), pick("technical", "spacing"))
        .when(bare(source) == bare(suggestion), pick("compound_word", "compound_word"))
        .when(F.lower(strip_diacritics(source)) == F.lower(strip_diacritics(suggestion)), pick("spelling", "diacritic"))
        .otherwise(F.struct(category.alias("category"), reason.alias("reason_code")))
    )


ADMIN_HEADING = r"(?iu)^(?:số\s*:|ký\s+hiệu\s*:|điều\s+\d+|chương\s+[ivxlcdm\d]+|mục\s+\d+|phần\s+[ivxlcdm\d]+|phụ\s+lục\s)"


# Python's white space, spelled out for Java.
SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def is_heading(text: Column) -> Column:
    """At most twelve tokens, no sentence end, and capitals throughout or on half of the words."""
    whole = F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")
    tokens = F.filter(F.split(whole, f"[{SPACE}]+"), lambda t: t != "")
    clean = F.transform(tokens, lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""))
    alpha = F.filter(clean, lambda t: t.rlike(r"^\p{L}+$"))
    upper = F.forall(alpha, lambda t: (t == F.upper(t)) & (t != F.lower(t)))
    capital = F.size(F.filter(alpha, lambda t: t.rlike(r"^\p{Lu}")))
    # The first test is what the others ask at least, and spares them for nearly all texts.
    return (text.rlike(r"\p{Lu}") | whole.rlike(ADMIN_HEADING)) & (whole != "") & (F.size(tokens) <= 12) & (whole.rlike(ADMIN_HEADING) | (~whole.rlike(r"[.!?]$") & (F.size(alpha) > 0) & (upper | (capital * 2 >= F.size(alpha)))))


def comment_text(source: Column, suggestion: Column, detector: Column, reason: Column, category: Column | None = None) -> Column:
    """The comment on a finding; the templates are fixed values."""
    clean = lambda c: F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    s, g, r = clean(source), clean(suggestion), clean(reason)
    stripped = F.regexp_replace(s, r"^\s+|\s+$", "")
    marked = F.when((stripped == "") | ((stripped == g) & (s != g)), s).otherwise(stripped)
    wrong = F.concat(F.lit("Sai: “"), marked, F.lit("”"))
    return (
        F.when((g != "") & detector.startswith("punctuation.leading_space"), F.concat(wrong, F.lit(" (thừa khoảng trắng trước dấu câu) → Đề xuất: “"), g, F.lit("”")))
        .when(g != "", F.concat(wrong, F.lit(" → Đề xuất: “"), g, F.lit("”")))
        .when(detector.startswith("word.repeated.") | (F.lit("") if category is None else category).eqNullSafe("repetition"), F.concat(wrong, F.lit(" → Đề xuất: xoá phần được bôi màu")))
        .when(detector.startswith("dictionary.unknown"), F.concat(F.lit("Lưu ý: “"), marked, F.lit("” → Từ chưa có trong từ điển tiếng Việt (kiểm tra lại chính tả hoặc tên riêng)")))
        .when(r != "", F.concat(F.lit("Lưu ý: “"), marked, F.lit("” → "), r))
        .otherwise(F.concat(wrong, F.lit(" → Đề xuất: xoá phần được bôi màu")))
    )


def highlight(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "red").otherwise("yellow")


# What a review says for each reason code.
REASONS = {
    "spelling": "Từ hoặc cụm từ có thể sai chính tả.", "diacritic": "Dấu tiếng Việt có thể được đặt chưa đúng.", "compound_word": "Cách viết từ ghép có thể chưa đúng.",
    "capitalization": "Cách viết hoa có thể chưa phù hợp.", "punctuation": "Dấu câu có thể chưa đúng vị trí hoặc cách dùng.", "spacing": "Khoảng trắng có thể chưa đúng.",
    "repetition": "Từ hoặc cụm từ có thể bị lặp không cần thiết.", "technical": "Cách trình bày kỹ thuật có thể chưa phù hợp.", "grammar": "Cấu trúc câu có thể chưa đúng ngữ pháp.",
    "word_choice": "Từ được dùng có thể chưa phù hợp với ngữ cảnh.", "custom_rule": "Nội dung có thể chưa phù hợp với quy tắc riêng.",
}


def review_reason(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(code, F.lit(""))), F.lit("Nội dung cần được kiểm tra lại."))


def onset_length(word: Column) -> Column:
    """Letters before the first vowel; gi and qu count as onsets where a vowel follows them."""
    bare = F.lower(strip_diacritics(word))
    head = F.length(F.regexp_extract(bare, "^([^aeiouy]*)", 1))
    return F.when(bare.rlike("^(?:gi|qu).*[aeiouy]"), 2).otherwise(head).cast("int")


def _parts(word: Column) -> tuple[Column, Column, Column]:
    cut = onset_length(word)
    return cut, F.lower(F.left(word, cut)), F.call_function("substring", word, cut + 1)


def onset_only(source: Column, suggestion: Column) -> Column:
    """One syllable keeps its rime and only its onset is another."""
    (c1, o1, r1), (c2, o2, r2) = _parts(source), _parts(suggestion)
    return ~F.concat(source, suggestion).rlike(f"[{SPACE}]") & (c1 > 0) & (c2 > 0) & (r1 != "") & (r1 == r2) & (o1 != o2)


def rime_only(source: Column, suggestion: Column) -> Column:
    """One syllable keeps its onset, and its rime is at most two edits away."""
    (c1, o1, r1), (c2, o2, r2) = _parts(source), _parts(suggestion)
    bare = F.when((c1 == 0) & (c2 == 0), F.levenshtein(source, suggestion) <= 2)
    return ~F.concat(source, suggestion).rlike(f"[{SPACE}]") & bare.otherwise((c1 > 0) & (c2 > 0) & (o1 == o2) & (r1 != "") & (r2 != "") & (F.levenshtein(r1, r2) <= 2))


def merge_tone_only(source: Column, candidate: Column) -> Column:
    """``source`` with the tones of ``candidate``, token by token and in the source's case; unchanged if their numbers differ."""
    token = f"[^{SPACE}]+"
    find = lambda c: F.regexp_extract_all(c, F.lit(f"({token})"), F.lit(1))
    letters = r"^\p{L}+$"

    def one(s: Column, c: Column) -> Column:
        same = s.rlike(letters) & c.rlike(letters) & (F.lower(detone(s)) == F.lower(detone(c)))
        capital = (F.left(s, F.lit(1)) != F.lower(F.left(s, F.lit(1))))
        cased = F.when((s == F.upper(s)) & (s != F.lower(s)), F.upper(c)).when(capital, F.concat(F.upper(F.left(c, F.lit(1))), F.call_function("substring", c, F.lit(2)))).otherwise(F.lower(c))
        return F.when(same, cased).otherwise(s)

    gaps, merged = F.split(source, token, -1), F.zip_with(find(source), find(candidate), one)
    whole = F.array_join(F.zip_with(gaps, F.concat(merged, F.array(F.lit(""))), lambda g, t: F.concat(g, t)), "")
    return F.when(F.size(find(source)) == F.size(find(candidate)), whole).otherwise(source)


def json_body(content: Column) -> Column:
    """A model's answer without the fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(content), r"^```[A-Za-z]*\s*", ""), r"\s*```$", "")
