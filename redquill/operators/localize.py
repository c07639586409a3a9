"""Replacements of a model cut down to what they change.

A Python step proposes edits (it needs a sequence matcher): the whole replacement or its changed middle, then
one edit a token, then one a changed region. Which proposals are safe is a Column expression. The first kind
that has a safe edit counts; regions are proposed where no other kind has one.

Defined cases: nulls and empty sources have no edits; texts that are equal in NFC neither; edits come in the
order of the source; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from os.path import commonprefix
from unicodedata import normalize

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redquill.functions import text as fn

# The reason codes by what is asked of an edit, and the limits of a short one.
BY_WORD = ("spelling", "capitalization", "word_choice", "diacritic")
ORTHOGRAPHIC = ("spelling", "compound_word", "capitalization")
MAY_DELETE = ("punctuation", "repetition", "spacing", "technical")
LONGEST, MOST_WORDS = 32, 4

LETTERS = regex.compile(r"[\p{L}\p{N}\p{M}]*")
WORDS = regex.compile(r"[\p{L}\p{N}]+")
BLANK = regex.compile(r"(\s+)")
EDITS = "array<struct<kind:int,offset:int,source_text:string,suggestion:string>>"


def ends(a: str, b: str) -> tuple[int, int]:
    """Lengths of the common start and of the common end behind it."""
    p = len(commonprefix((a, b)))
    return p, len(commonprefix((a[p:][::-1], b[p:][::-1])))


def grown(text: str, start: int, end: int) -> tuple[int, int]:
    """A span with the whole words that it touches."""
    back = text[:start][::-1]
    return start - LETTERS.match(back).end(), LETTERS.match(text, end).end()


def broad(source: str, fix: str) -> bool:
    """Whether a replacement spans more than a short edit does, or loses much of its source."""
    n, m = len(WORDS.findall(source)), len(WORDS.findall(fix))
    lost = len(source) - len(fix)
    return len(source) > LONGEST or n > MOST_WORDS or (len(source) > 24 and lost > len(fix)) or (n >= MOST_WORDS and n - m >= 2 and lost >= 12)


def apart(a: str, b: str) -> bool:
    """Whether unchanged text of weight lies between two changes."""
    kept = (a[m.a : m.a + m.size] for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    return any(len(k) >= 3 or BLANK.search(k) for k in kept)


def whole_edit(source: str, fix: str, reason: str) -> list[tuple[int, str, str]]:
    """The replacement as one edit: itself, or its changed middle if enough around it is the same."""
    p, q = ends(source, fix)
    blanks = [BLANK.findall(x) for x in (source, fix)]
    by_word = reason in BY_WORD or (reason == "compound_word" and blanks[0] == blanks[1])
    same = source[:p] + source[len(source) - q :]
    held, wide = sum(map(str.isalnum, same)) >= 2, broad(source, fix)
    itself = [] if wide else [(0, source, fix)]
    if not held or not (wide or by_word):
        return itself
    spans = [(p, len(source) - q), (p, len(fix) - q)]
    if apart(source[slice(*spans[0])], fix[slice(*spans[1])]):
        return itself
    if by_word:
        spans = [grown(source, *spans[0]), grown(fix, *spans[1])]
    return [(spans[0][0], source[slice(*spans[0])], fix[slice(*spans[1])])]


def token_edits(source: str, fix: str, reason: str) -> list[tuple[int, str, str]]:
    """One edit a changed token, where both sides have equally many."""
    left, right = BLANK.split(source), BLANK.split(fix)
    if len(left) != len(right) or len(left) < 3:
        return []
    out, at = [], 0
    for a, b in zip(left, right):
        if a != b:
            p, q = ends(a, b)
            spans = [(p, len(a) - q), (p, len(b) - q)]
            if reason in BY_WORD or reason == "compound_word":
                spans = [grown(a, *spans[0]), grown(b, *spans[1])]
            out.append((at + spans[0][0], a[slice(*spans[0])], b[slice(*spans[1])]))
        at += len(a)
    return out


def region_edits(source: str, fix: str) -> list[tuple[int, str, str]]:
    """One edit a changed region with its whole words; regions that meet are one."""
    regions: list[list[int]] = []
    for tag, a, b, c, d in SequenceMatcher(None, source, fix, autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        (a, b), (c, d) = grown(source, a, b), grown(fix, c, d)
        if regions and a <= regions[-1][1]:
            regions[-1][1], regions[-1][3] = max(regions[-1][1], b), max(regions[-1][3], d)
        else:
            regions.append([a, b, c, d])
    return [(a, source[a:b], fix[c:d]) for a, b, c, d in regions]


def proposals(source: str | None, fix: str | None, reason: str | None, regions: bool) -> list[dict]:
    """Edits, safe or not, with their kind: 0 the whole replacement and 1 by tokens, or 2 by ``regions``."""
    if not source or fix is None or normalize("NFC", source) == normalize("NFC", fix):
        return []
    kinds = {2: region_edits(source, fix)} if regions else {0: whole_edit(source, fix, reason), 1: token_edits(source, fix, reason)}
    return [dict(zip(("kind", "offset", "source_text", "suggestion"), (kind, *e))) for kind, edits in kinds.items() for e in edits]


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{fn.SPACE}]+|[{fn.SPACE}]+$", "")


def safe(source: Column, fix: Column, reason: Column) -> Column:
    """Whether an edit is short, changes something, deletes only where its reason allows, and is no guessed rewrite."""
    words = F.size(F.regexp_extract_all(source, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    bare = lambda c: F.lower(fn.strip_diacritics(c))
    marks = lambda c: F.regexp_replace(c, r"[\p{L}\p{N}]", "")
    letters = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    capitals = (source == F.upper(source)) & (source != F.lower(source)) & (F.length(source) >= 2)
    related = (bare(source) == bare(fix)) | (F.levenshtein(source, fix) <= 1) | fn.onset_only(source, fix) | fn.rime_only(source, fix)
    pure = (marks(source) == marks(fix)) | (letters(source) == letters(fix))
    far = F.greatest(F.lit(2), F.least(F.lit(3), F.floor((F.greatest(F.length(source), F.length(fix)) + 6) / 7)))
    distance = F.when(reason == "capitalization", F.levenshtein(F.lower(source), F.lower(fix))).otherwise(F.levenshtein(source, fix))
    short = (source != "") & (F.length(source) <= LONGEST) & (words <= MOST_WORDS) & (_trimmed(source) != _trimmed(fix))
    deletes = (fix == "") & ~(reason.isin(*MAY_DELETE) & (F.length(source) <= 16))
    return F.coalesce(short & ~deletes & ~((reason == "capitalization") & capitals) & (~reason.isin(*ORTHOGRAPHIC) | (related & pure & (distance <= far))), F.lit(False))


def localized(rows: DataFrame, source: str = "source_text", fix: str = "suggestion", reason: str = "reason_code") -> DataFrame:
    """``rows`` with edits: (offset, source_text, suggestion) of every safe edit in a replacement.

    A deletion is judged before a heading's case is kept: in headings only tones may change.
    """

    def proposed(regions: bool):
        @F.pandas_udf(EDITS)
        def propose(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for columns in batches:
                yield pd.Series([proposals(*x, regions) for x in zip(*columns)], dtype=object)

        # Not to be merged into what uses its result: Spark can't evaluate one such step inside another.
        return propose.asNondeterministic()

    why = F.coalesce(F.col(reason), F.lit(""))
    deletable = lambda e: (e["suggestion"] != "") | (why.isin(*MAY_DELETE) & (F.length(e["source_text"]) <= 16))
    toned = lambda e: e.withField("suggestion", F.when(fn.is_heading(e["source_text"]), fn.merge_tone_only(e["source_text"], e["suggestion"])).otherwise(e["suggestion"]))

    def kept(edits: Column) -> Column:
        return F.filter(F.transform(F.filter(edits, deletable), toned), lambda e: safe(e["source_text"], e["suggestion"], why))

    # Edits of the least kind; every step is bound, so that none is worked out twice.
    best = F.transform(F.array(kept(proposed(False)(F.col(source), F.col(fix), why))), lambda k: F.struct(k.alias("k"), F.array_min(F.transform(k, lambda e: e["kind"])).alias("least")))
    best = F.transform(best, lambda b: F.filter(b["k"], lambda e: e["kind"] == b["least"]))
    rows = rows.withColumn("_first", best[0])
    # Regions, the dearest, are only looked for where the kinds before them have no safe edit.
    rows = rows.withColumn("_regions", kept(proposed(True)(F.when(F.size("_first") == 0, F.col(source)), F.col(fix), why)))
    edits = F.transform(F.when(F.size("_first") > 0, F.col("_first")).otherwise(F.col("_regions")), lambda e: e.dropFields("kind"))
    return rows.withColumn("edits", edits).drop("_first", "_regions")
