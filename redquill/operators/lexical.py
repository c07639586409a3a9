"""Dictionary detectors: candidates for words outside the lexicon, glued words and wrong tones in pairs.

Everything is looked up once a distinct word (or pair), by equi-joins on the lexicons, and joined back
to the places where it stands: work grows with the vocabulary, not with the text. Lexicons are tables
with one column ``w``, lower case; a side is broadcast only if the optimizer knows it to be small.

Defined cases: null and empty texts have no words; without a lexicon entry nothing is a suggestion.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redquill.functions.text import MARKED, VOWELS, match_case, tone_swap
from redquill.operators.detectors import bigrams, words

# Horns typed on the wrong letter, in the order in which they are tried.
DOUBLE_HORN = (("ừơ", "ườ"), ("ứơ", "ướ"), ("ửơ", "ưở"), ("ữơ", "ưỡ"), ("ựơ", "ượ"), ("ườ", "ườ"), ("ướ", "ướ"), ("ưở", "ưở"), ("ưỡ", "ưỡ"), ("ượ", "ượ"))
# Letters that are written for one another, in the order in which they are tried.
REPLACEMENTS = (
    ("dz", "d"), ("ch", "tr"), ("d", "đ"), ("đ", "d"), ("d", "gi"), ("f", "ph"), ("g", "gh"), ("gh", "g"), ("gi", "d"), ("j", "g"), ("ng", "ngh"), ("ngh", "ng"),
    ("ou", "uo"), ("ou", "ươ"), ("uo", "ươ"), ("s", "x"), ("tr", "ch"), ("x", "s"), ("w", "qu"), ("z", "d"), ("ng", "n"), ("n", "ng"), ("c", "t"), ("t", "c"),
    ("o", "ô"), ("ô", "o"), ("e", "ê"), ("ê", "e"), ("oi", "ơi"), ("ơi", "oi"), ("r", "d"), ("d", "r"), ("r", "gi"), ("gi", "r"), ("l", "n"), ("n", "l"),
)


def _sub(text: Column, start: Column | int, length: Column | None = None) -> Column:
    at = F.lit(start) if isinstance(start, int) else start
    return F.call_function("substring", text, at, *([] if length is None else [length]))


def replace_first(text: Column, old: str, new: str) -> Column:
    """``text`` with its first ``old`` replaced; null if it has none."""
    at = F.locate(old, text) if not isinstance(text, Column) else F.call_function("locate", F.lit(old), text)
    return F.when(at > 0, F.concat(_sub(text, 1, at - 1), F.lit(new), _sub(text, at + len(old))))


def replacements(text: Column) -> Column:
    """An array with the outcome of every replacement rule, null where it doesn't apply."""
    return F.array(*[replace_first(text, a, b) for a, b in REPLACEMENTS])


def tone_variants(text: Column) -> Column:
    """Every word that differs in the tone of one vowel, by place and then by tone."""
    families = F.array(*[F.lit(v) for v in VOWELS])

    def at(i: Column) -> Column:
        own = _sub(text, i, F.lit(1))
        family = F.coalesce(F.get(F.filter(families, lambda v: F.contains(v, own)), F.lit(0)), F.lit(""))
        others = F.filter(F.split(family, ""), lambda c: (c != own) & (c != ""))
        return F.transform(others, lambda c: F.concat(_sub(text, 1, i - 1), c, _sub(text, i + 1)))

    return F.when(F.length(text) > 0, F.flatten(F.transform(F.sequence(F.lit(1), F.length(text)), at))).otherwise(F.array().cast("array<string>"))


def corrections(tokens: DataFrame, syllables: DataFrame) -> DataFrame:
    """w, rank, cand: for distinct lower-case words ``w`` the valid syllables that may be meant, best first.

    Order: the other of hỏi and ngã, misplaced horns, replacement rules, other tones.
    """
    w = F.col("w")
    swapped = tone_swap(w)
    horns = F.array(*[F.when(F.contains(w, F.lit(a)), F.replace(w, F.lit(a), F.lit(b))) for a, b in DOUBLE_HORN])
    every = F.concat(F.array(F.when(swapped != w, swapped)), horns, replacements(w), tone_variants(w))
    rows = tokens.select("w").distinct().select("w", F.posexplode(every).alias("rank", "cand")).where("cand is not null")
    return rows.groupBy("w", "cand").agg(F.min("rank").alias("rank")).join(syllables.select(F.col("w").alias("cand")), "cand", "left_semi").select("w", "rank", "cand")


def best_after(pairs: DataFrame, found: DataFrame, compounds: DataFrame) -> DataFrame:
    """prev, w, cand: of ``found`` the first that makes a compound with ``prev``, or else the first."""
    rows = pairs.select("prev", "w").distinct().join(found, "w").withColumn("compound", F.concat_ws(" ", "prev", "cand"))
    known = compounds.select(F.col("w").alias("compound"), F.lit(True).alias("known"))
    return rows.join(known, "compound", "left").groupBy("prev", "w").agg(F.min_by("cand", F.struct(F.col("known").isNull(), "rank")).alias("cand"))


def splits(tokens: DataFrame, syllables: DataFrame, compounds: DataFrame) -> DataFrame:
    """w, at, cand: the compound that a glued word stands for; ``at`` is set where it is just cut there.

    Order: cuts from the left; then by cut the other tone of the tail, of the head, of both,
    replacements in the tail, replacements in the head.
    """
    cuts = tokens.select("w").distinct().where("length(w) >= 2 and not contains(w, ' ')").select("w", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("i"))
    head, tail, i = _sub(F.col("w"), 1, F.col("i")), _sub(F.col("w"), F.col("i") + 1), F.col("i")
    other_head, other_tail = tone_swap(head), tone_swap(tail)

    def one(rank: tuple[int, int], h: Column, t: Column, cond: Column | None = None) -> Column:
        row = F.struct(F.struct(F.lit(int(rank[0] > 0)).alias("round"), i.alias("i"), F.lit(rank[0]).alias("way"), F.lit(rank[1]).alias("rule")).alias("rank"), h.alias("h"), t.alias("t"))
        return row if cond is None else F.when(cond, row)

    ways = [one((0, 0), head, tail), one((1, 0), head, other_tail, other_tail != tail), one((2, 0), other_head, tail, other_head != head), one((3, 0), other_head, other_tail, (other_head != head) & (other_tail != tail))]
    for way, side in ((4, tail), (5, head)):
        for n, (a, b) in enumerate(REPLACEMENTS):
            new = replace_first(side, a, b)
            ways.append(one((way, n), head if way == 4 else new, new if way == 4 else tail, new.isNotNull()))
    rows = cuts.select("w", F.explode(F.filter(F.array(*ways), lambda x: x.isNotNull())).alias("x")).select("w", "x.rank", "x.h", "x.t", F.concat_ws(" ", "x.h", "x.t").alias("cand"))
    valid = rows.join(compounds.select(F.col("w").alias("cand")), "cand", "left_semi").join(syllables.select(F.col("w").alias("h")), "h", "left_semi").join(syllables.select(F.col("w").alias("t")), "t", "left_semi")
    best = valid.groupBy("w").agg(F.min(F.struct("rank", "cand")).alias("b"))
    return best.select("w", F.when(F.col("b.rank.round") == 0, F.col("b.rank.i")).alias("at"), F.col("b.cand").alias("cand"))


def tone_confusions(pairs: DataFrame, syllables: DataFrame, compounds: DataFrame, confusions: DataFrame | None = None) -> DataFrame:
    """n1, n2, cand: pairs of valid syllables that are no compound but become one with the other tone.

    Tried in order: the second word, the first, both.
    """
    rows = pairs.select("n1", "n2").distinct()
    for side in ("n1", "n2"):
        rows = rows.join(syllables.select(F.col("w").alias(side)), side, "left_semi")
    rows = rows.withColumn("pair", F.concat_ws(" ", "n1", "n2")).join(compounds.select(F.col("w").alias("pair")), "pair", "left_anti")
    if confusions is not None:
        rows = rows.join(confusions.select(F.col("wrong").alias("pair")), "pair", "left_anti")
    s1, s2 = tone_swap(F.col("n1")), tone_swap(F.col("n2"))
    way = lambda k, a, b, cond: F.when(cond, F.struct(F.lit(k).alias("k"), a.alias("a"), b.alias("b")))
    ways = F.array(way(0, F.col("n1"), s2, s2 != F.col("n2")), way(1, s1, F.col("n2"), s1 != F.col("n1")), way(2, s1, s2, (s1 != F.col("n1")) & (s2 != F.col("n2"))))
    tried = rows.select("n1", "n2", F.explode(F.filter(ways, lambda x: x.isNotNull())).alias("x")).select("n1", "n2", "x.*", F.concat_ws(" ", "x.a", "x.b").alias("cand"))
    valid = tried.join(compounds.select(F.col("w").alias("cand")), "cand", "left_semi")
    for side in ("a", "b"):
        valid = valid.join(syllables.select(F.col("w").alias(side)), side, "left_semi")
    return valid.groupBy("n1", "n2").agg(F.min_by("cand", "k").alias("cand"))


def _shape(rows: DataFrame, category: str, order: int) -> DataFrame:
    return rows.select("doc_id", "block_id", "block_ord", "start", "end", "source_text", F.lit(category).alias("category"), "detector_id", "suggestion", "confidence", F.lit(order).alias("detector_ord"))


def _ignoring(rows: DataFrame, column: str, ignored: list[str]) -> DataFrame:
    return rows.where(~F.lower(column).isin([w.lower() for w in ignored])) if ignored else rows


def bigram_tones(blocks: DataFrame, syllables: DataFrame, compounds: DataFrame, confusions: DataFrame | None = None, ignored: list[str] | None = None) -> DataFrame:
    """Findings for two neighbouring words whose tones are another compound's."""
    places = bigrams(blocks).withColumn("n1", F.lower("w1")).withColumn("n2", F.lower("w2"))
    for side in ("n1", "n2"):
        places = _ignoring(places, side, ignored or [])
    found = places.join(tone_confusions(places, syllables, compounds, confusions), ["n1", "n2"])
    return _shape(found.select("*", F.concat(F.lit("confusion."), "n1", F.lit("_"), "n2", F.lit(".v1")).alias("detector_id"), match_case(F.col("source_text"), F.col("cand")).alias("suggestion"), F.lit(0.95).alias("confidence")), "compound_word", 4)


def dictionary(blocks: DataFrame, syllables: DataFrame, compounds: DataFrame, ignored: list[str] | None = None) -> DataFrame:
    """Findings for marked words outside the lexicon, with a suggestion where there is one."""
    w = Window.partitionBy("doc_id", "block_ord").orderBy("pos")
    tokens = words(blocks).select("doc_id", "block_id", "block_ord", "start", "end", "word", F.lower("word").alias("w"), F.coalesce(F.lower(F.lag("word").over(w)), F.lit("")).alias("prev"))
    unknown = _ignoring(tokens.where(F.col("w").rlike(f"[{MARKED}]")), "w", ignored or []).join(syllables.select("w"), "w", "left_anti")
    vocabulary = unknown.select("w").distinct()
    fixed = corrections(vocabulary, syllables)
    best = best_after(unknown, fixed, compounds)
    glued = splits(vocabulary.join(fixed.select("w").distinct(), "w", "left_anti"), syllables, compounds)
    rows = unknown.join(best, ["prev", "w"], "left").join(glued.toDF("w", "at", "split"), "w", "left")
    split = F.when(F.col("at").isNull(), F.col("split")).otherwise(F.concat_ws(" ", _sub(F.col("word"), 1, F.col("at")), _sub(F.col("word"), F.col("at") + 1)))
    target = F.coalesce("cand", split)
    rows = rows.select(
        "doc_id", "block_id", "block_ord", "start", "end", F.col("word").alias("source_text"), F.when(target.isNull(), "dictionary.unknown.v1").otherwise("dictionary.syllable.v1").alias("detector_id"),
        F.coalesce(match_case(F.col("word"), target), F.lit("")).alias("suggestion"), F.when(target.isNull(), 0.8).otherwise(0.95).alias("confidence"),
    )
    return _shape(rows, "spelling", 7)


def union(*findings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)
