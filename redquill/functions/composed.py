"""Composed text (NFC) with the way back to the characters that it came from.

Defined cases: a null text gives null; an empty one has an empty map; a mark without a base is a cluster of its own.
Clusters are a character and its marks, as in the rules; with ``whole`` also what NFC may join to it, so that the text is the NFC of the whole.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import cache
from unicodedata import combining, decomposition, normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

COMPOSED = "struct<text:string,places:array<struct<s:int,e:int>>>"
PLACES = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
# Characters below U+0300 neither change nor join what is before them; a run of others goes with the one before it.
OTHERS = re.compile("(?s).?[\u0300-\U0010ffff]+")
PIECE = 1 << 20  # characters of a batch that are worked on at once


@cache
def joiners() -> frozenset[str]:
    """Characters that are no marks, yet may join what is before them in NFC: medial and final jamo, some vowel signs, and those made of marks."""
    apart = {c: d.split() for c in map(chr, range(sys.maxunicode + 1)) if (d := decomposition(c)) and not d.startswith("<")}
    seconds = {chr(int(d[1], 16)) for d in apart.values() if len(d) == 2} | {chr(i) for i in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    return frozenset(c for c in {*apart, *seconds} if combining(f := normalize("NFD", c)[0]) or f in seconds)


def clusters(text: str, whole: bool = False) -> list[tuple[int, int]]:
    """(start, end) of every character with the combining marks, and if ``whole`` the joiners, behind it."""
    joins = joiners() if whole else ()
    starts = [i for i, c in enumerate(text) if i == 0 or not (combining(c) or c in joins)]
    return list(zip(starts, [*starts[1:], len(text)]))


def composed_text(text: str, whole: bool = False) -> tuple[str, np.ndarray, np.ndarray]:
    """The text in NFC by clusters, and for each of its characters where its cluster starts and ends in ``text``."""
    parts, starts, ends, at = [], [], [], 0
    for m in OTHERS.finditer(text):
        same = np.arange(at, m.start(), dtype=np.int32)
        held = [(normalize("NFC", m.group()[s:e]), m.start() + s, m.start() + e) for s, e in clusters(m.group(), whole)]
        parts += [text[at : m.start()], *(p for p, _, _ in held)]
        starts += [same, np.array([s for p, s, _ in held for _ in p], dtype=np.int32)]
        ends += [same + 1, np.array([e for p, _, e in held for _ in p], dtype=np.int32)]
        at = m.end()
    same = np.arange(at, len(text), dtype=np.int32)
    return "".join([*parts, text[at:]]), np.concatenate([*starts, same]), np.concatenate([*ends, same + 1])


def composed_array(texts: list[str | None], whole: bool = False) -> pa.Array:
    """Eight bytes a character and the texts, without an object for every place."""
    rows = [None if t is None else composed_text(t, whole) for t in texts]
    none = pa.array([r is None for r in rows], pa.bool_())
    empty = np.empty(0, dtype=np.int32)
    flat = pa.StructArray.from_arrays([pa.array(np.concatenate([empty, *(r[k] for r in rows if r)])) for k in (1, 2)], names=["s", "e"])
    offsets = np.cumsum([0, *(len(r[1]) if r else 0 for r in rows)], dtype=np.int32)
    places = pa.ListArray.from_arrays(pa.array(offsets), flat, type=PLACES)
    return pa.StructArray.from_arrays([pa.array([r[0] if r else None for r in rows], pa.string()), places], names=["text", "places"], mask=none)


def pieces(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Consecutive texts of ``PIECE`` characters together, or a longer one alone."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t or "") > PIECE:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held


def composed(text: Column, whole: bool = False) -> Column:
    """(text in NFC by clusters, places: start and end in ``text`` of every character); ``whole``: the NFC of the whole text."""

    @F.arrow_udf(COMPOSED)
    def compose(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for some in pieces(texts.to_pylist()):
                yield composed_array(some, whole)

    return F.when(text.isNotNull(), compose(text))


def source_span(text: Column, places: Column, start: Column, end: Column) -> Column:
    """(start, end, source_text) in ``text`` of a span of its composed form; unchanged if it lies outside."""
    inside = (F.size(places) > 0) & (start < F.size(places)) & (end > 0)
    s = F.when(inside, F.get(places, start)["s"]).otherwise(start)
    e = F.when(inside, F.get(places, F.least(end, F.size(places)) - 1)["e"]).otherwise(end)
    return F.struct(s.alias("start"), e.alias("end"), F.call_function("substring", text, s + 1, e - s).alias("source_text"))
