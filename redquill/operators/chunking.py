"""Sentences, review chunks and model responses.

Ordered greedy rules run over the blocks of one document in an Arrow-fed Python function, or as a
fold; a document's blocks are bounded by its text. Offsets are code points.

Defined cases: null and empty texts give no sentences; documents without blocks give no chunks; a
response that can't be read, or nests deeper than ``DEPTH``, gives null; halves of surrogate pairs are
written as escapes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE = "array<struct<start:int,end:int,text:string>>"


def cut_long(text: str, spans: list[tuple[int, int]], pattern: str, limit: int, keep: int, least: int = 0) -> list[tuple[int, int]]:
    """Cut the spans of over ``limit`` words after ``keep`` characters of each match, if the piece has ``least`` words."""
    out = []
    for s, e in spans:
        if len(text[s:e].split()) > limit:
            for m in re.finditer(pattern, text[s:e]):
                at = s + m.start() + keep
                if at < e and len(text[out_start(out, s) : at].split()) >= least:
                    out.append((out_start(out, s), at))
        out.append((out_start(out, s), e))
    return trimmed(text, out)


def out_start(out: list[tuple[int, int]], s: int) -> int:
    """Where the next piece of the span that starts at ``s`` starts."""
    return max(s, out[-1][1]) if out else s


def trimmed(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    found = []
    for s, e in spans:
        piece = text[s:e]
        a, b = s + len(piece) - len(piece.lstrip()), s + len(piece.rstrip())
        if a < b:
            found.append((a, b))
    return found


def sentence_spans(text: str | None, max_words: int = 35) -> list[tuple[int, int]]:
    """Sentences; long ones cut at semicolons and colons, then commas, then by count of words."""
    text = text or ""
    ends = [(m.start(), m.end()) for m in re.finditer(r"(?<=[.!?])\s+|\n+", text)]
    spans = trimmed(text, list(zip([0, *(b for _, b in ends)], [*(a for a, _ in ends), len(text)])))
    spans = cut_long(text, spans, r"[;:]\s+", max_words, 1)
    spans = cut_long(text, spans, r",\s+", max_words, 1, 10)
    out = []
    for s, e in spans:
        starts = [s + m.start() for m in re.finditer(r"\S+", text[s:e])]
        cuts = starts[max_words::max_words] if len(starts) > max_words + 10 else []
        out += zip([s, *cuts], [*cuts, e])
    return trimmed(text, out)


def sentences(blocks: DataFrame, max_words: int = 35) -> DataFrame:
    """doc_id, block_ord, start, end, text of every sentence."""

    @F.pandas_udf(SENTENCE)
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b, "text": t[a:b]} for a, b in sentence_spans(t, max_words)])

    return blocks.select("doc_id", "block_ord", F.explode(split("text")).alias("s")).select("doc_id", "block_ord", "s.*")


def _ordered(blocks: DataFrame, size: Column) -> DataFrame:
    return blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_ord", size.cast("long").alias("size")))).alias("b"))


def packed(blocks: DataFrame, limit: int = 4000) -> DataFrame:
    """doc_id, block_ord, chunk: a chunk closes before the block that would take it past ``limit`` characters."""

    def step(state: Column, x: Column) -> Column:
        full = (state["n"] > 0) & (state["length"] + x["size"] > limit)
        chunk = F.when(full, state["chunk"] + 1).otherwise(state["chunk"])
        return F.struct((state["n"] + 1).alias("n"), chunk.alias("chunk"), F.when(full, x["size"]).otherwise(state["length"] + x["size"]).alias("length"), F.array_append(state["out"], chunk).alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("length"), F.array().cast("array<int>").alias("out"))
    rows = _ordered(blocks, F.length("text")).select("doc_id", F.arrays_zip(F.col("b.block_ord").alias("block_ord"), F.aggregate("b", start, step, lambda s: s["out"]).alias("chunk")).alias("z"))
    return rows.select("doc_id", F.explode("z").alias("z")).select("doc_id", "z.*")


def paired(blocks: DataFrame, tokens: Column, limit: int = 400) -> DataFrame:
    """doc_id, block_ord, chunk: neighbours share a chunk, two at most, if their tokens fit ``limit``."""

    def step(state: Column, x: Column) -> Column:
        joins = state["open"] & (state["tokens"] + x["size"] <= limit)
        chunk = F.when(joins, state["chunk"]).otherwise(state["chunk"] + 1)
        return F.struct((~joins).alias("open"), chunk.alias("chunk"), x["size"].alias("tokens"), F.array_append(state["out"], chunk).alias("out"))

    start = F.struct(F.lit(False).alias("open"), F.lit(-1).alias("chunk"), F.lit(0).cast("long").alias("tokens"), F.array().cast("array<int>").alias("out"))
    rows = _ordered(blocks, tokens).select("doc_id", F.arrays_zip(F.col("b.block_ord").alias("block_ord"), F.aggregate("b", start, step, lambda s: s["out"]).alias("chunk")).alias("z"))
    return rows.select("doc_id", F.explode("z").alias("z")).select("doc_id", "z.*")


STRING = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)', re.S)


DEPTH = 100  # levels of arrays and objects in a response


def nesting(content: str) -> int:
    """How deep brackets nest outside of strings."""
    level = most = 0
    for c in re.findall(r"[\[\]{}]", STRING.sub("", content)):
        level += 1 if c in "[{" else -1
        most = max(most, level)
    return most


def as_json(value) -> str:
    """Sorted keys; half a surrogate pair as its escape, since it can't be encoded."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, ensure_ascii=False, sort_keys=True))


def read_response(content: str | None):
    """The value of a model's JSON; control characters in strings turn to spaces, a cut array keeps its whole objects."""
    if content is None or nesting(content) > DEPTH:
        return None
    clean = STRING.sub(lambda m: re.sub(r"(\\.)|[\x00-\x1f]", lambda c: c.group(1) or " ", m.group(), flags=re.S), content)
    for candidate in (content, clean):
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    depth, last = 0, None
    for m in re.finditer(r"[\[\]{}]", STRING.sub(lambda s: " " * len(s.group()), clean)):
        depth += 1 if m.group() in "[{" else -1
        if m.group() == "}" and depth == 1:
            last = m.end()
    if last is None or not clean.lstrip().startswith("["):
        return None
    try:
        return json.loads(clean[:last] + "]")
    except ValueError:
        return None


def responses(rows: DataFrame, content: str = "content") -> DataFrame:
    """``rows`` with column ``items``: the canonical JSON of what could be read, or null."""

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = [read_response(t) for t in texts]
            yield pd.Series([None if v is None else as_json(v) for v in values], dtype=object)

    return rows.withColumn("items", read(F.col(content)))
