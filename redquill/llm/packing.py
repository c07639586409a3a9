"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents are tokenised and cut into pieces of at most ``capacity`` ids. Pieces are dealt at
random into groups of about ``group_docs`` documents, and each group is packed by itself: pieces
by falling length, each into the first open bin that still holds it. The tree keeps, above every
pair of bins, the larger of their free capacities, so the first fitting bin is found in
logarithmic time. Groups grow in number, never in size, with the corpus.

Defined cases: a null text is an empty one (its only id is the end id); an empty input gives no
rows; equal rows are packed as separate documents; a null id is kept as it is; columns other than
the id and the text are not read, so their names can't clash.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redquill.llm.runtime import bounded_batches

CAPACITY = 2048
END_ID = 1
MEMO_WORDS = 600_000

# In texts without a character from U+0130 on, these are the tokenizer's own pre-tokens once the
# text is in lower case: contractions, runs of letters, single digits, runs of anything else.
_LETTER = "a-zA-ZªµºÀ-ÖØ-öø-į"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
BEYOND = re.compile("[^\x00-į]")


class WordEncoder:
    """Ids of whole texts, exactly as the tokenizer gives them, from a memo of encoded words.

    A word-level tokenizer never merges across the places where texts are split here, so the ids
    of a text are those of its parts. Texts with characters outside the first Latin blocks, or
    with the spelling of a special token, are split at spaces and line ends only.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.limit = memo_words

    @staticmethod
    def parts(text: str) -> list[str]:
        if "<|" in text or BEYOND.search(text):
            return text.replace("\n", " ").split(" ")
        return PRE_TOKEN.findall(text.lower())

    def __call__(self, texts: list[str]) -> list[bytes]:
        parts = [self.parts(t) for t in texts]
        if len(self.memo) > self.limit:  # what is still in use comes back from the older half
            self.memo, self.older = {}, self.memo
        new = set().union(*parts) - self.memo.keys()
        for word in new & self.older.keys():
            self.memo[word] = self.older[word]
        new = list(new - self.older.keys())
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            for word, got in zip(some, self.encode(some, add_special_tokens=False)):
                self.memo[word] = array("I", got.ids).tobytes()
        known = self.memo.__getitem__
        return [b"".join(map(known, p)) for p in parts]


@lru_cache(maxsize=1)
def word_encoder(path: str, memo_words: int) -> WordEncoder:
    """One a Python worker, so that later tasks find its memo filled; about 400 bytes a word of ``memo_words``."""
    return WordEncoder(path, memo_words)


def token_pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, memo_words: int = MEMO_WORDS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens."""
    bounded_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer, memo_words)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                encoded = [x + end for x in encoder([t or "" for t in b.column(1).to_pylist()])]
                rows, starts, lengths, ids, totals = [], [], [], [], []
                for row, x in enumerate(encoded):
                    n = len(x) // 4
                    for start in range(0, n, capacity):
                        piece = x[4 * start : 4 * (start + capacity)]
                        rows.append(row)
                        starts.append(start)
                        lengths.append(len(piece) // 4)
                        ids.append(piece)
                        totals.append(n)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64())],
                    names=["doc_id", "start", "length", "ids", "doc_tokens"],
                )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; bins number from 0 in the order in which they are opened."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int((lengths >= capacity).sum())  # these come first and each fills a bin
    bins[order[:full]] = np.arange(full)
    rest = order[full:].tolist()
    leaves = 1 << max(0, (len(rest) - 1).bit_length())
    tree = [0] * leaves + [capacity] * leaves  # tree[leaves + i]: free capacity of bin i
    for node in range(leaves - 1, 0, -1):
        tree[node] = max(tree[2 * node], tree[2 * node + 1])
    for item in rest:
        size, node = int(lengths[item]), 1
        while node < leaves:
            node = 2 * node if tree[2 * node] >= size else 2 * node + 1
        bins[item], offsets[item] = full + node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins, offsets


def pack_pieces(pieces: DataFrame, *, n_docs: int, capacity: int = CAPACITY, group_docs: int = 2048, least_groups: int = 16, seed: int = 7) -> DataFrame:
    """``pieces`` (with doc_id, start, length) and their sequence_id and offset.

    All pieces of a document, and equal documents with one id, share a group; ``least_groups``
    keeps small inputs parallel.
    """
    groups = max(least_groups, -(-n_docs // group_docs))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "doc_tokens"), F.lit(groups)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    names = pieces.columns

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(group.column("length").to_numpy(), capacity)
        sequence = (group.column("_group").to_numpy() << 32) + bins
        return group.select(names).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return dealt.groupBy("_group").applyInArrow(pack, schema)


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, carry_ids: bool = True, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Pieces with their place in a sequence; with ``carry_ids`` each has its token ids, else their CRC-32."""
    pieces = token_pieces(docs, tokenizer, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, memo_words=memo_words)
    if not carry_ids:
        pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack_pieces(pieces, n_docs=docs.count(), capacity=capacity)
