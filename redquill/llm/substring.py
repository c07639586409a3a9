"""Exact substring deduplication behind a count-min prefilter.

A window is ``width`` consecutive words. The first pass builds a count-min sketch per block of
documents; the sketches are cut into slices of the cell space, merged by adding, and every block
gets back which of its own cells hold two or more. Cells can only overestimate, so a window that
is not seen twice in all its rows of the sketch is unique. The second pass takes the other windows
and groups them exactly, by a 128-bit key, for the smallest document they start in. The sketch
grows with the corpus and is never held or broadcast as a whole: each slice is one bounded task.

Texts are shuffled once, by block, and each pass reads the same shuffle.

Defined cases: a null or empty text has no words; texts shorter than a window lose nothing; a
document with a null id neither removes nor loses words; documents that share an id do not remove
from each other; no rows give no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 13
ROWS = 2
SLICE = 1 << 24
BLOCK_CHARS = 2_000_000
MEMO_WORDS = 300_000


class _Words(dict):
    """Word -> its place in ``halves``: two 64-bit halves of a 128-bit hash."""

    def __init__(self):
        super().__init__()
        self.halves: list[tuple[int, int]] = []

    def __missing__(self, word: bytes) -> int:
        x = xxhash.xxh3_128_intdigest(word)
        self[word] = n = len(self.halves)
        self.halves.append((x & 0xFFFFFFFFFFFFFFFF, x >> 64))
        return n


def _weights(width: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, (2, width), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Block:
    """The words of some documents, and the windows that lie in one of them."""

    def __init__(self, texts: list[str | None], width: int, known: _Words | None = None):
        self.words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        self.counts = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts
        known = _Words() if known is None else known
        flat = np.concatenate([np.zeros(0, np.int64), *(np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in self.words)])
        halves = np.array(known.halves, dtype=np.uint64).reshape(-1, 2)
        full = np.maximum(self.counts - width + 1, 0)
        self.doc = np.repeat(np.arange(len(texts)), full)
        self.at = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full) + np.repeat(self.starts, full)
        self.width = width
        keys = []
        n = max(0, len(flat) - width + 1)
        for half, weights in zip((0, 1), _weights(width)):
            word = halves[flat, half]
            h = np.zeros(n, np.uint64)
            for i in range(width):
                h += word[i : i + n] * weights[i]
            keys.append(_stir(h[self.at]))
        self.h1, self.h2 = keys

    def cells(self, cells_a_row: int) -> list[np.ndarray]:
        """The cell of each window, for every row of the sketch."""
        mask = np.uint64(cells_a_row - 1)
        return [(_stir(self.h1 + np.uint64(r) * self.h2) & mask) + np.uint64(r * cells_a_row) for r in range(ROWS)]


def _pack(values: np.ndarray) -> bytes:
    """Sorted numbers under 2 ** 31, as compressed byte planes of their steps."""
    steps = np.diff(values, prepend=0).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1), dtype=np.int64)


def _join(*columns: np.ndarray) -> bytes:
    """Columns of one length, compressed one after another."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _split(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(sizes), [], 0
    for kind, size in zip(kinds, sizes):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * size
    return out


def _reply(mine: pa.Table, cells: np.ndarray) -> np.ndarray:
    """Which cells are among those of the replies (columns slice, blob)."""
    if not mine.num_rows:
        return np.zeros(len(cells), bool)
    order = np.argsort(mine.column("slice").to_numpy())
    slices, blobs = mine.column("slice").to_numpy(), mine.column("blob").to_pylist()
    held = np.concatenate([_unpack(blobs[i]) + int(slices[i]) * SLICE for i in order]).astype(np.uint64)
    place = np.minimum(np.searchsorted(held, cells), len(held) - 1)
    return held[place] == cells


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, cells_a_window: int = 4) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: texts without the words that an earlier document's windows cover.

    A word goes if a window over it has a word sequence that also starts in a document with a
    smaller id (an integer). Kept words are joined by one space.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chars = rows.agg(F.sum(F.length("text").cast("long")).alias("n")).first()["n"] or 0
    blocks = max(16, -(-chars // BLOCK_CHARS))
    cells_a_row = 1 << max(20, int(cells_a_window * chars / 6).bit_length())
    parts = max(16, chars // 6 >> 21)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def sketch(group: pa.Table) -> pa.Table:
        cells = np.sort(np.concatenate(Block(group.column("text").to_pylist(), width).cells(cells_a_row))).astype(np.int64)
        first = np.ones(len(cells), bool)
        first[1:] = cells[1:] != cells[:-1]
        own = cells[first]
        twice = np.diff(np.append(np.nonzero(first)[0], len(cells))) > 1
        slices = own // SLICE
        cuts = np.nonzero(np.diff(slices, prepend=-1))[0].tolist()
        block = group.column("block")[0].as_py()
        blobs = [_pack((own[a:b] % SLICE) * 2 + twice[a:b]) for a, b in zip(cuts, cuts[1:] + [len(own)])]
        return pa.table({"block": pa.array([block] * len(cuts), pa.int32()), "slice": pa.array(slices[cuts], pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def merge(group: pa.Table) -> pa.Table:
        count = np.zeros(SLICE, np.uint8)
        blobs = group.column("blob").to_pylist()
        for blob in blobs:
            x = _unpack(blob)
            cell = x >> 1
            count[cell] = np.minimum(count[cell] + 1 + (x & 1), 2)
        out_block, out = [], []
        for block, blob in zip(group.column("block").to_pylist(), blobs):
            cell = _unpack(blob) >> 1
            cell = cell[count[cell] > 1]
            if len(cell):
                out_block.append(block)
                out.append(_pack(cell))
        n = len(out)
        return pa.table({"block": pa.array(out_block, pa.int32()), "slice": pa.array([group.column("slice")[0].as_py()] * n, pa.int64()), "blob": pa.array(out, pa.binary())})

    repeated = dealt.groupBy("block").applyInArrow(sketch, "block int, slice long, blob binary").groupBy("slice").applyInArrow(merge, "block int, slice long, blob binary")

    def suspects(group: pa.Table, replies: pa.Table) -> pa.Table:
        ranges, blobs, block = [], [], None
        if group.num_rows and replies.num_rows:
            block = group.column("block")[0].as_py()
            b = Block(group.column("text").to_pylist(), width)
            hot = np.ones(len(b.at), bool)
            for cells in b.cells(cells_a_row):
                hot &= _reply(replies, cells)
            ids = group.column("doc_id").combine_chunks().cast(pa.int64())
            hot &= ~np.asarray(ids.is_null())[b.doc]
            h1, h2, doc = b.h1[hot], b.h2[hot], np.asarray(ids.fill_null(0))[b.doc[hot]]
            order = np.lexsort((doc, h2, h1))
            h1, h2, doc = h1[order], h2[order], doc[order]
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            at = np.nonzero(new)[0]
            last = np.append(at[1:], len(h1))[: len(at)] - 1
            more = doc[last] > doc[at]
            h1, h2, doc = h1[at], h2[at], doc[at]
            part = ((h1 >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            cuts = np.nonzero(np.diff(part, prepend=-1))[0].tolist()
            ranges = part[cuts].tolist()
            blobs = [_join(h1[i:j], h2[i:j], doc[i:j], more[i:j]) for i, j in zip(cuts, cuts[1:] + [len(h1)])]
        return pa.table({"block": pa.array([block] * len(blobs), pa.int32()), "part": pa.array(ranges, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def settle(group: pa.Table) -> pa.Table:
        blobs = [_split(x, np.uint64, np.uint64, np.int64, np.bool_) for x in group.column("blob").to_pylist()]
        h1, h2, first, more = (np.concatenate(x) for x in zip(*blobs))
        order = np.lexsort((first, h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
        least = np.empty_like(first)
        least[order] = first[order[np.nonzero(new)[0]]][np.cumsum(new) - 1]
        told = (least < first) | more
        out_block, out, at = [], [], 0
        for block, x in zip(group.column("block").to_pylist(), blobs):
            n = len(x[0])
            keep = told[at : at + n]
            if keep.any():
                out_block.append(block)
                out.append(_join(x[0][keep], x[1][keep].astype(np.uint32), least[at : at + n][keep]))
            at += n
        return pa.table({"block": pa.array(out_block, pa.int32()), "blob": pa.array(out, pa.binary())})

    # A window has one entry a block at most, however many documents hold it.
    seen = dealt.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(suspects, "block int, part long, blob binary")
    told = seen.groupBy("part").applyInArrow(settle, "block int, blob binary")

    def remove(group: pa.Table, replies: pa.Table) -> pa.Table:
        b = Block(group.column("text").to_pylist(), width)
        ids = group.column("doc_id").combine_chunks() if group.num_rows else group.column("doc_id")
        cover = np.zeros(int(b.counts.sum()) + 1, np.int64)
        if replies.num_rows and len(b.at):
            w1, w2, least = (np.concatenate(x) for x in zip(*(_split(x, np.uint64, np.uint32, np.int64) for x in replies.column("blob").to_pylist())))
            order = np.lexsort((w2, w1))
            w1, w2, least = w1[order], w2[order], least[order]
            h2 = b.h2.astype(np.uint32)
            place = np.searchsorted(w1, b.h1)
            hit = np.zeros(len(b.at), bool)
            while True:  # a second step only where first halves are equal
                open_ = ~hit & (place < len(w1))
                open_[open_] = w1[place[open_]] == b.h1[open_]
                if not open_.any():
                    break
                good = open_.copy()
                good[open_] = w2[place[open_]] == h2[open_]
                hit |= good
                place[open_ & ~good] += 1
            known = np.asarray(ids.is_valid())[b.doc]
            doc = np.asarray(ids.cast(pa.int64()).fill_null(0))[b.doc]
            where = np.nonzero(hit & known)[0]
            start = b.at[where[least[place[where]] < doc[where]]]
            np.add.at(cover, start, 1)
            np.add.at(cover, start + width, -1)
        gone = np.cumsum(cover[:-1]) > 0
        removed, kept = [], []
        for words, i, j in zip(b.words, b.starts.tolist(), b.ends.tolist()):
            g = gone[i:j]
            n = int(g.sum())
            removed.append(n)
            kept.append((b" ".join([w for w, x in zip(words, g.tolist()) if not x]) if n else b" ".join(words)).decode("utf-8", "surrogatepass"))
        return pa.table({"doc_id": ids, "n_words": pa.array(b.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(remove, f"doc_id {kind}, n_words long, n_removed long, kept_text string")
