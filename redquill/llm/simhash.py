"""SimHash near-duplicates with bit-sliced comparison.

Each text becomes a 64-bit fingerprint of its word shingles. Distinct fingerprints are bucketed
by every choice of two out of ``radius + 2`` bit ranges (two fingerprints that differ in at most
``radius`` bits agree on at least two ranges), large buckets are split into blocks, and pairs of
blocks are compared: a block's fingerprints are stored as vertical bit planes, a probe's bits turn
planes into differences, a carry-save counter of bitwise operations updates 64 distances a machine
word, and words whose lanes have all passed the radius are abandoned.

Defined cases: null and empty texts have fingerprint zero and link like any other; fewer words
than a shingle make one shingle of them all; equal rows share a fingerprint and thus a component;
a null id is returned as it is and never is a component's smallest; no rows give no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redquill.llm.components import components, local_roots
from redquill.llm.runtime import bounded_batches, cut

SEED = 42
LANES = 1 << 18


def fingerprint(text: str | None, shingle: int) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long, for every row."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64,) machine words of at most 64 fingerprints: word k holds bit k of each, a lane a fingerprint."""
    lanes = np.zeros(64, np.uint64)
    lanes[: len(fps)] = fps
    bits = np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(64, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8").reshape(64)


def near_lanes(planes: np.ndarray, probes: np.ndarray, lanes: np.ndarray, radius: int, step: int = 8) -> np.ndarray:
    """For each probe the lanes, as bits, of its row of ``planes`` that differ from it in at most ``radius`` bits.

    ``planes`` is (probes, 64), ``lanes`` has the bits of the lanes in use. A probe's bit k turns
    plane k into differences; a carry-save counter of bitwise operations adds them to 64 distances at once;
    words whose lanes have all passed the radius are abandoned.
    """
    out = np.zeros(len(probes), np.uint64)
    live, past = np.arange(len(probes)), ~lanes
    width = radius.bit_length() + 1
    counter = [np.zeros(len(live), np.uint64) for _ in range(width)]
    full, one = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1)
    for k in range(64):
        carry = planes[live, k] ^ ((probes[live] >> np.uint64(k) & one) * full)
        for j in range(width):
            counter[j], carry = counter[j] ^ carry, counter[j] & carry
        past = past | carry | counter[width - 1]  # 2 ** (width - 1) > radius
        if k % step == step - 1:
            # lanes that hold more than the radius, bit by bit from the top
            more, same = np.zeros(len(live), np.uint64), np.full(len(live), full)
            for j in reversed(range(width)):
                if radius >> j & 1:
                    same = same & counter[j]
                else:
                    more, same = more | (same & counter[j]), same & ~counter[j]
            past = past | more
            keep = past != full
            live, past = live[keep], past[keep]
            counter = [c[keep] for c in counter]
            if not len(live):
                return out
    out[live] = ~past
    return out


def _masks(radius: int) -> list[int]:
    edges = np.linspace(0, 64, radius + 3).astype(int)
    ranges = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]
    masks = [x | y for x, y in combinations(ranges, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def linked_fingerprints(fps: DataFrame, radius: int, block: int = 48) -> DataFrame:
    """a, b: edges that join distinct fingerprints within ``radius`` as the full set of links does.

    ``block``: about so many fingerprints stand in one block's planes, 64 a word at most.
    """
    spread = fps.select("fp").distinct().select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(radius)])).alias("t", "key"))
    shared = spread.groupBy("t", "key").agg(F.count("*").alias("c")).where("c > 1")
    dealt = (
        spread.join(shared, ["t", "key"]).withColumn("chunks", F.ceil(F.col("c") / block)).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")))
        .groupBy("t", "key", "chunk").agg(F.collect_list("fp").alias("fps"))
    )

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in b.column("fps")]
            planes = [b"".join(planes_of(x[at : at + 64]).tobytes() for at in range(0, len(x), 64)) for x in held]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("t", "key", "chunk", "fps")] + [pa.array(planes, pa.binary())], names=["t", "key", "chunk", "fps", "planes"])

    # Every block's planes are made once and stored; pairs of blocks read them.
    blocks = cut(dealt.mapInArrow(store, "t int, key long, chunk long, fps array<long>, planes binary"))
    # Each block meets the blocks of its bucket once; the key of a pair spreads a large bucket.
    left, right = blocks.select("t", "key", F.col("chunk").alias("i"), F.col("fps").alias("probes")), blocks.select("t", "key", F.col("chunk").alias("j"), "fps", "planes")
    pairs = left.join(right, ["t", "key"]).where("i <= j and (i < j or size(fps) > 1)").select("probes", "fps", "planes")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs, waiting, held = [], [], [], 0
            rows = list(zip(*(b.column(c) for c in ("probes", "fps", "planes"))))
            for at, (probes, fps, planes) in enumerate(rows):
                p, q = (np.asarray(c.values.to_numpy(zero_copy_only=False)).view(np.uint64) for c in (probes, fps))
                words = np.frombuffer(planes.as_py(), "<u8").reshape(-1, 64)
                for w in range(len(words)):
                    lanes = q[64 * w : 64 * w + 64]
                    padded = np.zeros(64, np.uint64)
                    padded[: len(lanes)] = lanes
                    waiting.append((p, padded, words[w], (1 << len(lanes)) - 1))
                    held += len(p)
                if held >= LANES // 64 or at == len(rows) - 1:
                    each = np.array([len(x[0]) for x in waiting])
                    owner = np.repeat(np.arange(len(waiting)), each)
                    x, lanes = np.concatenate([w[0] for w in waiting]), np.stack([w[1] for w in waiting])
                    near = near_lanes(np.stack([w[2] for w in waiting])[owner], x, np.array([w[3] for w in waiting], np.uint64)[owner], radius)
                    row, lane = np.nonzero(np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                    u, v = x[row].view(np.int64), lanes[owner[row], lane].view(np.int64)
                    if (u != v).any():
                        a, c = local_roots(u[u != v], v[u != v])
                        us.append(a)
                        vs.append(c)
                    waiting, held = [], 0
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us or [none])), pa.array(np.concatenate(vs or [none]))], names=["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable by links) for every row."""
    fps = cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    moved = cut(components(linked_fingerprints(fps, radius)))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first")).join(moved.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
