"""Embedding near-duplicates by spherical-cap filters from a random product code.

A filter is a direction that joins one random codeword for each of ``parts`` ranges of the
(randomly rotated) coordinates; the caps around all such directions cover the sphere. Every vector
is list-decoded: a branch-and-bound over the ranges gives all filters whose inner product with it
passes a threshold, without trying the others. Vectors that share a filter and a label meet in
groups of bounded size, and their cosine is verified in double precision.

Equal vectors are first made one class, so copies are never paired. A pair is counted in the
smallest filter that both pass, so link counts need no list of pairs; edges for the components are
reduced to a spanning forest where they are found. The threshold follows from the number of
classes, so that filters stay small as the data grow, and the size of the code from the threshold.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows with a
null label, link with nothing and are returned as their own component; vectors of different length
never link; equal rows are separate vectors; no rows give no rows; columns other than id, vector
and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redquill.llm.components import components, local_roots
from redquill.llm.runtime import cut


class ProductCode:
    """``codes`` random rotations with their codewords; ``decode`` lists the filters of vectors.

    A vector passes the filters that exceed one threshold for all, and in each code those within a
    margin of its own best, so that none is left with few.
    """

    def __init__(self, dims: int, n: int, codes: int = 4, parts: int = 2, passed: float = 36.0, bucket: float = 24.0, margin: float = 0.3, seed: int = 3):
        rng = np.random.default_rng(seed + dims)
        share = min(0.02, max(1e-9, bucket / max(n, 1)))  # of the vectors that exceed one filter
        parts = min(parts, dims)
        self.words = max(2, round((passed / codes / share) ** (1 / parts)))
        self.least = NormalDist().inv_cdf(1 - share) / np.sqrt(dims)
        self.margin = margin / np.sqrt(dims)
        self.ranges = np.array_split(np.arange(dims), parts)
        self.codes = []
        for _ in range(codes):
            turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
            words = [rng.standard_normal((self.words, len(r))) for r in self.ranges]
            words = [w / np.linalg.norm(w, axis=1, keepdims=True) * np.sqrt(len(r) / dims) for w, r in zip(words, self.ranges)]
            self.codes.append((turn, words))
        self.each = self.words**parts

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter that a row of ``x`` passes, ordered by both."""
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        rows, found = [], []
        for k, (turn, words) in enumerate(self.codes):
            z = x @ turn
            scores = [z[:, r] @ w.T for r, w in zip(self.ranges, words)]
            rest = np.cumsum([np.zeros(len(x)), *(s.max(axis=1) for s in reversed(scores))], axis=0)[::-1]  # the most that later ranges can add
            least = np.minimum(self.least, rest[0] - self.margin)
            row, code, score = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
            for j, s in enumerate(scores):
                grown = score[:, None] + s[row]
                at, word = np.nonzero(grown + rest[j + 1][row][:, None] >= least[row][:, None])
                row, code, score = row[at], code[at] * self.words + word, grown[at, word]
            rows.append(row)
            found.append(code + k * self.each)
        row, found = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((found, row))
        return row[order], found[order]


def _vectors(column: pa.Array, kind: str, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dims).astype(np.float64)


def _links(code: ProductCode, f: int, node: np.ndarray, copies: np.ndarray, x: np.ndarray, side: np.ndarray, cosine: float):
    """Pairs of a group that meet the cosine and have no smaller filter in common: indices i, j."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    both = side.max() > 0
    p, q = (np.nonzero(side == 0)[0], np.nonzero(side == 1)[0]) if both else (np.arange(len(x)),) * 2
    hit = unit[p] @ unit[q].T >= cosine
    if not both:
        hit = np.triu(hit, 1)
    if not hit.any():
        return p[:0], q[:0]
    used = np.unique(np.concatenate([p[hit.any(axis=1)], q[hit.any(axis=0)]]))
    row, found = code.decode(x[used])
    row, found = row[found < f], found[found < f]
    lower, place = np.unique(found, return_inverse=True)
    if len(lower):
        member = np.zeros((len(x), len(lower)), np.float32)
        member[used[row], place] = 1
        hit &= member[p] @ member[q].T == 0
    i, j = np.nonzero(hit)
    return p[i], q[j]


def linked(classes: DataFrame, dims: int, n: int, cosine: float, kind: str, block: int = 512) -> DataFrame:
    """Of classes (node, label, copies, vector as bytes of ``kind``): rows (a, b, null) for edges, (node, null, links) for counts."""
    code = ProductCode(dims, n)
    label = classes.schema["label"].dataType.simpleString()

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                row, found = code.decode(_vectors(b.column("vector"), kind, dims))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column("node").take(take), b.column("label").take(take), pa.array(found)], names=["node", "label", "filter"])

    spread = cut(classes.select("node", "label", "vector").mapInArrow(filters, f"node long, label {label}, filter long"))
    shared = spread.groupBy("label", "filter").agg(F.count("*").alias("c")).where("c > 1").withColumn("chunks", F.ceil(F.col("c") / block))
    placed = spread.join(shared, ["label", "filter"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    # A bucket of several chunks becomes a group for each pair of them, so no group is large.
    meets = placed.select("node", "label", "filter", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    meets = meets.select("node", "label", "filter", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), (F.col("chunk") > F.col("other")).cast("int").alias("side"))
    key = ["label", "filter", "lo", "hi"]
    grouped = meets.join(classes.select("node", "copies", "vector"), "node").repartition(*key).sortWithinPartitions(*key)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)

        def results(t: pa.Table) -> pa.RecordBatch:
            us, vs, nodes, links = [none], [none], [none], [none]
            if t.num_rows:
                node, copies, side, filter_ = (t.column(c).to_numpy() for c in ("node", "copies", "side", "filter"))
                x = _vectors(t.column("vector").combine_chunks(), kind, dims)
                ends = [*_starts(t, key).tolist(), t.num_rows]
                for s, e in zip(ends, ends[1:]):
                    if e - s > 1:
                        i, j = _links(code, filter_[s], node[s:e], copies[s:e], x[s:e], side[s:e], cosine)
                        if len(i):
                            i, j = i + s, j + s
                            nodes += [node[i], node[j]]
                            links += [copies[j], copies[i]]
                            u, v = local_roots(node[i], node[j])
                            us.append(u)
                            vs.append(v)
            at, place = np.unique(np.concatenate(nodes), return_inverse=True)
            total = np.zeros(len(at), np.int64)
            np.add.at(total, place, np.concatenate(links))
            u, v = np.concatenate(us), np.concatenate(vs)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([u, at])), pa.array([*v.tolist(), *[None] * len(at)], pa.int64()), pa.array([*[None] * len(u), *total.tolist()], pa.int64())], names=["a", "b", "links"])

        kept = None  # the last group of a batch may go on in the next
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if kept is None else pa.concat_tables([kept, t])
            last = int(_starts(t, key)[-1]) if t.num_rows else 0
            kept = t.slice(last)
            if last:
                yield results(t.slice(0, last))
        if kept is not None:
            yield results(kept)

    return cut(grouped.mapInArrow(compare, "a long, b long, links long"))


def _starts(t: pa.Table, key: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in key:
        v = np.asarray(t.column(c).combine_chunks())
        new[1:] |= v[1:] != v[:-1]
    return np.nonzero(new)[0]


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    v = F.col(vector_col).cast("array<double>")
    good = F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x)), F.lit(False)) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("v")).withColumn("dims", F.when(F.coalesce(good, F.lit(False)), F.size("v")))
    key = [F.xxhash64("v"), F.xxhash64(F.lit(1), "v")]  # 128 bits stand for a vector
    rows = cut(rows.withColumn("k1", F.when(F.col("dims").isNotNull(), key[0])).withColumn("k2", F.when(F.col("dims").isNotNull(), key[1])))
    live = rows.where("dims is not null")
    classes = live.groupBy("label", "dims", "k1", "k2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))

    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = [x.values.to_numpy(zero_copy_only=False).astype(kind).tobytes() for x in b.column("v")]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("label"), b.column("copies"), pa.array(c, pa.binary())], names=["node", "label", "copies", "vector"])

    found = None
    for r in classes.groupBy("dims").count().collect():  # one round a vector length, in practice one
        some = classes.where(F.col("dims") == r["dims"]).select("node", "label", "copies", "v").mapInArrow(raw, f"node long, label {classes.schema['label'].dataType.simpleString()}, copies long, vector binary")
        got = linked(some, r["dims"], r["count"], cosine, kind)
        found = got if found is None else found.unionByName(got)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    edges = found.where("b is not null").select("a", "b")
    moved = cut(components(edges))
    named = classes.select("label", "k1", "k2", "dims", "copies", "least", "node").join(moved, "node", "left").withColumn("root", F.coalesce("root", "node")).join(links, "node", "left")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("label", "dims", "k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "label", "dims", "k1", "k2").join(named, ["label", "dims", "k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
