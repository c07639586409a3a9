"""Near copies by a Jaccard similarity of word shingles, through wide bit-sliced SimHash fingerprints.

Equal word sequences (by a 128-bit hash) form one class. A class has the set of its shingles' XXH64,
a SimHash of 512 bits of that set and ``BANDS`` keys of some minimum hashes each (64 fingerprint bits
alone can't hold a similarity of 0.8: such pairs differ in about 10 bits, too many for exact bit ranges).
Classes that share a key are compared in pairs of blocks: bit planes, carry-save counters, and words
of 64 lanes that are abandoned once all their lanes are past the radius. What lies within the radius
is only a candidate: every link is checked exactly on whole shingle sets. That happens twice: first
for a minimum spanning forest by distance of each pair of blocks, so that output is linear in members;
then for every pair whose classes the first check left in different components, since a forest may
hold an edge that fails in the place of one that would pass. The second time whole sets stand in the
blocks and pairs are checked there, each at the first key it shares, so that rows stay linear too.

The minimum hashes of a key and the radius follow from the similarity: at 0.8, five and 136 bits. A
pair at the similarity shares a key with probability 0.9996 at least, one with 0.85 where 0.8 is asked
with 0.999997; it lies within the radius but for 4.5 deviations.

Defined cases: null and empty texts, and texts of white space, are one class; fewer words than a
shingle make one shingle of them all; equal rows are one class; null ids come after all others, and a
component of nothing else has a null component id; rows that share an id are told apart by their
texts; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redquill.llm.components import components, local_roots
from redquill.llm.runtime import bounded_batches, cut

SEED = 42
WIDTH = 8  # machine words of a fingerprint
BANDS = 20
MISSED = 4e-4  # of the pairs that just have the similarity, the share that no key may find
DEVIATIONS = 4.5
BLOCK = 256
BROADCAST_ROWS = 500_000
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_RNG = np.random.default_rng(SEED)
XOR = _RNG.integers(0, 1 << 63, BANDS * 64, dtype=np.uint64)
ODD = _RNG.integers(0, 1 << 63, BANDS * 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _checked(similarity: float) -> float:
    if not 0 < similarity <= 1:
        raise ValueError("the similarity must be over 0, and 1 at most")
    return similarity


def band_rows(similarity: float) -> int:
    """Minimum hashes a key, so that ``BANDS`` keys find a pair with the similarity but for ``MISSED``."""
    if _checked(similarity) == 1:
        return 8
    return max(1, min(64, int(math.log(1 - MISSED ** (1 / BANDS)) / math.log(similarity))))


def _halves(shared: int, a: int, b: int) -> float:
    """How likely "set in over half" differs between two sets with ``shared`` hashes in common, and a and b of their own."""
    coins = lambda n: np.array([math.comb(n, k) for k in range(n + 1)]) / 2.0**n
    base = np.arange(shared + 1)[:, None]
    over = [((2 * (base + np.arange(own + 1)) > shared + own) * coins(own)).sum(axis=1) for own in (a, b)]
    return float((coins(shared) * (over[0] * (1 - over[1]) + over[1] * (1 - over[0]))).sum())


@lru_cache
def radius_of(similarity: float) -> int:
    """So many bits two fingerprints with the similarity differ in at most, but for ``DEVIATIONS`` deviations.

    Counted out for sets of up to 32 shingles, of which none is less alike; larger ones tend to the angle
    between two sets of one size.
    """
    at = math.acos(2 * _checked(similarity) / (1 + similarity)) / math.pi
    for n in range(2, 33):
        for shared in range(math.ceil(similarity * n), n + 1):
            at = max([at, *(_halves(shared, a, n - shared - a) for a in range((n - shared) // 2 + 1))])
    bits = 64 * WIDTH
    return min(bits, math.ceil(bits * at + DEVIATIONS * math.sqrt(bits * at * (1 - at))))


def word_bytes(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """The distinct XXH64 of the shingles, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())), np.uint64, n))


def mixed(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of 64-bit hashes."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDTH machine words; a bit is 1 if it is set in over half of the hashes."""
    out = np.zeros(WIDTH, np.uint64)
    for k in range(WIDTH):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 15):
            part = mixed(hashes[at : at + (1 << 15)], k)
            ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def band_keys(hashes: np.ndarray, each: int) -> np.ndarray:
    """BANDS keys: each a hash of ``each`` minimum hashes and the band's number."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    xor, odd = XOR[: BANDS * each], ODD[: BANDS * each]
    low = np.full(BANDS * each, ALL, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        part = hashes[at : at + (1 << 12), None]
        low = np.minimum(low, ((part ^ xor) * odd).min(axis=0))
    rows = low.reshape(BANDS, each)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(each):
        key = mixed(key ^ rows[:, r], r)
    return key.view(np.int64)


def distances(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Differing bits of the lanes x[i], y[i] (rows of machine words); -1 where they pass ``radius``.

    Lanes stand 64 to a word of a bit plane; counters are bit-sliced, one carry-save step a plane.
    """
    n, width = x.shape
    out = np.full(-(-n // 64) * 64, -1, np.int64)
    if not n:
        return out
    diff = np.full((len(out), width), ALL, np.uint64)
    diff[:n] = x ^ y
    live = np.arange(len(out) // 64)
    places = (radius + 1).bit_length() + 1
    counter = [np.zeros(len(live), np.uint64) for _ in range(places)]
    past = np.zeros(len(live), np.uint64)
    for k in range(width):
        lanes = np.ascontiguousarray(diff.reshape(-1, 64, width)[live][:, :, k]).reshape(-1)
        bits = np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")
        for plane in planes:
            carry = plane
            for j in range(places):
                counter[j], carry = counter[j] ^ carry, counter[j] & carry
            past = past | carry
        more, same = np.zeros(len(live), np.uint64), np.full(len(live), ALL)
        for j in reversed(range(places)):
            if radius >> j & 1:
                same = same & counter[j]
            else:
                more, same = more | (same & counter[j]), same & ~counter[j]
        past = past | more
        keep = past != ALL
        live, past = live[keep], past[keep]
        counter = [c[keep] for c in counter]
        if not len(live):
            return out[:n]
    bits = lambda words: np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little")
    total = sum(bits(c).astype(np.int64) << j for j, c in enumerate(counter))
    out.reshape(-1, 64)[live] = np.where(bits(past).astype(bool), -1, total).reshape(-1, 64)
    return out[:n]


def forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the edges of a minimum spanning forest by (distance, ends)."""
    order = np.lexsort((b, a, d))
    nodes, ends = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    comp, kept, rank = np.arange(len(nodes)), [], np.arange(len(a))
    while True:
        across = comp[u] != comp[v]
        if not across.any():
            return order[np.unique(np.concatenate(kept))] if kept else np.zeros(0, np.int64)
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, comp[u[across]], rank[across])
        np.minimum.at(best, comp[v[across]], rank[across])
        chosen = np.unique(best[best < len(a)])
        kept.append(chosen)
        moved, root = local_roots(comp[u[chosen]], comp[v[chosen]])
        to = np.arange(len(nodes))
        to[moved] = root
        comp = to[comp]


def text_key(text_col: str) -> list:
    """128 bits of a row's text as it stands: h1, h2."""
    return [F.xxhash64(text_col).alias("h1"), F.xxhash64(F.lit(9), text_col).alias("h2")]


def sketches(docs: DataFrame, shingle: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h1, h2, c1, c2 (128 bits of the word sequence), n (size of the shingle set), fp (binary), keys: for every row."""
    bounded_batches(docs.sparkSession)
    kind, each = docs.schema[id_col].dataType.simpleString(), band_rows(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            halves, sizes, fps, keys = [], [], [], []
            for t in b.column(3):
                words = word_bytes(t.as_py())
                hashes = shingle_set(words, shingle)
                whole = xxhash.xxh3_128_digest(b" ".join(words), SEED)
                halves.append(whole)
                sizes.append(len(hashes))
                fps.append(wide_fingerprint(hashes).astype("<u8").tobytes())
                keys.append(band_keys(hashes, each))
            both = np.frombuffer(b"".join(halves), "<i8").reshape(-1, 2)
            columns = [*(b.column(i) for i in range(3)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h1", "h2", "c1", "c2", "n", "fp", "keys"])

    rows = docs.select(F.col(id_col).alias("doc_id"), *text_key(text_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, h1 long, h2 long, c1 long, c2 long, n long, fp binary, keys array<long>")


def shared_keys(classes: DataFrame) -> DataFrame:
    """key, cls: the keys that several classes have."""
    spread = classes.select("cls", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    return cut(spread.join(shared, "key"))


def block_pairs(members: DataFrame, block: int, columns: tuple[str, ...]) -> DataFrame:
    """key, p, q: pairs of blocks of the members (key, root, ``columns``) of the keys that hold several roots."""
    open_keys = members.groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key", "c")
    blocks = cut(
        members.join(open_keys, "key").withColumn("chunks", F.ceil(F.col("c") / block)).withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")))
        .groupBy("key", "chunk", "chunks").agg(F.collect_list(F.struct("root", *columns)).alias("m"))
    )
    side = lambda s: blocks.select("key", F.col("chunk").alias(f"{s}_chunk"), F.struct(*(F.col(f"m.{c}").alias(c) for c in ("root", *columns))).alias(s))
    return side("p").join(side("q"), "key").where("p_chunk < q_chunk or (p_chunk = q_chunk and size(p.cls) > 1)").select("key", "p", "q", (F.col("p_chunk") == F.col("q_chunk")).alias("one"))


def block_column(x: pa.StructScalar, name: str) -> np.ndarray:
    """A block's column, without making Python objects: longs, rows of keys, or rows of fingerprint words."""
    v = x[name].values
    if pa.types.is_list(v.type):
        return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
    if pa.types.is_binary(v.type):
        ends = np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1]
        return np.frombuffer(v.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<u8").reshape(-1, WIDTH)
    return v.to_numpy(zero_copy_only=False)


def fitting(key: int, p: pa.StructScalar, q: pa.StructScalar, one: bool, similarity: float, first_key: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places i, j of pairs of two blocks with different roots and sizes that allow ``similarity``, and their fingerprints.

    With ``first_key`` only pairs whose first shared key is ``key``.
    """
    (pr, pn, pf), (qr, qn, qf) = ((block_column(x, "root"), block_column(x, "n"), block_column(x, "fp")) for x in (p, q))
    fits = (np.minimum.outer(pn, qn) >= similarity * np.maximum.outer(pn, qn)) & (pr[:, None] != qr[None, :])
    i, j = np.nonzero(np.triu(fits, 1) if one else fits)
    if len(i) and first_key:
        pk, qk = block_column(p, "keys"), block_column(q, "keys")
        first = np.argmax(pk[i] == qk[j], axis=1)
        here = pk[i, first] == key
        i, j = i[here], j[here]
    return i, j, pf[i], qf[j]


def candidate_edges(members: DataFrame, classes: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """a, b, d: forests of the classes that share a key, have sizes that allow ``similarity``, and lie within the radius."""
    rows = members.join(classes.select("cls", "n", "fp"), "cls").withColumn("root", F.col("cls"))
    radius = radius_of(similarity)

    def near(waiting: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        d = distances(np.concatenate([w[2] for w in waiting]), np.concatenate([w[3] for w in waiting]), radius)
        at, found = 0, []
        for ids, others, x, _ in waiting:
            here, at = d[at : at + len(x)], at + len(x)
            hit = here >= 0
            if hit.any():
                a, b, far = np.minimum(ids, others)[hit], np.maximum(ids, others)[hit], here[hit]
                f = forest(a, b, far)
                found.append((a[f], b[f], far[f]))
        parts = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["a", "b", "d"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting, held = [], 0
            for key, p, q, one in zip(*batch.columns):
                i, j, x, y = fitting(key.as_py(), p, q, one.as_py(), similarity, False)
                if len(i):
                    waiting.append((block_column(p, "cls")[i], block_column(q, "cls")[j], x, y))
                    held += len(i)
                if held >= 1 << 15:
                    yield near(waiting)
                    waiting, held = [], 0
            if waiting:
                yield near(waiting)

    return block_pairs(rows, block, ("cls", "n", "fp")).mapInArrow(compare, "a long, b long, d long").distinct()


def unsettled(members: DataFrame, classes: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """key, cls: members (key, cls, root) that have a candidate of another root at that key, the first the two share."""
    rows = members.join(classes.select("cls", "n", "fp", "keys"), "cls")
    radius = radius_of(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, p, q, one in zip(*batch.columns):
                i, j, x, y = fitting(key.as_py(), p, q, one.as_py(), similarity, True)
                hit = distances(x, y, radius)[: len(i)] >= 0
                if hit.any():
                    cls = np.unique(np.concatenate([block_column(p, "cls")[i[hit]], block_column(q, "cls")[j[hit]]]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cls), key.as_py())), pa.array(cls)], names=["key", "cls"])

    return block_pairs(rows, block, ("cls", "n", "fp", "keys")).mapInArrow(run, "key long, cls long").distinct()


def exact_links(members: DataFrame, classes: DataFrame, sets: DataFrame, similarity: float, block: int = BLOCK // 2) -> DataFrame:
    """a, b: links that join the roots of the members (key, cls, root) wherever a candidate's whole sets have the similarity."""
    rows = members.join(classes.select("cls", "n", "fp", "keys"), "cls").join(sets, "cls")
    radius = radius_of(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, p, q, one in zip(*batch.columns):
                sp, sq = ([np.array(s.values, np.int64) for s in x["s"]] for x in (p, q))
                i, j, x, y = fitting(key.as_py(), p, q, one.as_py(), similarity, True)
                roots, nodes = [block_column(x, "root").tolist() for x in (p, q)], [block_column(x, "cls").tolist() for x in (p, q)]
                d = distances(x, y, radius)[: len(i)]
                order = np.argsort(d, kind="stable")
                up: dict[int, int] = {}

                def root(r: int) -> int:
                    while r in up:
                        r = up[r]
                    return r

                a, b = [], []
                for k in order[np.searchsorted(d[order], 0) :].tolist():
                    u, v = root(roots[0][i[k]]), root(roots[1][j[k]])
                    if u == v:  # joined already: another link changes no component
                        continue
                    l, r = sp[i[k]], sq[j[k]]
                    shared = len(l) + len(r) - len(np.union1d(l, r))
                    if shared >= similarity * (len(l) + len(r) - shared):
                        up[u] = v
                        a.append(nodes[0][i[k]])
                        b.append(nodes[1][j[k]])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return block_pairs(rows, block, ("cls", "n", "fp", "keys", "s")).mapInArrow(run, "a long, b long")


def whole_sets(nodes: DataFrame, docs: DataFrame, heads: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """cls, s (its whole shingle set) of the classes in ``nodes``; of each only one text is moved."""
    wanted = cut(heads.join(nodes, "cls", "left_semi").select("cls", "head.h1", "head.h2"))
    if wanted.count() <= BROADCAST_ROWS:  # 24 bytes a row; beyond it, a shuffled join
        wanted = F.broadcast(wanted)
    texts = docs.select(*text_key(text_col), F.col(text_col).alias("text")).join(wanted, ["h1", "h2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(word_bytes(t.as_py()), shingle).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))], names=["cls", "s"])

    return texts.select("cls", "text").mapInArrow(run, "cls long, s array<long>").dropDuplicates(["cls"])


def verified(edges: DataFrame, docs: DataFrame, heads: DataFrame, shingle: int, similarity: float, text_col: str) -> DataFrame:
    """The edges whose whole shingle sets have the similarity."""
    sets = whole_sets(edges.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), docs, heads, shingle, text_col)
    both = edges.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, h1, h2 (of the text), component_id (the smallest doc_id reachable by links), stays: for every row.

    ``stays`` is true for the rows of one (doc_id, text) of each component: the smallest id, then by the text's hash.
    """
    rows = cut(sketches(docs, shingle, similarity, id_col, text_col))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    classes = rows.groupBy("c1", "c2").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min(place).alias("head"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    heads = classes.select("cls", "head")
    members = shared_keys(classes)
    edges = cut(candidate_edges(members, classes, similarity))
    links = cut(verified(edges.select("a", "b"), docs, heads, shingle, similarity, text_col))
    moved = cut(components(links))
    # Whatever the forests left out and could still join two components.
    apart = members.join(moved.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    rest = cut(unsettled(apart, classes, similarity))
    if not rest.isEmpty():
        sets = whole_sets(rest.select("cls").distinct(), docs, heads, shingle, text_col)
        more = cut(exact_links(apart.join(rest, ["key", "cls"], "left_semi"), classes, sets, similarity))
        moved = cut(components(links.unionByName(more)))
    named = classes.select("c1", "c2", "cls", "head").join(moved.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    tops = named.groupBy("root").agg(F.min("head").alias("top"))
    out = rows.select("doc_id", "h1", "h2", "c1", "c2").join(named.join(tops, "root").select("c1", "c2", "top"), ["c1", "c2"])
    stays = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("h1") == F.col("top.h1")) & (F.col("h2") == F.col("top.h2"))
    return out.select("doc_id", "h1", "h2", F.col("top.doc_id").alias("component_id"), stays.alias("stays"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component of near copies. The names h1 and h2 must be free.

    The decision belongs to an (id, text); of rows that are equal in both, one stays.
    """
    clash = {"h1", "h2"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    found = cut(near_copies(docs, id_col=id_col, text_col=text_col, shingle=shingle, similarity=similarity))
    rows = docs.select("*", *text_key(text_col)).alias("r")
    same = F.col(f"r.{id_col}").eqNullSafe(F.col("g.doc_id")) & (F.col("r.h1") == F.col("g.h1")) & (F.col("r.h2") == F.col("g.h2"))
    gone = found.where("not stays").select("doc_id", "h1", "h2").distinct()
    kept = rows.join(gone.alias("g"), same, "left_anti")
    again = cut(found.where("stays").groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("c")).where("c > 1").drop("c"))
    if not again.isEmpty():
        twice = again.alias("g")
        kept = kept.alias("r").join(twice, same, "left_anti").unionByName(kept.alias("r").join(twice, same, "left_semi").dropDuplicates([id_col, "h1", "h2"]))
    return kept.select(*docs.columns)
