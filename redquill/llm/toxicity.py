"""Toxicity: a convolutional text classifier trained in numpy.

The embedding of a word is the sum of hashed embeddings, of the word and of its first letters; filters of several widths run over the whole text, each keeps its
maximum, and a logistic layer makes a score. Training (Adam on minibatches) sees a bounded sample
of labelled texts; a held-back part of it calibrates the scores, so that they are probabilities.
Thresholds come from all labelled texts that the training didn't see: their scores are counted by
language in histograms, and each language takes the cut with the best F1 of its own counts, to which the
counts of all languages are added with the weight of ``SHRINK`` texts. A language with few texts so comes
close to the common threshold, at any size. The language is never an input of a score. Scoring folds
embeddings and filters into one lookup a word, kept by each worker for the words it has met.

Defined cases: a null or empty text has no words and gets the score of no evidence; texts shorter
than a filter are padded; equal texts get equal scores; labels that are null or of absent documents
are not used; with no labels of one kind all scores are the share of toxic ones (0 without any);
a null language, or one without labelled texts, uses the common threshold; of rows that share an id, each
counts with the label; no rows give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redquill.llm.runtime import bounded_batches, cut

BUCKETS = 1 << 18
PREFIXES = (5, 6, 7, 8)
SLOTS = 1 + len(PREFIXES)
CUTS = 200  # bins of scores, for thresholds
SHRINK = 50.0
WORD = re.compile(r"[^\W\d_]+")


def word_buckets(word: str) -> tuple[int, ...]:
    """Of the word and of its first 5 to 8 letters, where it is longer; 0 stands for nothing."""
    parts = [word, *(f"{word[:k]}\t{k}" if len(word) > k else "" for k in PREFIXES)]
    return tuple(1 + zlib.crc32(p.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) if p else 0 for p in parts)


class _Known(dict):
    """Word -> its number; ``new`` has the buckets of those last numbered. Number 0 is padding."""

    def __init__(self):
        super().__init__({"": 0})
        self.new = [(0,) * SLOTS]

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word_buckets(word))
        return n


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_ids(text: str | None) -> np.ndarray:
    """(words, SLOTS) buckets of a text."""
    return np.array([word_buckets(w) for w in words_of(text)], np.int32).reshape(-1, SLOTS)


class TextCNN:
    """Hashed embeddings, ``filters`` filters of each width, maxima over the text, a logistic layer."""

    def __init__(self, dims: int = 12, filters: int = 8, widths: tuple[int, ...] = (1, 2, 3), seed: int = 5):
        rng = np.random.default_rng(seed)
        self.rng, self.widths = rng, widths
        self.embed = (rng.standard_normal((BUCKETS, dims)) * 0.05).astype(np.float32)
        self.embed[0] = 0
        self.conv = [(rng.standard_normal((w, dims, filters)) * 0.3).astype(np.float32) for w in widths]
        self.bias = np.zeros(filters * len(widths), np.float32)
        self.out = (rng.standard_normal(filters * len(widths)) * 0.1).astype(np.float32)
        self.base = np.zeros(1, np.float32)
        self.scale, self.shift = 1.0, 0.0

    def _batch(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids with padding between documents, and where each document starts."""
        pad = max(self.widths) - 1
        n = np.array([max(len(d), 1) + pad for d in docs])
        starts = np.cumsum(n) - n
        flat = np.zeros((n.sum(), SLOTS), np.int32)
        for s, d in zip(starts.tolist(), docs):
            flat[s : s + len(d)] = d
        return flat, starts

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int = 10, batch: int = 48, rate: float = 0.005, embed_rate: float = 0.05, least_docs: int = 4, decay: float = 1e-3, shrink: float = 0.05) -> None:
        """Buckets seen in fewer than ``least_docs`` documents stay without evidence."""
        share = min(max(float(labels.mean()), 1e-3), 1 - 1e-3)
        self.base[0] = np.log(share / (1 - share))
        seen = np.zeros(BUCKETS, np.int64)
        for d in docs:
            seen[np.unique(d)] += 1
        seen[0] = 0
        self.embed[seen < least_docs] = 0
        rows = (np.cumsum(seen >= least_docs) * (seen >= least_docs)).astype(np.int32)  # 0: no evidence
        table = np.concatenate([self.embed[:1], self.embed[seen >= least_docs]])
        past = np.full(len(table), 1e-8, np.float32)  # sums of squared gradients, for steps on the rows of a batch
        params = [*self.conv, self.bias, self.out, self.base]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step, filters = 0, self.conv[0].shape[2]
        for _ in range(epochs):
            order = self.rng.permutation(len(docs))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                flat, starts = self._batch([docs[i] for i in some])
                flat = rows[flat]
                x = table[flat].sum(axis=1)
                grads = [*(np.zeros_like(c) for c in self.conv), np.zeros_like(self.bias), None, None]
                picked, pooled = [], []
                for c in self.conv:
                    act = np.zeros((len(flat), filters), np.float32)
                    for k in range(len(c)):
                        act[: len(flat) - k] += x[k:] @ c[k]
                    top = np.maximum.reduceat(act, starts, axis=0)
                    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(flat))))
                    row, col = np.nonzero(act == top[owner])
                    best = np.zeros(top.shape, np.int64)
                    best[owner[row[::-1]], col[::-1]] = row[::-1]
                    picked.append(best)
                    pooled.append(top)
                raw = np.concatenate(pooled, axis=1) + self.bias
                hidden = np.tanh(raw)
                p = 1 / (1 + np.exp(-(hidden @ self.out + self.base)))
                err = ((p - labels[some]) / len(some)).astype(np.float32)
                grads[-2], grads[-1] = hidden.T @ err + decay * self.out, err.sum(keepdims=True)
                back = (err[:, None] * self.out) * (1 - hidden * hidden)
                grads[-3] = back.sum(axis=0)
                places, moves = [], []
                for w, (c, best) in enumerate(zip(self.conv, picked)):
                    g = back[:, w * filters : (w + 1) * filters]
                    for k in range(len(c)):
                        at_k = np.minimum(best + k, len(flat) - 1)
                        grads[w][k] = np.einsum("nfd,nf->df", x[at_k], g) + decay * c[k]
                        places.append(flat[at_k].reshape(-1))
                        moves.append(np.repeat((g[:, :, None] * c[k].T[None]).reshape(-1, c.shape[1]), SLOTS, axis=0))
                touched, back_to = np.unique(np.concatenate(places), return_inverse=True)
                move = np.zeros((len(touched), x.shape[1]), np.float32)
                np.add.at(move, back_to, np.concatenate(moves))
                move[touched == 0] = 0
                past[touched] += (move * move).mean(axis=1)
                table[touched] -= embed_rate * (move / np.sqrt(past[touched])[:, None] + shrink * table[touched])
                step += 1
                for q, g, m, v in zip(params, grads, first, second):
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    q -= (rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step) * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        self.rows, self.embed = rows, table

    def evidence(self, buckets: np.ndarray) -> np.ndarray:
        """Of (words, SLOTS) buckets: (words, places, filters), embedding @ filter for every width and place."""
        return np.einsum("nd,pdf->npf", self.embed[self.rows[buckets]].sum(axis=1), np.concatenate(self.conv)).astype(np.float32)

    def logits(self, evidence: Iterator[np.ndarray]) -> np.ndarray:
        """Each document by itself, so that equal texts get equal scores whatever their batch."""
        pad, out = max(self.widths) - 1, []
        for e in evidence:
            e = np.concatenate([e, np.zeros((pad if len(e) else pad + 1, *e.shape[1:]), np.float32)])
            tops, at = [], 0
            for w in self.widths:
                act = e[:, at].copy()
                for k in range(1, w):
                    act[: len(e) - k] += e[k:, at + k]
                tops.append(act.max(axis=0))
                at += w
            out.append(np.tanh(np.concatenate(tops) + self.bias).astype(np.float64) @ self.out.astype(np.float64) + float(self.base[0]))
        return np.array(out)

    def calibrate(self, logits: np.ndarray, labels: np.ndarray) -> None:
        """Platt scaling by Newton steps."""
        if len(set(labels.tolist())) < 2:
            return
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
            w = p * (1 - p) + 1e-9
            g = np.array([((p - labels) * logits).sum() + 0.01 * (a - 1), (p - labels).sum()])
            h = np.array([[(w * logits * logits).sum() + 0.01, (w * logits).sum()], [(w * logits).sum(), w.sum()]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        if a > 0:
            self.scale, self.shift = float(a), float(b)

    def scores(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))


def best_cut(clean: np.ndarray, toxic: np.ndarray, common: float = 0.3) -> float:
    """From counts by bin of score the edge with the best F1, the middle one of equals; ``common`` without toxic texts."""
    if toxic.sum() <= 0:
        return common
    hits, called = np.cumsum(toxic[::-1])[::-1], np.cumsum((clean + toxic)[::-1])[::-1]
    f1 = 2 * hits / (called + toxic.sum())
    best = np.nonzero(f1 >= f1.max() - 1e-12)[0]
    return float(best[len(best) // 2]) / len(toxic)


class Trained:
    """What scoring needs: the model with its calibration; and the ids that it was fitted to."""

    def __init__(self, model: TextCNN | None, prior: float, fitted: list, kept_words: int = 100_000):
        self.model, self.prior, self.fitted, self.kept_words = model, prior, fitted, kept_words
        self.known: _Known | None = None

    def _evidence(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.known is None or len(self.known) > self.kept_words:
            self.known, self.table = _Known(), np.zeros((1 << 14, sum(self.model.widths), self.model.conv[0].shape[2]), np.float32)
        words = [words_of(t) for t in texts]
        ids = [np.fromiter(map(self.known.__getitem__, w), np.int64, len(w)) for w in words]
        while len(self.known) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if self.known.new:
            self.table[len(self.known) - len(self.known.new) : len(self.known)] = self.model.evidence(np.array(self.known.new, np.int32))
            self.known.new = []
        return [self.table[i] for i in ids]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), self.prior)
        return self.model.scores(self.model.logits(self._evidence(texts)))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 4000, sample_words: int = 5_000) -> Trained:
    """Fit on the texts of at most ``sample`` ids of ``labels``, by hash of the id, of at most ``sample_words`` words.

    The sampled labels are joined where the texts lie, so only their words' buckets are moved; of
    texts that share an id one is taken. Every fifth text is held back for the calibration. The driver
    gets at most 20 bytes for each of ``sample * sample_words`` words.
    """

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([word_ids(t).tobytes() for t in b.column(1).to_pylist()], pa.binary()), b.column(2)], names=["id", "ids", "label"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    some = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    some = some.orderBy(F.xxhash64(F.lit(9), "_id"), "_id").limit(sample)
    rows = docs.join(F.broadcast(some), F.col(id_col) == F.col("_id")).select(F.col(id_col), F.col(text_col), "_label")
    rows = rows.mapInArrow(ids, f"id {kind}, ids binary, label int").where(F.length("ids") <= 4 * SLOTS * sample_words)
    got = rows.groupBy("id").agg(F.min(F.struct("ids", "label")).alias("r")).select("id", "r.*").toArrow()
    held = got.column("ids").combine_chunks() if got.num_rows else pa.array([], pa.binary())
    held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
    # Views of one buffer: small copies of every text would stay with the driver's allocator.
    ends = np.frombuffer(held.buffers()[1], np.int32, len(held) + 1, held.offset * 4) if len(held) else np.zeros(1, np.int32)
    texts = [np.frombuffer(held.buffers()[2], np.int32, (b - a) // 4, a).reshape(-1, SLOTS) if b > a else np.zeros((0, SLOTS), np.int32) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    labels = np.array([1.0 if x == 1 else 0.0 for x in got.column("label").to_pylist()])
    names = got.column("id").to_pylist()
    del got
    if len(set(labels.tolist())) < 2:
        return Trained(None, float(labels.mean()) if len(labels) else 0.0, [])
    order = sorted(range(len(texts)), key=lambda i: (zlib.crc32(texts[i].tobytes()), i))  # the sample's order may differ between runs
    held = np.array(order[::5])
    rest = np.array([i for k, i in enumerate(order) if k % 5])
    model = TextCNN()
    model.fit([texts[i] for i in rest], labels[rest])
    logits = model.logits(model.evidence(texts[i]) for i in held)
    model.calibrate(logits, labels[held])
    return Trained(model, float(labels.mean()), [names[i] for i in rest])


def thresholds(scored: DataFrame, labels: DataFrame, trained: Trained, *, id_col: str = "doc_id", label_col: str = "toxic", lang_col: str = "lang") -> tuple[dict[str, float], float]:
    """By language, and the common one. ``scored`` has id, language and score.

    All labelled rows count but those of the texts that the model was fitted to. The driver gets one
    row for each language, bin and label.
    """
    spark = scored.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    if trained.fitted:  # as many as the sample at most
        kind = dict(scored.dtypes)[id_col]
        known = known.join(F.broadcast(spark.createDataFrame([(i,) for i in trained.fitted], f"_id {kind}")), "_id", "left_anti")
    seen = scored.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("lang"), F.least(F.floor(F.col("score") * CUTS), F.lit(CUTS - 1)).cast("int").alias("bin"))
    counts = seen.join(known, "_id").groupBy("lang", "bin", "_label").agg(F.count("*").alias("n")).collect()
    every, by = np.zeros((2, CUTS)), {}
    for r in counts:
        for h in (every, by.setdefault(r["lang"], np.zeros((2, CUTS)))):
            h[int(r["_label"] == 1), r["bin"]] += r["n"]
    common = best_cut(*every)
    prior = every * (SHRINK / max(every.sum(), 1.0))
    return {lang: best_cut(*(h + prior), common) for lang, h in by.items() if lang is not None}, common


def score(docs: DataFrame, trained: Trained, *, text_col: str = "text") -> DataFrame:
    """``docs`` with score; this name must be free."""
    bounded_batches(docs.sparkSession)
    if "score" in docs.columns:
        raise ValueError("columns in the way: ['score']")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.names.index(text_col))
            scores = np.concatenate([trained(texts.slice(i, 64).to_pylist()) for i in range(0, len(texts), 64)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores)], names=[*b.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def classified(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", sample: int = 4000, keep_text: bool = True) -> DataFrame:
    """``docs`` (without its text unless ``keep_text``) with score, threshold (of its language) and toxic; these names must be free.

    Texts are scored once; scores are checkpointed, since thresholds come from them.
    """
    clash = {"score", "threshold", "toxic"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    trained = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample)
    scored = score(docs, trained, text_col=text_col)
    scored = cut(scored if keep_text else scored.drop(text_col))
    own, common = thresholds(scored, labels, trained, id_col=id_col, label_col=label_col, lang_col=lang_col)
    limit = F.lit(common)
    if own:
        limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in own.items() for x in pair]), F.coalesce(F.col(lang_col).cast("string"), F.lit(""))), limit)
    return scored.withColumn("threshold", limit).withColumn("toxic", F.col("score") >= F.col("threshold"))
