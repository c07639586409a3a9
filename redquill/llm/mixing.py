"""Mixing sources to target weights with a low-discrepancy schedule.

Targets come from the sources' weights, capped at ``repeat`` times a source's size with the rest
shared out again. The mix is a schedule of slots of ``block`` words. Slot i takes the golden-ratio
point frac(i * phi) through the cumulative slot counts to a source, the slots of a source are
ranked, and rank k reads block k (cyclically, one epoch after another) of that source's shuffled
word stream. The last slot of a source is cut at its target, so targets are met to the word.

Defined cases: a null text has no words, a null source is a source of its own and comes last; rows
without words are returned with nothing taken; equal rows are separate documents; an input without
words (or rows) takes nothing; columns other than id, text and source are not read. Sources are a
dimension: one row a source is brought to the driver, nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redquill.llm.runtime import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CHUNK = 1 << 14
PHI = 0.6180339887498949


def targets(sizes: list[int], weights: list[float], total: float, repeat: float = 3.0) -> list[float]:
    """Shares of ``total`` by weight, none above ``repeat`` times its size; the excess goes by weight to the rest."""
    out, open_ = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0}
    left = float(total)
    while open_:
        by = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / by > repeat * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / by
            break
        for i in over:
            out[i] = float(repeat * sizes[i])
            left -= out[i]
        open_ -= over
    return out


def sized(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeat: float = 3.0, block: int = 64) -> list[dict]:
    """One entry a source, by code point with null last: s, source, size, target, quota, blocks, slots."""
    got = sorted(rows.groupBy("source").agg(F.sum("size").alias("size")).collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["size"] or 0) for r in got]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(got))], sum(sizes), repeat)
    out = []
    for s, (r, size, aim) in enumerate(zip(got, sizes, aims)):
        quota, blocks = int(aim + 1e-9), -(-size // block)
        slots = quota // size * blocks + -(-(quota % size) // block) if size else 0
        out.append({"s": s, "source": r["source"], "size": size, "target": aim, "quota": quota, "blocks": blocks, "slots": slots})
    return out


def with_plan(rows: DataFrame, entries: list[dict]) -> DataFrame:
    """``rows`` with s, source_size and target of its source; entries is one row a source."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(e["s"], e["source"], e["size"], e["target"]) for e in entries], "s int, named string, source_size long, target double")
    return rows.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("named"))).drop("named")


def streams(rows: DataFrame, n_docs: int, bucket_docs: int = 2000, seed: int = 11) -> DataFrame:
    """``rows`` (doc_id, s, size, ...) with start: the place of its words in its source's shuffled stream.

    Two levels: running sums inside hash buckets, whose totals are summed by source. No source is
    gathered in one task.
    """
    buckets = max(32, -(-n_docs // bucket_docs))
    mixed = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 16), F.lit(buckets)))
    inside = Window.partitionBy("s", "bucket").orderBy("h", "doc_id", "size")
    sums = mixed.groupBy("s", "bucket").agg(F.sum("size").alias("words"))
    before = sums.withColumn("base", F.sum("words").over(Window.partitionBy("s").orderBy("bucket")) - F.col("words")).select("s", "bucket", "base")
    placed = mixed.withColumn("start", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    return placed.join(before, ["s", "bucket"]).withColumn("start", F.col("start") + F.col("base")).drop("h", "bucket", "base")


def schedule(spark, entries: list[dict], chunk: int = CHUNK) -> DataFrame:
    """slot, s, rank: which source each slot of the mix takes, ranked within it.

    Ranks are counted inside chunks of slots and offset by the counts of earlier chunks. Where the
    points gave a source more than its slots the last are left out; where fewer, it gets the rest
    at the end.
    """
    live = [e for e in entries if e["slots"]]
    n = sum(e["slots"] for e in live)
    slots = spark.range(n).select(F.col("id").alias("slot"))
    # frac(i * phi), exact enough for any i: the high and low parts apart
    high, low = F.floor(F.col("slot") / (1 << 24)), F.col("slot") % (1 << 24)
    step = ((1 << 24) * 11400714819323198485 % (1 << 64)) / 2.0**64
    point = high * F.lit(step) + low * F.lit(PHI)
    point = (point - F.floor(point)) * F.lit(float(n))
    ends, at = [], 0
    for e in live:
        at += e["slots"]
        ends.append((at, e["s"]))
    def pick(lo: int, hi: int):  # a balanced tree of comparisons over the cumulative counts
        if hi - lo == 1:
            return F.lit(ends[lo][1])
        mid = (lo + hi) // 2
        return F.when(F.col("point") < F.lit(float(ends[mid - 1][0])), pick(lo, mid)).otherwise(pick(mid, hi))

    dealt = slots.withColumn("point", point).withColumn("s", (pick(0, len(ends)) if ends else F.lit(0)).cast("int")).withColumn("chunk", F.floor(F.col("slot") / chunk)).drop("point")
    counts = dealt.groupBy("s", "chunk").agg(F.count("*").alias("c"))
    before = counts.withColumn("base", F.sum("c").over(Window.partitionBy("s").orderBy("chunk")) - F.col("c")).select("s", "chunk", "base")
    ranked = dealt.withColumn("r", F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1).join(before, ["s", "chunk"]).withColumn("rank", F.col("r") + F.col("base"))
    wanted = spark.createDataFrame([(e["s"], e["slots"]) for e in live], "s int, slots long")
    kept = ranked.join(F.broadcast(wanted), "s").where("rank < slots").select("slot", "s", "rank")
    short = wanted.join(counts.groupBy("s").agg(F.sum("c").alias("got")), "s", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots")
    tail = short.select("s", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("rank")).select((F.lit(n) + F.col("s") * F.lit(1 << 32) + F.col("rank")).alias("slot"), "s", "rank")
    return kept.unionByName(tail)


def mix(placed: DataFrame, entries: list[dict], block: int = 64) -> DataFrame:
    """slot, epoch, s, doc_id, start, at, words: the mix, as spans of documents.

    ``placed``: the documents with s, start and size. ``at``: the first word taken, in the document.
    """
    spark = placed.sparkSession
    facts = spark.createDataFrame([(e["s"], e["quota"], e["blocks"], e["size"]) for e in entries if e["slots"]], "s int, quota long, blocks long, source_words long")
    slots = schedule(spark, entries).join(F.broadcast(facts), "s").select("slot", "s", F.floor(F.col("rank") / F.col("blocks")).alias("epoch"), (F.col("rank") % F.col("blocks")).alias("block"), "quota", "source_words")
    pieces = placed.where("size > 0").select("doc_id", "s", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    joined = slots.join(pieces, ["s", "block"])
    first = F.greatest(F.col("start"), F.col("block") * block)
    last = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block, F.col("quota") - F.col("epoch") * F.col("source_words"))
    return joined.withColumn("at", first - F.col("start")).withColumn("words", last - first).where("words > 0").select("slot", "epoch", "s", "doc_id", "start", "at", "words")


def mixed_counts(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, repeat: float = 3.0, block: int = 64, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row: the words that the mix takes of it."""
    rows = cut(sized(docs, id_col=id_col, text_col=text_col, source_col=source_col))
    entries = plan(rows, weights, repeat, block)
    if not entries:
        return rows.select("doc_id", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    placed = cut(streams(with_plan(rows, entries), rows.count()))
    spans = mix(placed, entries, block).groupBy("s", "start").agg(F.sum("words").alias("taken"))
    # A row with words has a place of its own in its source's stream.
    whole = placed.withColumn("place", F.when(F.col("size") > 0, F.col("start")))
    return whole.join(spans.withColumnRenamed("start", "place"), ["s", "place"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, repeat: float = 3.0, block: int = 64, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of ``docs`` with what the mix takes of them: one row an epoch, the text cut where the quota ends.

    A cut text is its first words, joined by one space. The names s, start, size, epoch, took and
    source_size, target, h, bucket, base must be free.
    """
    rows = docs.withColumn("size", F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long"))
    plain = rows.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), "size")
    entries = plan(plain, weights, repeat, block)
    if not entries:
        return docs
    n_docs = docs.count()
    placed = streams(with_plan(plain, entries), n_docs)
    takes = cut(mix(placed, entries, block).groupBy("s", "start", "epoch").agg(F.sum("words").alias("took")))
    held = streams(with_plan(rows.where("size > 0").withColumnRenamed(id_col, "doc_id").withColumn("source", F.col(source_col).cast("string")), entries), n_docs)
    out = held.join(takes, ["s", "start"])
    words = F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), 1, F.col("took").cast("int"))
    return out.withColumn(text_col, F.when(F.col("took") < F.col("size"), F.array_join(words, " ")).otherwise(F.col(text_col))).withColumnRenamed("doc_id", id_col).select(*docs.columns)
