"""Secret scan with DataFrame functions only: patterns, and a battery of randomness tests.

Three kinds of spans come from patterns: assignments to names such as ``token``, access keys and
long hexadecimal runs. A fourth, ``random``, comes from other long runs of key characters. For each
the smallest encoding that holds it is inferred, and three tests against it are made: chi-squared of
the symbol counts, runs above and below the middle of the alphabet, and serial correlation. The
product of their tail probabilities is the run's score: high for symbols drawn at random.

A run is reported only where its score is too high for ordinary text. The null hypothesis is "an
ordinary token", and its distribution is taken from the whole corpus: every document, its long runs left
out and reduced to the characters of an encoding, is cut into windows of each length, end to end, so that
every character stands in one; windows are scored like runs. The share of windows that score as high as
a run is its p-value (with one added above and below, so it is never 0). It makes no use of the
approximations behind the scores, which only order the runs. Within each class of encoding and
length the false-discovery rate of what is *reported* is controlled (Benjamini-Hochberg). A class without
runs has nothing to report, so its windows aren't made.

The counts behind that are histograms of fixed size over all documents. A document's spans stay in
its row: nothing is joined or shuffled by document. Texts are read twice: for the runs, then for the windows.

Defined cases: a null or empty text has no spans and no windows; equal rows get equal results; ids may
be null; runs of padding score 0; where no text gives a window of some class, nothing of that class is
reported; no rows give no rows; columns other than id and text are not read. Offsets are code points.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redquill.llm.runtime import cut

# Fixed patterns of the three base kinds, with the group that holds the value and its least length.
KINDS = (
    ("assign", r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
)
RUN = r"([A-Za-z0-9+/_=-]{20,})"
RUN_AT_ONCE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"  # the same runs, not sought from within a word
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Encodings that share a distribution of ordinary text: name, symbols in order, the characters of a
# text that are among them, and the case to which a text is brought first.
ENCODINGS = (
    ("decimal", DIGITS, "0-9", None),
    ("hex", DIGITS + "abcdef", "0-9a-f", "lower"),
    ("one case", LOWER, "a-z", "lower"),
    ("base32", LOWER + "234567", "a-z2-7", "lower"),
    ("base36", DIGITS + LOWER, "0-9a-z", "lower"),
    ("letters", UPPER + LOWER, "A-Za-z", None),
    ("base64", UPPER + LOWER + DIGITS + "+/", "A-Za-z0-9+/", None),
)
# Whole runs by rising size of the encoding that they are given to; any other run is base64.
RUNS = (("[0-9]+", 0), ("[0-9a-f]+|[0-9A-F]+", 1), ("[a-z]+|[A-Z]+", 2), ("[A-Z2-7]+=*", 3), ("[0-9a-z]+", 4), ("[A-Za-z]+", 5))
LENGTHS = (20, 28, 40, 64)
BINS = 240
SPAN = "struct<start:int,rank:int,end:int,kind:string>"
FOUND = "array<struct<start:int,rank:int,end:int,kind:string>>"


def spans(text: str, pattern: str, kind: str, rank: int, group: int, least: int) -> Column:
    """Leftmost, non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more."""
    found, values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    # (gap before, match, value) in order; the gap after the last match is left out.
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("match"), values.alias("value"))

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["gap"])
        end = start + F.length(row["match"])
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("at"), F.when(F.length(row["value"]) >= least, F.concat(state["all"], one)).otherwise(state["all"]).alias("all"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("all"))
    return F.when(F.col(text).rlike(pattern), F.aggregate(rows, start, step, lambda s: s["all"])).otherwise(F.array().cast(FOUND))


def upper_tail(z: Column, t: Column) -> Column:
    """P(N > z), by the rational approximation 26.2.17 of Abramowitz and Stegun; t = 1 / (1 + 0.2316419 |z|)."""
    p = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, p).otherwise(1 - p)


def score(text: Column, symbols: Column) -> Column:
    """The bin of a string's score, in half-octaves, 0 for the most random; ``BINS`` - 1 if it has one symbol or none.

    The score is the product of three tail probabilities: chi-squared (above), runs and serial correlation (either side).
    """

    # Each step binds what the next one uses more than once.
    def coded(x: Column) -> Column:
        return F.struct(F.transform(x["chars"], lambda c: F.instr(x["symbols"], c) - 1).alias("u"), F.length(x["symbols"]).cast("double").alias("a"))

    def summed(x: Column) -> Column:
        # Sorted codes: a symbol's k-th occurrence adds 2 * k - 1 to its squared count. State: sum, k and code in one number.
        def count(t: Column, v: Column) -> Column:
            k = F.shiftright(t, 8).bitwiseAND(F.lit(0xFFFF))
            return F.when(t.bitwiseAND(F.lit(255)) == v, t + F.shiftleft(2 * k + 1, 24) + 256).otherwise((F.shiftright(t, 24) + 1) * (1 << 24) + 256 + v)

        middle = (x["a"] - 1) / 2  # no code lies on it, as sizes are even
        squares = F.aggregate(F.sort_array(x["u"]), F.lit(255).cast("long"), count, lambda t: F.shiftright(t, 24))

        def step(t: Column, v: Column) -> Column:
            d = v - middle
            return F.struct(d.alias("d"), (t["turns"] + F.when(t["d"] * d < 0, 1.0).otherwise(0.0)).alias("turns"), (t["serial"] + t["d"] * d).alias("serial"))

        start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("turns"), F.lit(0.0).alias("serial"))
        n = F.greatest(F.size(x["u"]), F.lit(2)).cast("double")
        return F.struct(squares.alias("squares"), F.aggregate(x["u"], start, step).alias("w"), x["a"].alias("a"), n.alias("n"), (F.size(x["u"]) < 2).alias("short"))

    out = F.array(F.struct(F.split(text, "").alias("chars"), symbols.alias("symbols")))
    for f in (coded, summed, _deviations, _binned):
        out = F.transform(out, f)
    return out[0]


def deviations(a: Column, n: Column, squares: Column, turns: Column, serial: Column) -> list[Column]:
    """Of the symbols' counts, the runs and the serial correlation, in standard deviations."""
    chi = (a / n * squares - n - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
    return [chi, F.abs(turns - (n - 1) / 2) / F.sqrt((n - 1) / 4), F.abs(serial) / ((a * a - 1) / 12) / F.sqrt(n - 1)]


def _t(z: Column) -> Column:
    return 1 / (1 + 0.2316419 * F.abs(z))


def tail_bits(z: Column, t: Column) -> Column:
    return F.log2(F.greatest(upper_tail(z, t), F.lit(1e-300)))


def _bin(bits: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(-2 * bits))).cast("int")


def _deviations(x: Column) -> Column:
    return F.struct(F.array(*deviations(x["a"], x["n"], x["squares"], x["w"]["turns"], x["w"]["serial"])).alias("z"), x["short"].alias("short"))


def _binned(x: Column) -> Column:
    bits = F.aggregate(F.transform(x["z"], lambda z: F.struct(z.alias("z"), _t(z).alias("t"))), F.lit(2.0), lambda sum_, v: sum_ + tail_bits(v["z"], v["t"]))
    return F.when(x["short"], BINS - 1).otherwise(_bin(bits))


def window_scores(rows: DataFrame, text: str, of: int, *carry: str) -> DataFrame:
    """``carry`` and x, the class ``of`` and the bin of each window in one number, a row a window: ``score``, of whole words of bits.

    Windows are cut end to end, the last one at the text's end. Bit i of plane b is bit b of the window's i-th symbol: the statistics
    are counts of bits in planes. Every select binds what the next one uses more than once; there are no lambdas, so all is compiled.
    """
    encoding, n = of // len(LENGTHS), LENGTHS[of % len(LENGTHS)]
    _, symbols, kept, case = ENCODINGS[encoding]
    a, places, planes = len(symbols), range(n), range(6)
    half = a // 2
    values = [u + (32 - half) * (u >= half) for u in range(a)]  # six bits a symbol, of which the last tells the upper half
    parts = [1, 2, 4, 8, 16, half]  # of a bit in the symbol's place
    stream = F.translate(F.regexp_replace(F.lower(text) if case else F.col(text), f"[^{kept}]+", ""), symbols, "".join(chr(64 + v) for v in values))
    tiles = F.regexp_extract_all("s", F.lit(f".{{{n}}}"), F.lit(0))
    cut_up = F.when(F.length("s") % n == 0, tiles).otherwise(F.concat(tiles, F.array(F.right("s", F.lit(n)))))
    # An outer explode: a plain one has the texts cut once more in a filter.
    out = rows.select(*carry, stream.alias("s")).select(*carry, F.explode_outer(F.when(F.length("s") >= n, cut_up)).alias("w")).where("w is not null")
    out = out.selectExpr(*carry, "coalesce(w, '') as w").selectExpr(*carry, *(f"ascii(substring(w, {i + 1}, 1)) as c{i}" for i in places))
    # Eight numbers hold every eighth symbol, a byte a symbol, and each gives a plane every eighth bit: few steps, as compiled methods have to stay small.
    out = out.selectExpr(*carry, *(" | ".join(f"shiftleft(cast(c{i} as bigint), {i - j})" for i in places if i % 8 == j) + f" as q{j}" for j in range(8)))
    out = out.selectExpr(*carry, *(" | ".join(f"shiftleft(shiftright(q{j}, {b}) & {0x0101010101010101}L, {j})" for j in range(8)) + f" as p{b}" for b in planes))
    # Places of the symbols with some value in the three lower bits, and in the three upper ones.
    some = lambda x, first: " & ".join(f"p{first + b}" if x >> b & 1 else f"~p{first + b}" for b in range(3))
    whole, but_one = (1 << n) - 1 if n < 64 else -1, (1 << (n - 1)) - 1
    out = out.selectExpr(*carry, *(f"p{b}" for b in planes), *(f"{some(x, 0)} & {whole}L as l{x}" for x in range(8)), *(f"{some(x, 3)} as h{x}" for x in range(8)))
    out = out.selectExpr(*carry, *(f"p{b}" for b in planes), *(f"bit_count(l{v & 7} & h{v >> 3}) as n{u}" for u, v in enumerate(values)))
    # Twice the distance from the middle is 2 u - (a - 1) for symbol u; serial sums the products of neighbours.
    pairs = " + ".join(f"{parts[b] * parts[d]} * bit_count(p{b} & shiftright(p{d}, 1) & {but_one}L)" for b in planes for d in planes)
    ends = " + ".join(f"{parts[b]} * (bit_count(p{b} & {but_one}L) + bit_count(shiftright(p{b}, 1) & {but_one}L))" for b in planes)
    out = out.selectExpr(
        *carry, f"cast({' + '.join(f'n{u} * n{u}' for u in range(a))} as double) as squares", f"cast(bit_count((p5 ^ shiftright(p5, 1)) & {but_one}L) as double) as turns",
        f"cast(4 * ({pairs}) - {2 * (a - 1)} * ({ends}) + {(n - 1) * (a - 1) ** 2} as double) / 4D as serial",
    )
    z = deviations(F.lit(float(a)), F.lit(float(n)), F.col("squares"), F.col("turns"), F.col("serial"))
    out = out.select(*carry, *(x.alias(f"z{i}") for i, x in enumerate(z)))
    out = out.select(*carry, *(f"z{i}" for i in range(3)), *(_t(F.col(f"z{i}")).alias(f"t{i}") for i in range(3)))
    out = out.select(*carry, *(tail_bits(F.col(f"z{i}"), F.col(f"t{i}")).alias(f"b{i}") for i in range(3)))
    return out.select(*carry, (_bin(F.lit(2.0) + F.col("b0") + F.col("b1") + F.col("b2")) + of * BINS).alias("x"))


def length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(LENGTHS[1:], 1):
        out = F.when(n >= least, F.lit(i)).otherwise(out)
    return out


def encoding_of(run: Column) -> Column:
    """The place in ENCODINGS of the smallest one that holds a run."""
    return F.coalesce(*[F.when(run.rlike(f"^(?:{p})$"), F.lit(i)) for p, i in RUNS], F.lit(len(ENCODINGS) - 1))


def as_symbols(run: Column, encoding: Column) -> Column:
    """A run without its padding, in the symbols of its encoding."""
    body = F.rtrim(run, F.lit("="))
    return F.when(encoding.between(1, 4), F.lower(body)).otherwise(F.translate(body, "-_=", "+/+"))


def coded_scores(run: Column) -> Column:
    """Class and bin of a run in one number: (encoding * lengths + length) * BINS + bin."""
    encoding = F.array(encoding_of(run))
    symbols = lambda e: F.element_at(F.array(*[F.lit(x) for _, x, *_ in ENCODINGS]), e + 1)
    return F.transform(encoding, lambda e: (e * len(LENGTHS) + length_class(F.length(run))) * BINS + score(as_symbols(run, e), symbols(e)))[0]


def ordinary(texts: DataFrame, classes: list[int], *carry: str) -> DataFrame:
    """``carry`` and x, the coded score of a window, for all windows of the ordinary text in ``texts``, of some classes."""
    plain = texts.withColumn("_plain", F.regexp_replace("text", RUN_AT_ONCE, " "))
    out = [window_scores(plain, "_plain", c, *carry) for c in classes]
    return reduce(DataFrame.unionByName, out)


def windows(rows: DataFrame, classes: list[int] | None = None) -> DataFrame:
    """``rows`` (text, ...) with column ``null``: the coded scores of all windows of its ordinary text, of all classes or of some."""
    numbered = cut(rows.withColumn("_row", F.monotonically_increasing_id()))
    every = list(range(len(ENCODINGS) * len(LENGTHS))) if classes is None else classes
    scores = ordinary(numbered, every, "_row").groupBy("_row").agg(F.collect_list("x").alias("null"))
    return numbered.join(scores, "_row", "left").withColumn("null", F.coalesce("null", F.array().cast("array<int>"))).drop("_row")


def limits(texts: DataFrame, scored: DataFrame, rate: float) -> dict[int, int]:
    """By class the greatest bin that is reported; ``scored`` has the runs of ``texts`` with their codes, ``tested``."""
    # An outer explode: a plain one has the scores worked out once more in a filter.
    each = lambda df, c, kind: df.select(F.explode_outer(c).alias("x"), F.lit(kind).alias("run")).where("x is not null")
    runs = each(scored, F.transform("tested", lambda t: t["code"]), 1)
    classes = sorted(r[0] for r in runs.select(F.floor(F.col("x") / BINS).cast("int")).distinct().collect())
    if not classes:
        return {}
    counts = runs.unionByName(ordinary(texts, classes).withColumn("run", F.lit(0))).groupBy(F.floor(F.col("x") / BINS).cast("int").alias("class"), (F.col("x") % BINS).alias("bin"))
    counts = counts.agg(F.sum("run").alias("runs"), F.sum(1 - F.col("run")).alias("ordinary"))
    so_far, whole = Window.partitionBy("class").orderBy("bin"), Window.partitionBy("class")
    p = (1 + F.sum("ordinary").over(so_far)) / (1 + F.sum("ordinary").over(whole))
    ranked = counts.select("class", "bin", "runs", (p * F.sum("runs").over(whole) <= rate * F.sum("runs").over(so_far)).alias("ok"))
    best = ranked.where("ok and runs > 0").groupBy("class").agg(F.max("bin").alias("bin"))
    return {r["class"]: r["bin"] for r in best.collect()}  # a row a class at most


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans, found (the spans as an array) for every row.

    ``rate``: the false-discovery rate among the ``random`` spans that are reported, by class.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = F.concat(*[spans("text", pattern, kind, i, group, least) for i, (kind, pattern, group, least) in enumerate(KINDS)])
    texts = rows
    rows = rows.withColumn("base", F.array_sort(base)).withColumn("runs", spans("text", RUN, "random", len(KINDS), 1, LENGTHS[0]))
    free = F.filter("runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    tested = F.transform(free, lambda r: F.struct(r.alias("span"), coded_scores(F.substring(F.col("text"), r["start"] + 1, r["end"] - r["start"])).alias("code")))
    rows = cut(rows.select("doc_id", "base", tested.alias("tested")))
    most = limits(texts, rows, rate)
    allowed = F.array(*[F.lit(most.get(c, -1)) for c in range(len(ENCODINGS) * len(LENGTHS))])
    kept = F.filter("tested", lambda t: t["code"] % BINS <= F.element_at(allowed, F.floor(t["code"] / BINS).cast("int") + 1))
    rows = rows.withColumn("random", F.transform(kept, lambda t: t["span"]))
    every = F.array_sort(F.concat("base", "random"))
    join = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda i: F.size(F.filter("base", lambda s: s["rank"] == F.lit(i))).cast("long")
    return rows.select("doc_id", *(of(i).alias(f"n_{kind}") for i, (kind, *_) in enumerate(KINDS)), F.size("random").cast("long").alias("n_random"), F.sha2(join("base").cast("binary"), 256).alias("base_sha256"), join(every).alias("spans"), every.alias("found"))
