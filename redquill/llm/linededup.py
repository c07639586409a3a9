"""Line deduplication with DataFrame functions only: exact lines, and a segment-partition edit join.

Two lines within r edits share one of r + 1 segments of the shorter, nearly at the same place. Every
line therefore indexes its segments and probes, by length, the few places where a segment of a line of
that length can lie. First only keys are counted; keys that a single line has are dropped, and just the
lines behind the others go on. Pairs of a key are made in bounded groups. A key with many lines is refined
instead: the shared segment is taken out of each line, then what all of its lines have in common before
and behind, and what is left is cut into segments again; within r edits, it still shares one. A group
that can't be refined is compared whole. In every group all lines meet its most frequent line first, and two
lines that are near that one don't meet: they are in one class already.

Lines that meet and whose letters and pairs of letters allow it are verified by a banded bit-parallel automaton over the
part between their common ends: one word for each number of edits, one bit for each diagonal of the band.
Lines that are linked, directly or through others, are one class, and only the first line of a class (by
id, text and line number) stays. 128 bits name a line.

The edits allowed grow with the shorter line: ``chars_per_edit`` characters an edit, ``radius`` at most, so
short lines only match exactly. Exact copies are combined before any shuffle.

Defined cases: a null or empty text has no lines and is kept as an empty one; blank lines are never
removed; rows with equal id and text are one document repeated and are treated alike; null ids sort
first; no rows give no rows; columns other than id, text and those to carry are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redquill.llm.components import components
from redquill.llm.runtime import cut

BROADCAST_ROWS = 500_000


HOT = 512  # lines of a key whose pairs are made at once; more are refined
LEVELS = 6


def _specs(radius: int) -> list[tuple[int, int, int, int, bool]]:
    """(edits, how much shorter the indexed line is, segment, shift, own) of every key that a line has."""
    out = []
    for r in range(1, radius + 1):
        for less in range(r + 1):
            for i in range(r + 1):
                for shift in range(max(-i, less - (r - i)), min(i, less + (r - i)) + 1):
                    out.append((r, less, i, shift, less == 0 and shift == 0))
    return out


def segment_keys(lines: DataFrame, radius: int, edits, *carry: str) -> DataFrame:
    """key, own (whether it is of a segment of the line's own), at (from 1), size and ``carry``, a row for each key of a line.

    ``lines`` has line, n (its length) and tag; ``edits`` gives the edits allowed to a line from its length.
    A segment of a line of length l is found at its place or a little off; even segments, the longer ones last.
    """
    as_array = lambda specs: F.array(*[F.struct(*(F.lit(x).alias(c) for c, x in zip(("r", "less", "i", "shift", "own"), spec))) for spec in specs])
    every = _specs(radius)
    # Lines that have the most edits however much shorter the other is need no keys for fewer.
    specs = F.when((F.col("n") > radius) & (edits(F.col("n") - radius) == radius), as_array([x for x in every if x[0] == radius])).otherwise(as_array(every))
    rows = lines.select("line", "n", "tag", *carry, F.explode(specs).alias("s"))
    r, i, length = F.col("s.r"), F.col("s.i"), F.col("n") - F.col("s.less")
    rows = rows.where((length > r) & (edits(length) == r))
    size, short = F.call_function("div", length, r + 1), (r + 1) - length % (r + 1)  # so many segments have the lesser length
    # A place off by the shifts that there are still lies within the line, as no segment is empty.
    rows = rows.select("*", (i * size + F.greatest(i - short, F.lit(0)) + 1 + F.col("s.shift")).cast("int").alias("at"), (size + (i >= short).cast("int")).cast("int").alias("size"))
    # A line of one byte a character is cut by bytes, which needs no walk from its start.
    part = F.when(F.octet_length("line") == F.col("n"), F.substring(F.col("line").cast("binary"), F.col("at"), F.col("size"))).otherwise(F.substring("line", F.col("at"), F.col("size")).cast("binary"))
    key = F.xxhash64("tag", length.cast("int"), r, i, part)
    return rows.select(key.alias("key"), F.col("s.own").alias("own"), "at", "size", *carry)


def common_start(x: Column, y: Column) -> Column:
    """How many first characters are equal: steps of falling powers of two (lines of up to 2 ** 24 characters)."""

    def start(s: Column) -> Column:
        same = lambda at, step: F.substring(s["x"], at + 1, step) == F.substring(s["y"], at + 1, step)
        steps = F.filter(F.array(*[F.lit(1 << k) for k in reversed(range(24))]), lambda k: k <= s["most"])
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= s["most"]) & same(at, step), at + step).otherwise(at))

    # Bound to a variable, so that neither side is worked out again at every step.
    return F.transform(F.array(F.struct(x.alias("x"), y.alias("y"), F.least(F.length(x), F.length(y)).alias("most"))), start)[0]


LETTERS = "etaoinsrhldu"  # frequent in the Latin script; others make the filter weaker, never wrong
FIELD = 5


def letter_counts(line: Column) -> Column:
    """Counts of twelve letters, modulo 32, in one long."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(LETTERS):
        count = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).cast("long")
        out = out.bitwiseOR(F.shiftleft(count.bitwiseAND(F.lit(31)), FIELD * i))
    return out


def letters_apart(a: Column, b: Column) -> Column:
    """A lower bound on how many letters must go or come; an edit changes two at most."""
    out = F.lit(0)
    for i in range(len(LETTERS)):
        d = (F.shiftright(a, FIELD * i).bitwiseAND(F.lit(31)) - F.shiftright(b, FIELD * i).bitwiseAND(F.lit(31))).bitwiseAND(F.lit(31))
        out = out + F.least(d, 32 - d)
    return out


def pair_parities(line: Column) -> Column:
    """128 bits in two longs: of every hash of two neighbouring characters, whether it occurs an odd number of times."""
    chars = F.split(line, "")

    def pairs(c: Column) -> Column:
        return F.transform(c, lambda x, i: F.xxhash64(x, F.get(c, i + 1)).bitwiseAND(127).cast("int"))

    def half(bits: Column, top: bool) -> Column:
        own = F.filter(bits, lambda b: b >= 64 if top else b < 64)
        return F.aggregate(own, F.lit(0).cast("long"), lambda x, b: x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b % 64)))

    # Each step binds what the next one uses more than once.
    bits = F.transform(F.transform(F.array(chars), pairs), lambda b: F.array(half(b, False), half(b, True)))
    return bits[0]


def parities_apart(a: Column, b: Column) -> Column:
    """In how many bits two parities differ; an edit changes four at most: two pairs of characters go, two come."""
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def within(a: Column, b: Column, allowed: Column, radius: int) -> Column:
    """Whether two arrays of characters are at most ``allowed`` (``radius`` at most) edits apart.

    One number holds a lane of 2 * radius + 1 bits for each number e of edits: bit d of lane e is set
    if, e edits spent at most, the first j characters of b match the first j + d - radius of a. Once the last
    lane is empty no later character is looked at.
    """
    width = 2 * radius + 1
    lanes = lambda bits, first: sum(bits << (width * e) for e in range(first, radius + 1))
    full, every = (1 << width) - 1, lanes(1, 0)

    def step(state: Column, j: Column) -> Column:
        c = F.get(b, j)
        equal = F.lit(0).cast("long")
        for d in range(width):
            at = j + (d - radius)
            equal = equal + F.when((at >= 0) & (F.get(a, at) == c), 1 << d).otherwise(0)
        # a match; another character instead; one more in b
        stayed = state.bitwiseAND(equal * every)
        spent = F.shiftleft(state, width).bitwiseAND(F.lit(lanes(full, 1))).bitwiseOR(F.shiftleft(state, width - 1).bitwiseAND(F.lit(lanes(full >> 1, 1))))

        def more_in_a(x: Column) -> Column:
            out = x
            for k in range(1, radius + 1):
                out = out.bitwiseOR(F.shiftleft(x, k * (width + 1)).bitwiseAND(F.lit(lanes(full >> k << k, k))))
            return out

        return F.when(state.bitwiseAND(F.lit(full << (width * radius))) == 0, state).otherwise(F.transform(F.array(stayed.bitwiseOR(spent)), more_in_a)[0])

    start = sum(1 << (width * e + radius + d) for e in range(radius + 1) for d in range(e + 1))
    end = F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.lit(start).cast("long"), step)
    place = F.size(a) - F.size(b) + radius + allowed * width
    return (F.abs(F.size(a) - F.size(b)) <= allowed) & (F.call_function("shiftright", end, place) % 2 == 1)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a line that isn't blank: doc_id, t (hash of the text), no, line, k and k2 (128 bits), n."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    rows = rows.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n", -1)).alias("no", "line")).where("line rlike '\\\\S'")
    return rows.withColumn("k", F.xxhash64("line")).withColumn("k2", F.xxhash64(F.lit(5), "line")).withColumn("n", F.length("line"))


def _apart(x: str, y: str, radius: int) -> Column:
    """Whether lengths and letters of two lines rule out ``radius`` edits."""
    return (F.abs(F.col(f"{x}.n") - F.col(f"{y}.n")) > radius) | (letters_apart(F.col(f"{x}.letters"), F.col(f"{y}.letters")) > 2 * radius)


def verified(pairs: DataFrame, texts: DataFrame, radius: int, chars_per_edit: int) -> DataFrame:
    """The pairs (a, b) of nodes whose lines are within their allowed edits."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("line").alias("y")), "b")
    allowed = F.least(F.lit(radius), F.floor(F.least(F.length("x"), F.length("y")) / chars_per_edit).cast("int"))
    # Each step binds what the next one uses more than once.
    steps = F.array(F.struct("x", "y", allowed.alias("allowed"), common_start(F.col("x"), F.col("y")).alias("p")))
    tail = lambda c, p: F.substring(c, p + 1, F.length(c))
    steps = F.transform(steps, lambda s: F.struct(tail(s["x"], s["p"]).alias("x"), tail(s["y"], s["p"]).alias("y"), s["allowed"].alias("allowed")))
    steps = F.transform(steps, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["allowed"].alias("allowed"), common_start(F.reverse(s["x"]), F.reverse(s["y"])).alias("e")))
    steps = F.transform(steps, lambda s: F.struct(F.left(s["x"], F.length(s["x"]) - s["e"]).alias("x"), F.left(s["y"], F.length(s["y"]) - s["e"]).alias("y"), s["allowed"].alias("allowed")))
    steps = F.transform(steps, lambda s: F.struct(F.split(s["x"], "").alias("x"), F.split(s["y"], "").alias("y"), s["allowed"].alias("allowed"), F.least(F.length(s["x"]), F.length(s["y"])).alias("least"), F.greatest(F.length(s["x"]), F.length(s["y"])).alias("most")))
    near = F.exists(steps, lambda s: F.when(s["least"] == 0, s["most"] <= s["allowed"]).when(s["most"] - s["least"] > s["allowed"], False).otherwise(within(s["x"], s["y"], s["allowed"], radius)))
    return both.where(near).select("a", "b")


def _few(df: DataFrame) -> DataFrame:
    """Broadcast up to ``BROADCAST_ROWS`` rows of some longs; more are shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def met_in_groups(members: DataFrame, texts: DataFrame, radius: int, chars_per_edit: int) -> tuple[DataFrame, DataFrame]:
    """Links between each group's most frequent line and those near it, and the pairs (a, b) that this leaves open.

    ``members`` has key, node, letters, n, copies and own; at least one line of a pair has the key as its own. Lines near
    the same line are in one class already, so that only pairs of which one isn't near it are still to be compared.
    """
    some = cut(members.groupBy("key", "node", "letters", "n", "copies").agg(F.max("own").alias("own")))
    centre = F.max_by(F.struct("node", "letters", "n"), F.struct("copies", -F.col("node")))
    centres = some.where("own").groupBy("key").agg(centre.alias("x"))
    around = cut(some.alias("y").join(centres.alias("c"), "key").where("y.node != c.x.node").select("key", "y.node", "y.letters", "y.n", "y.own", F.col("x.node").alias("centre"), (~_apart("x", "y", radius)).alias("maybe")))
    ends = (F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b"))
    close = cut(verified(around.where("maybe").select(*ends).distinct(), texts, radius, chars_per_edit))
    judged = around.select("key", "node", "letters", "n", "own", *ends).join(_few(close.withColumn("near", F.lit(True))), ["a", "b"], "left").drop("a", "b").withColumn("near", F.col("near").isNotNull())
    left = judged.groupBy("key").agg(F.count("*").alias("c"), F.min("near").alias("all")).where("c > 1 and not all").select("key")
    left = judged.join(left, "key", "left_semi")
    parities = texts.join(_few(cut(left.select("node").distinct())), "node", "left_semi").select("node", pair_parities(F.col("line")).alias("parities"))
    left = cut(left.join(parities, "node"))
    on = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") != F.col("y.node")) & (~F.col("y.own") | (F.col("x.node") < F.col("y.node"))) & ~(F.col("x.near") & F.col("y.near")) & ~_apart("x", "y", radius) & (parities_apart(F.col("x.parities"), F.col("y.parities")) <= 4 * radius)
    met = left.where("own").alias("x").join(left.alias("y"), on)
    return close, cut(met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())


def near_edges(lines: DataFrame, radius: int, chars_per_edit: int) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) between different lines that are within their allowed edits, and the nodes (node, k, k2) they speak of."""
    long = lines.where(F.col("n") >= chars_per_edit).withColumn("tag", F.lit(0).cast("long"))
    edits = lambda n: F.least(F.lit(radius), F.call_function("div", n, F.lit(chars_per_edit))).cast("int")
    counts = segment_keys(long, radius, edits, "k").groupBy("key").agg(F.max("own").alias("own"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    open_keys = cut(counts.where("own and lo != hi").select("key"))
    members = segment_keys(long, radius, edits, "k", "k2", "n").join(_few(open_keys), "key", "left_semi")
    members = cut(members.groupBy("key", "k", "k2", "n", "at", "size").agg(F.max("own").alias("own")))
    wanted = cut(members.select("k", "k2").distinct())
    texts = long.join(_few(wanted), ["k", "k2"], "left_semi").groupBy("k", "k2").agg(F.min("line").alias("line"), F.count("*").alias("copies"))
    texts = cut(texts.withColumn("node", F.monotonically_increasing_id()).withColumn("letters", letter_counts(F.col("line"))))
    state = cut(members.join(texts.select("k", "k2", "node", "letters", "copies"), ["k", "k2"]).select("key", "node", "letters", "copies", "n", "own", "at", "size", edits(F.col("n")).alias("r")))
    pairs, links = [], []
    for level in range(LEVELS + 1):
        groups = state.groupBy("key").agg(F.count("*").alias("c"), F.max("own").alias("own")).where("c > 1 and own")
        cold, hot = groups.where(F.col("c") <= HOT).select("key"), cut(groups.where(F.col("c") > HOT).select("key"))
        close, met = met_in_groups(state.join(cold, "key", "left_semi"), texts, radius, chars_per_edit)
        links.append(close)
        pairs.append(met)
        if hot.isEmpty():
            break
        inside = state.join(hot, "key", "left_semi")
        if not level:  # what is left of a line in a group: at first all of it
            inside = inside.join(texts.select("node", F.col("line").alias("rest")), "node")
        inside = cut(inside.select("key", "node", "letters", "copies", "n", "r", F.concat(F.left("rest", F.col("at") - 1), F.substring("rest", F.col("at") + F.col("size"), F.length("rest"))).alias("rest")))
        firsts = inside.groupBy("key").agg(F.min("rest").alias("first"))
        ends = inside.join(firsts, "key").groupBy("key").agg(F.min(common_start(F.col("rest"), F.col("first"))).alias("p"), F.min(common_start(F.reverse("rest"), F.reverse("first"))).alias("e"), F.min(F.length("rest")).alias("least"), F.max(F.length("rest")).alias("most"), F.min("r").alias("edits"))
        ends = ends.select("key", "p", F.least(F.col("e"), F.col("least") - F.col("p")).alias("e"), "most", F.col("edits").alias("r"))
        inside = inside.drop("r").join(ends, "key").withColumn("bare", F.length("rest") - F.col("p") - F.col("e"))
        inside = cut(inside.withColumn("done", (F.col("most") - F.col("p") - F.col("e") < 2 * (F.col("r") + 1)) | F.lit(level == LEVELS)).withColumn("rest", F.substring("rest", F.col("p") + 1, F.col("bare"))))
        # Groups that end here.
        close, met = met_in_groups(inside.where("done").withColumn("own", F.lit(True)), texts, radius, chars_per_edit)
        links.append(close)
        pairs.append(met)
        # The others are cut into segments again, within their group.
        again = inside.where("not done").select(F.col("rest").alias("line"), F.col("bare").alias("n"), F.col("key").alias("tag"), "node", "letters", "copies", F.col("n").alias("whole"), "r", F.col("rest").alias("kept"))
        cuts = segment_keys(again, radius, lambda _: F.col("r"), "node", "letters", "copies", "whole", "r", "kept")
        same = ("key", "node", "letters", "copies", "whole", "at", "size", "r", "kept")
        state = cut(cuts.groupBy(*same).agg(F.max("own").alias("own")).withColumnsRenamed({"whole": "n", "kept": "rest"}))
    every = pairs[0]
    for more in pairs[1:]:
        every = every.unionByName(more)
    edges = verified(every.distinct(), texts, radius, chars_per_edit)
    for more in links:
        edges = edges.unionByName(more)
    return edges, texts.select("node", "k", "k2")


def remove_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, chars_per_edit: int = 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near, kept_text, and the columns to ``carry``, for every row.

    n_lines counts lines that aren't blank, n_near those removed for a line that isn't equal.
    """
    if not 1 <= radius <= 4:
        raise ValueError("the radius must be 1 to 4")
    lines = _lines(docs, id_col, text_col)
    place = F.struct("doc_id", "t", "no")
    exact = cut(lines.groupBy("k", "k2").agg(F.min(place).alias("first"), F.count("*").alias("c")))
    edges, nodes = near_edges(lines, radius, chars_per_edit)
    moved = cut(components(edges))
    # First place of every class that has more than one line.
    roots = moved.select(F.col("root").alias("node")).distinct()
    classes = moved.unionByName(roots.select("node", F.col("node").alias("root"))).join(nodes, "node").join(exact, ["k", "k2"])
    heads = classes.join(classes.groupBy("root").agg(F.min("first").alias("head")), "root").select("k", "k2", "head")
    named = exact.join(heads, ["k", "k2"], "left")
    repeated = named.where("c > 1 or head != first").select("k", "k2", "first", F.coalesce("head", "first").alias("head"))
    gone = lines.select("doc_id", "t", "no", "k", "k2").join(repeated, ["k", "k2"]).where(~place.eqNullSafe(F.col("head")))
    # Rows with equal id and text repeat each other's lines: a line is listed once.
    listed = gone.groupBy("doc_id", "t").agg(F.collect_set(F.struct("no", (F.col("first.doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("first.t") == F.col("head.t")) & (F.col("first.no") == F.col("head.no"))).alias("exact"))).alias("gone"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carry).withColumn("t", F.xxhash64("text"))
    joined = rows.alias("r").join(listed.alias("l"), (F.col("r.doc_id").eqNullSafe(F.col("l.doc_id"))) & (F.col("r.t") == F.col("l.t")), "left").select("r.doc_id", "r.text", "l.gone", *(f"r.{c}" for c in carry))
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    numbers = F.transform("gone", lambda g: g["no"])
    kept = F.filter(split, lambda x, i: ~F.array_contains(F.col("numbers"), i))
    out = joined.withColumn("numbers", numbers)
    text = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return out.select(
        "doc_id",
        F.size(F.filter(split, lambda x: x.rlike(r"\S"))).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size(F.filter("gone", lambda g: ~g["exact"]))).cast("long").alias("n_near"),
        text.alias("kept_text"),
        *carry,
    )
