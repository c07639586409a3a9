"""What large tables ask of line dedup, of components and of the driver."""

import re
import time

from pyspark.sql import functions as F

from redquill.llm import linededup, secrets
from redquill.llm.components import LEAST_TASKS, components
from redquill.llm.runtime import cut, release, trim


def test_few_edges_take_few_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = components(spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 10 != 9], "a long, b long"))
        assert {r.node: r.root for r in found.collect()} == {i: i // 10 * 10 for i in range(40) if i % 10}
        assert found.rdd.getNumPartitions() <= LEAST_TASKS
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_keys_are_those_of_every_spec(spark):
    lines = ["x" * n + c + "y" * n for n in range(0, 40, 3) for c in ("ab", "éa", "中文字")]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "id int, line string").withColumn("n", F.length("line")).withColumn("tag", F.lit(7).cast("long"))
    edits = lambda n: F.least(F.lit(2), F.call_function("div", n, F.lit(16))).cast("int")
    keys = linededup.segment_keys(rows, 2, edits, "id")
    cuts = []
    for i, t in enumerate(lines):
        for r, less, k, shift, own in linededup._specs(2):
            n = len(t) - less
            if n > r and min(2, n // 16) == r:
                size, short = n // (r + 1), r + 1 - n % (r + 1)
                at = k * size + max(k - short, 0) + 1 + shift
                size += k >= short
                cuts.append((i, n, r, k, t[at - 1 : at - 1 + size], own, at, size))
    want = spark.createDataFrame(cuts, "id int, n int, r int, i int, part string, own boolean, at int, size int").select(F.xxhash64(F.lit(7).cast("long"), "n", "r", "i", "part").alias("key"), "own", "at", "size", "id")
    assert sorted(map(tuple, keys.collect())) == sorted(map(tuple, want.collect()))
    # Lines of two edits and more are only multiplied by the specs of two edits.
    assert "CASE WHEN" in keys._jdf.queryExecution().analyzed().toString().split("Generate")[1]


def test_cuts_free_the_shuffles_before_them(spark):
    known = lambda: spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()
    release(spark)
    time.sleep(2)  # Spark's cleaner works behind the program
    before, rows = known(), spark.range(100)
    for k in range(1, 9):
        rows = cut(rows.groupBy((F.col("id") % (100 - k)).alias("id")).count().select("id"))
    for _ in range(20):
        if known() - before <= 5:
            break
        time.sleep(0.5)
    assert known() - before <= 5 and rows.count() == 92


def test_windows_are_scored_by_compiled_code(spark):
    # No lambda, which is interpreted, and no method above 8000 bytes, which HotSpot doesn't compile.
    texts = spark.createDataFrame([("a" * 64,), ("ab" * 50 + "Zz9" * 30,), ("Q7x/+" * 13 + " or so",), ("x",)], "text string")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan has no code before it runs
    try:
        for c in (0, 8, 20, *range(24, 28)):
            plan = secrets.ordinary(texts, [c]).groupBy("x").count()._jdf.queryExecution().explainString(mode)
            assert "lambdafunction" not in plan
            assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", plan))) <= 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # The same bins as those of runs, also where one symbol fills a window.
    symbols, n = secrets.ENCODINGS[5][1], secrets.LENGTHS[3]
    cuts = [("a" * 64,), (("ab" * 50 + "ZzZz")[:64],), ("Az" * 32,), ("A" * 32 + "z" * 32,), ("z" * 63 + "A",), (symbols + symbols[:12],)]
    spaced = spark.createDataFrame([(" ".join(x[i : i + 8] for i in range(0, n, 8)),) for (x,) in cuts], "text string")
    want = spark.createDataFrame(cuts, "w string").select((23 * secrets.BINS + secrets.score(F.col("w"), F.lit(symbols))).alias("x"))
    assert sorted(r.x for r in secrets.ordinary(spaced, [23]).collect()) == sorted(r.x for r in want.collect())


def test_native_memory_is_given_back(spark):
    assert "Trim native heap" in trim(spark)
