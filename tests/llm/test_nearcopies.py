"""Near copies against brute force over all pairs of shingle sets."""

import random

import numpy as np

from redquill.llm import nearcopies as nc


def brute(rows, similarity=0.8):
    sets = {i: set(nc.shingle_set(nc.word_bytes(t), 5).tolist()) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and (len(a & b) >= similarity * len(a | b) if a | b else True):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def made(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, n = [], 0
    for _ in range(60):
        words = [r.choice(vocabulary) for _ in range(r.choice([4, 9, 40, 200, 1500]))]
        for share in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.06):
            copy = [r.choice(vocabulary) if r.random() < share else w for w in words]
            rows.append((n, "  ".join(copy).upper() if r.random() < 0.2 else " ".join(copy)))
            n += 1
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \t ")]


def test_components_match_brute_force(spark):
    rows = made()
    got = {r.doc_id: r.component_id for r in nc.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got == want
    assert len(set(want.values())) < len(rows) / 2


def test_a_hot_group_spans_blocks(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{r.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(700):
        copy = list(words)
        copy[r.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    got = nc.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 700 and {x.component_id for x in got} == {0}


def test_partners_around_the_similarity_are_not_lost(spark):
    """Groups whose pairs lie on both sides of 0.8: a nearer pair under 0.8 mustn't hide one that passes."""
    r = random.Random(7)
    rows = []
    for _ in range(40):
        words = [f"w{r.randrange(10**6)}" for _ in range(254)]
        for _ in range(12):
            copy = list(words)
            for at in r.sample(range(254), r.choice([2, 3, 3, 3])):
                copy[at] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    got = {x.doc_id: x.component_id for x in nc.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: c for at in range(0, len(rows), 12) for i, c in brute(rows[at : at + 12]).items()}
    assert got == want
    assert 40 < len(set(want.values())) < 480


def test_no_rows_null_ids_and_repeated_rows(spark):
    schema = "doc_id long, text string, cls string, fp int"
    assert nc.near_copies(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b", "x", 1), (4, "a b", "x", 1), (4, "a b", "x", 1), (4, "c d", None, None)]
    df = spark.createDataFrame(rows, schema)
    got = sorted(((r.doc_id, r.component_id) for r in nc.near_copies(df).collect()), key=str)
    assert got == [(4, 4), (4, 4), (4, 4), (None, 4)]
    kept = sorted((r.doc_id, r.text, r.cls) for r in nc.one_of_each(df.drop("fp")).collect())
    assert kept == [(4, "a b", "x"), (4, "c d", None)]


def test_rows_that_share_an_id_are_told_apart(spark):
    other = "totally other words than those before and after it"
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, other), (None, "A  b c d e f"), (None, "one null id"), (None, "one NULL id"), (None, "another null id")]
    kept = sorted(((r.doc_id, r.text) for r in nc.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert kept[:3] == [(1, "a b c d e f"), (2, other), (None, "another null id")] and len(kept) == 4 and kept[3][1].lower() == "one null id"


def test_keys_and_radius_follow_from_the_similarity():
    assert nc.band_rows(0.8) == 5 and nc.radius_of(0.8) == 136
    assert nc.band_rows(0.5) == 1 and nc.radius_of(0.95) < 136 < nc.radius_of(0.5)
    r = np.random.default_rng(8)
    for n in (5, 6, 16, 40):  # just similar sets lie within the radius
        for _ in range(300):
            x = r.integers(0, 1 << 63, n, dtype=np.uint64)
            y = x[: -(n // 5)]
            assert nc.distances(nc.wide_fingerprint(x)[None], nc.wide_fingerprint(y)[None], nc.radius_of(0.8))[0] >= 0


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, (1000, nc.WIDTH), dtype=np.uint64)
    y = np.where(rng.random((1000, nc.WIDTH)) < 0.7, x, rng.integers(0, 1 << 63, (1000, nc.WIDTH), dtype=np.uint64))
    y[::7] = rng.integers(0, 1 << 63, y[::7].shape, dtype=np.uint64)
    true = np.bitwise_count(x ^ y).sum(axis=1).astype(int)
    assert (nc.distances(x, y, 100) == np.where(true <= 100, true, -1)).all()
