import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.llm import neardup

WORDS = [f"w{i}" for i in range(300)]


def texts(seed, n=120, edits=60):
    """Unrelated texts, small edits of them, and copies."""
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        out[f"a{i}"] = " ".join(rng.choices(WORDS, k=rng.randint(1, 30)))
    for i in range(edits):
        w = out[f"a{rng.randrange(n)}"].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rng.shuffle(w)
        out[f"b{i}"] = " ".join(w).upper() + "!"
    return out


def brute(records, t=Fraction(7, 10)):
    sets = {k: frozenset(__import__("re").findall("[a-z0-9]+", v.lower())) for k, v in records.items() if k is not None and v is not None}
    keys = sorted(k for k in sets if sets[k])
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def pairs(spark, records, **kw):
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in records.items()], "key string, text string, cid string, a int")
    return {tuple(r) for r in neardup.similar_pairs(df, **kw).collect()}


@pytest.mark.parametrize("cap", [2, 10, 5000])
def test_equals_brute_force(spark, cap):
    records = texts(cap)
    records |= {"n1": None, "n2": "", "n3": "...", None: "w1 w2"}
    assert pairs(spark, records, cap=cap) == brute(records)


@pytest.mark.parametrize("t", [Fraction(1, 2), Fraction(17, 20), Fraction(1)])
def test_other_thresholds(spark, t):
    records = texts(5, 60, 40)
    assert pairs(spark, records, threshold=t) == brute(records, t)


def test_many_edits_of_one_text_go_through_voronoi_regions(spark):
    """All words are frequent and all texts share most of them, so only pivots can divide the region."""
    rng = random.Random(1)
    base = [WORDS[:25], WORDS[100:125]]
    records = {}
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(WORDS[200:206])
        records[f"r{i}"] = " ".join(w)
    assert pairs(spark, records, cap=20) == brute(records)


def test_voronoi_keeps_every_near_pair(spark):
    rng = np.random.default_rng(4)
    sets = [sorted(rng.choice(60, size=20, replace=False).tolist()) for _ in range(4)]
    docs = []
    for i in range(200):
        s = set(sets[i % 4])
        for _ in range(int(rng.integers(0, 5))):
            s.discard(int(rng.choice(sorted(s))))
            s.add(int(rng.integers(0, 60)))
        docs.append((f"c{i:03d}", [f"w{x}" for x in sorted(s)]))
    words = spark.createDataFrame(docs, "cid string, words array<string>")
    rows = words.select(F.lit(1).cast("bigint").alias("region"), "cid", F.lit(True).alias("probe"), F.lit(True).alias("index"), F.size("words").alias("size"), F.lit(0).cast("bigint").alias("s0"), F.lit(0).cast("bigint").alias("s1"))
    got = neardup.voronoi(rows, words, 0.3, cap=25).select("region", "cid").collect()
    together = {}
    for r in got:
        together.setdefault(r.region, set()).add(r.cid)
    assert len(together) > 1
    by = {c: set(w) for c, w in docs}
    for i, (a, _) in enumerate(docs):
        for b, _ in docs[i + 1 :]:
            if len(by[a] & by[b]) >= 0.7 * len(by[a] | by[b]):
                assert any(a in m and b in m for m in together.values())


def test_copies_beyond_the_bound_form_a_star(spark):
    records = {f"k{i}": "one two three four five six seven" for i in range(12)} | {"z": "one two three four five six eight"}
    got = pairs(spark, records, copies=5)
    assert {p for p in got if "z" in p} == {(f"k{i}", "z") for i in range(12)}
    assert {p for p in got if "z" not in p} == {("k0", f"k{i}") for i in range(1, 12)}


def test_records_and_classes(spark):
    e = spark.createDataFrame([("x", "Follow the red van"), ("x", "Follow the red van"), ("y", None)], "episode_id string, instruction string")
    f = spark.createDataFrame([(1, ["follow the red VAN", None, "other words here"]), (1, ["follow the red VAN", None, "other words here"]), (2, None), (3, [])], "result_id long, kept array<string>")
    rec = neardup.instruction_records(e, f)
    assert {r.key for r in rec.collect()} == {"e:x", "k:1:0", "k:1:2"}
    got = {r.key: (r.copies, r.links) for r in neardup.record_classes(rec).collect()}
    assert got == {"e:x": (2, 0), "k:1:0": (2, 0), "k:1:2": (1, 0)}


def test_empty(spark):
    assert neardup.similar_pairs(spark.createDataFrame([], "key string, text string")).count() == 0


@pytest.mark.parametrize("t", [Fraction(1, 2), Fraction(2, 3), Fraction(7, 10)])
@pytest.mark.parametrize("sizes", [(1, 6), (28, 40)])
def test_when_all_words_are_frequent(spark, t, sizes):
    """No word forms a rare region: short, middling and long texts meet by other ways."""
    rng = random.Random(9)
    pool = WORDS[: 2 * sizes[1]]
    records = {f"k{i}": " ".join(rng.sample(pool, rng.randint(*sizes))) for i in range(80)}
    for i in range(60):
        w = records[f"k{i}"].split()
        for _ in range(rng.randint(0, len(w) // 4 + 1)):
            w[rng.randrange(len(w))] = rng.choice(pool)
        records[f"e{i}"] = " ".join(w)
    assert pairs(spark, records, threshold=t, cap=1) == brute(records, t)


def test_cells_keep_every_pair_once(monkeypatch):
    """Pivots inside a task: every similar pair meets in exactly one cell, and cells are smaller than the region."""
    monkeypatch.setattr(neardup, "LEAF", 8)
    rng = np.random.default_rng(2)
    centres = [rng.choice(500, size=20, replace=False) for _ in range(12)]
    sets = []
    for i in range(300):
        s = set(centres[i % 12].tolist())
        for _ in range(int(rng.integers(0, 4))):
            s.discard(int(rng.choice(sorted(s))))
            s.add(int(rng.integers(0, 500)))
        sets.append(s)
    flat = np.array([x * 2654435761 % 2**61 for s in sets for x in sorted(s)], dtype=np.uint64)
    t, every = Fraction(7, 10), np.ones(300, dtype=bool)
    have = neardup.Sets(flat, np.array([len(s) for s in sets]), every, every, t)
    cells = list(neardup.voronoi_cells(have, np.arange(300), np.zeros(300, dtype=np.int64)))
    assert max(len(c[0]) for c in cells) < 150
    met = []
    for rows, outside, _ in cells:
        met += [(min(a, b), max(a, b)) for x, a in enumerate(rows) for y, b in enumerate(rows[:x]) if not outside[x] & outside[y]]
    near = {(i, j) for i in range(300) for j in range(i + 1, 300) if len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])}
    assert len(met) == len(set(met)) and near <= set(met) and len(met) < 300 * 299 / 4


def test_two_large_groups_of_copies_are_linked_once(spark):
    records = {f"k{i}": "one two three four five six seven" for i in range(7)} | {f"z{i}": "one two three four five six eight" for i in range(8)}
    got = pairs(spark, records, copies=5)
    assert {p for p in got if p[0][0] != p[1][0]} == {("k0", "z0")} and len(got) == 1 + 6 + 7
