"""Different texts of one word set are paired completely, however many there are."""

import random

import pytest

from skylattice.llm import neardup


@pytest.mark.parametrize("cap", [3, 5000])
def test_reordered_texts_are_no_copies(spark, cap):
    rng, words = random.Random(3), "one two three four five six seven".split()
    records = {f"k{i:02d}": " ".join(rng.sample(words, 7)) for i in range(14)} | {f"z{i}": "Seven six, five four three two one" for i in range(7)}
    got = [tuple(r) for r in neardup.similar_pairs(spark.createDataFrame(list(records.items()), "key string, text string"), cap=cap, copies=5).collect()]
    keys = sorted(records)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if records[a] != records[b]} | {("z0", f"z{i}") for i in range(1, 7)}
    assert len(got) == len(set(got)) and set(got) == want
