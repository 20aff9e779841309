import random

import pytest
from pyspark.sql import functions as F

from skylattice.operators.sequence import annotate, runs


@pytest.mark.parametrize("block", [3, 4096])
def test_annotate_over_chunk_ends(spark, block):
    rng = random.Random(block)
    data = [(e, i, rng.choice([None, 1, 2, 5])) for e in "ab" for i in sorted(rng.sample(range(60), 25))]
    df = spark.createDataFrame(data, "e string, i int, v int")
    got = annotate(df, "e", "i", lag={"p": F.col("v")}, lead={"n": F.col("v")}, carry={"c": F.col("v")}, running={"s": F.col("v")}, block=block)
    by = {(r.e, r.i): r for r in got.collect()}
    for e in "ab":
        seq = [r for r in data if r[0] == e]
        last, total = None, 0
        for k, (_, i, v) in enumerate(seq):
            total += v or 0
            r = by[e, i]
            assert (r.p, r.n, r.c, r.s) == (seq[k - 1][2] if k else None, seq[k + 1][2] if k + 1 < len(seq) else None, last, total)
            last = v if v is not None else last


def test_runs(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([True, True, None, None, False, True])], "e string, i int, s boolean")
    got = sorted((r.run, r.s, r.length, r.first_order, r.last_order) for r in runs(df, "e", "i", "s").collect())
    assert got == [(1, True, 2, 0, 1), (2, None, 2, 2, 3), (3, False, 1, 4, 4), (4, True, 1, 5, 5)]
