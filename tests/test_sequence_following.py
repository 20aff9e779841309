import random

import pytest

from pyspark.sql import functions as F

from skylattice.operators.sequence import following


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_following_values_across_chunks(spark, block):
    rng = random.Random(block)
    rows = [(f"e{e}", i, None if rng.random() < 0.2 else i * 10, "x") for e in range(4) for i in sorted(rng.sample(range(40), rng.randint(1, 20)))]
    df = spark.createDataFrame(rows, "episode_id string, frame_idx int, v int, chunk string").repartition(5)
    got = {(r.episode_id, r.frame_idx): r.ahead for r in following(df, "episode_id", "frame_idx", F.col("v"), 4, "ahead", block).collect()}
    for e in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == e)
        for k, r in enumerate(own):
            assert got[e, r[1]] == [x[2] for x in own[k + 1 : k + 5]]
    assert following(df.limit(0), "episode_id", "frame_idx", F.col("v"), 4, "ahead").count() == 0
