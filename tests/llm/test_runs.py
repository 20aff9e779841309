import random

import pytest
from pyspark.sql import functions as F

from skylattice.llm import runs

SCHEMA = "record_id long, episode_id string, frame_idx int, timestamp_s double, tracker_mode string, target_visible boolean, entity string, state string"


def brute(data, gap=1.0):
    seqs = {}
    for _, e, i, t, m, v, *_ in data:
        if e is not None and i is not None:
            mode = "".join(c for c in (m or "").lower() if "a" <= c <= "z")
            seqs.setdefault(e, {}).setdefault(i, (t, mode, v))
    out = set()
    for e, by in seqs.items():
        run = None
        for i in sorted(by):
            t, m, v = by[i]
            if run and run[3:5] == [m, v] and t is not None and run[5] is not None and t - run[5] <= gap:
                run[1], run[2], run[5] = i, run[2] + 1, t
            else:
                if run:
                    out.add((e, *run[:3], run[3], run[4]))
                run = [i, i, 1, m, v, t]
        out.add((e, *run[:3], run[3], run[4]))
    return out


@pytest.mark.parametrize("block", [2, 7, 4096])
def test_equals_brute_force(spark, block):
    rng = random.Random(block)
    data, rid = [], 0
    for e in ["a", "b", "c", ""]:
        t, mode, vis, i = 0.0, "track", True, -3
        for _ in range(300 if e == "a" else 60):
            i += 1 if rng.random() < 0.9 else rng.randint(2, 30)
            t += 0.1 if rng.random() < 0.95 else 3.0
            if rng.random() < 0.2:
                mode = rng.choice(["track", "Track ", "[peek]", None, "", "..", "peek", "PEEK;"])
            if rng.random() < 0.1:
                vis = rng.choice([True, False, None])
            row = (e, i, None if rng.random() < 0.02 else t, mode, vis, "x", "y")
            for _ in range(1 + (rng.random() < 0.1)):
                data.append((rid, *row))
                rid += 1
    rng.shuffle(data)
    data += [(rid, None, 1, 0.0, "track", True, "x", "y"), (rid + 1, "a", None, 0.0, "track", True, "x", "y")]
    got = runs.tracker_runs(spark.createDataFrame(data, SCHEMA).repartition(3), block=block)
    assert {(r.episode_id, r.first_frame_idx, r.last_frame_idx, r.frames, r.tracker_mode, r.target_visible) for r in got.collect()} == brute(data)


def test_empty_table(spark):
    assert runs.tracker_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_durations_and_any_columns(spark):
    df = spark.createDataFrame([("x", k, float(k), s) for k, s in enumerate("aabbb")], "who string, n int, at double, s string")
    got = runs.collapse_runs(df, "who", "n", "at", [F.col("s")]).collect()
    assert sorted((r.first_key, r.events, r.duration) for r in got) == [(0, 2, 1.0), (2, 3, 2.0)]


def test_one_entity_with_most_rows(spark):
    df = spark.range(60_000).selectExpr("id as record_id", "if(id % 3 > 0, 'hot', concat('e', id)) as episode_id", "cast(id as int) as frame_idx", "id * 0.1 as timestamp_s", "if(id % 9000 < 4500, 'track', 'peek') as tracker_mode", "true as target_visible")
    got = runs.tracker_runs(df).where("episode_id = 'hot'").collect()
    assert len(got) == 14 and sum(r.frames for r in got) == 40_000
