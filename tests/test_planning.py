import math
import random

import numpy as np
import pytest

from skylattice.operators import kinematics, occupancy, planning, viewpoints

FRAMES = "episode_id string, frame_idx int, timestamp_s double, target_x double, target_y double, line_of_sight_clear boolean, x double"


def track(seed, episodes=3, n=80):
    rng = random.Random(seed)
    out = []
    for e in range(episodes):
        x = y = t = 0.0
        for i in range(n):
            x, y, t = x + rng.uniform(-1, 2), y + rng.uniform(-2, 1), t + rng.uniform(0, 0.4)
            if rng.random() < 0.95:
                out.append((f"e{e}", i * (1 + i % 2), t, x, y, rng.random() < 0.8, rng.uniform(0, 50)))
    return list({(r[0], r[1]): r for r in out}.values())


@pytest.mark.parametrize("block", [5, 4096])
def test_plan_equals_the_fold(spark, block):
    rng = np.random.default_rng(3)
    data = [(r[0], r[1], r[3], r[4], bytes(rng.choice([5, 4, 9, 28, 41, 101], size=108).astype(np.uint8))) for r in track(1)]
    got = {(r.episode_id, r.frame_idx): r.candidate for r in viewpoints.planned(spark.createDataFrame(data, "episode_id string, frame_idx int, x double, y double, judgements binary"), block).collect()}
    places = [(12 * r * math.cos(a), -12 * r * math.sin(a), 18 * h) for a in (-math.pi + 2 * math.pi * i / 12 for i in range(12)) for r in (0.8, 1.0, 1.2) for h in (0.85, 1.0, 1.15)]
    yaw = [math.atan2(-p[1], -p[0]) for p in places]
    for e in {r[0] for r in data}:
        state, last = None, None
        for _, i, x, y, code in sorted(r for r in data if r[0] == e):
            scores = []
            for n, p in enumerate(places):
                seen, hidden, hit = code[n] % 6, code[n] // 6 % 6, code[n] // 36
                score = seen / 5 - 0.8 * hidden / 5 - 0.3 * abs(math.hypot(p[0], p[1]) - 12) / 12 - (0.0, 0.7, 1.0)[hit]
                if state is not None:
                    q = places[state]
                    way = math.dist((x + p[0], y + p[1], p[2]), (last[0] + q[0], last[1] + q[1], q[2]))
                    turn = abs((yaw[n] - yaw[state] + math.pi) % (2 * math.pi) - math.pi)
                    score -= 0.2 * (0.7 * min(1, way / 12) + 0.3 * turn / math.pi)
                scores.append(round(score, 9))
            best = scores.index(max(scores))
            if scores[got[e, i]] < scores[best] - 1e-8:
                assert got[e, i] == best
            state, last = got[e, i], (x, y)


def test_candidates_behind_a_wall_are_not_chosen(spark):
    """A wall stands on one side: candidates behind it don't see the target, and none of them is best."""
    g = occupancy.Grid(voxel=4.0)
    wall = [(2, j, k) for j in range(-6, 7) for k in range(0, 8)]
    voxels = spark.createDataFrame(wall, "ix int, iy int, iz int")
    flags = spark.createDataFrame([(2, j, 32.0, 0.0, True) for j in range(-6, 7)], "ix int, iy int, roof_z double, ground_z double, blocks boolean")
    f = spark.createDataFrame([("e", i, 0.0, float(i) / 10, -0.5) for i in range(7)] + [("n", 0, None, 1.0, 0.0), ("n", 1, float("nan"), 1.0, 0.0)], "episode_id string, frame_idx int, target_x double, target_y double, target_z double")
    found = viewpoints.judged(f, voxels, flags, g)
    rows = {r.frame_idx: np.frombuffer(r.judgements, dtype=np.uint8) for r in found.collect()}
    assert set(rows) == set(range(7))
    behind = np.flatnonzero(viewpoints.PLACES[:, 0] > 12.0 * 0.9)
    assert all((rows[i][behind] // 6 % 6 == 5).all() for i in rows)
    clear = np.flatnonzero(viewpoints.PLACES[:, 0] < 0)
    assert all((rows[i][clear] % 6 == 5).all() and (rows[i][clear] // 6 == 0).all() for i in rows)
    assert {r.candidate for r in viewpoints.best(found).collect()} & set(behind.tolist()) == set()
    assert viewpoints.best(viewpoints.judged(f.limit(0), voxels, flags, g)).count() == 0


def test_smoothing_equals_the_fold(spark, monkeypatch):
    import skylattice.session

    monkeypatch.setattr(skylattice.session, "BLOCK", 7)
    data = track(2)
    got = {(r.episode_id, r.frame_idx): r.smoothed for r in kinematics.smoothed(spark.createDataFrame(data, FRAMES), "x", 0.5).collect()}
    for e in {r[0] for r in data}:
        value = before = None
        for _, i, t, *_, x in sorted(r for r in data if r[0] == e):
            value = x if value is None else value + min(1.0, max(0.0, (t - before) / 0.5)) * (x - value)
            before = t
            assert math.isclose(got[e, i], value, rel_tol=1e-9)


def test_lift(spark):
    g = occupancy.Grid(voxel=1.0)
    points = spark.createDataFrame([(1, 0.5, 0.5, 0.5), (2, 9.5, 9.5, 0.5), (3, 20.5, 0.5, 0.5)], "point_id long, x double, y double, z double")
    taken = spark.createDataFrame([(0, 0, 0), (1, 0, 1), (10, 9, 0)] + [(20, 0, z) for z in range(6)], "ix int, iy int, iz int")
    assert {r.point_id: r.lift for r in planning.lifted(points, taken, g).collect()} == {1: 2, 2: 1, 3: None}


def test_evaluation_without_yaw_or_record(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("e", 0, 0.0, 0.0, None, 10.0, 0.0, None, None, True, None), ("e", 1, 0.0, 0.0, 0.0, 10.0, 0.0, None, None, None, False), ("e", 2, 0.0, 0.0, 0.0, 10.0, 0.0, None, None, True, False)], "episode_id string, frame_idx int, uav_x double, uav_y double, uav_yaw double, target_x double, target_y double, drone_bearing_to_target_rad double, in_camera_frustum boolean, target_visible boolean, line_of_sight_clear boolean")
    a, b, c = planning.evaluated(df, F.lit(math.pi / 2)).orderBy("frame_idx").collect()
    assert (a.visible, a.in_frustum, a.los_clear, a.score) == (True, None, None, 1.0)
    assert (b.visible, b.in_frustum, b.source) == (False, True, "derived+geometry+los")
    assert (c.visible, c.los_clear) == (True, False)
