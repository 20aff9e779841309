"""Implausible readings against a plain brute-force version, at block sizes that cut sequences in many places."""

import math

import numpy as np
import pytest

from skylattice.operators import spikes

SCHEMA = "record_id long, episode_id string, frame_idx int, drone_distance_m double, target_velocity array<double>, target_pose_world struct<x:double,y:double,z:double,yaw:double>, usual string, chunk int"


def rows(seed: int, episodes=6, frames=150):
    rng = np.random.default_rng(seed)
    out, rid = [], 0
    for e in range(episodes):
        d, p = 40.0, np.array([100.0, -50.0, -0.3])
        n = frames if e else frames * 4
        spike = set()
        for i in rng.choice(np.arange(5, n - 8), size=max(1, n // 40), replace=False):
            spike |= set(range(i, i + int(rng.integers(1, 4))))
        for i in range(n):
            d += rng.normal() * 0.3
            p = p + rng.normal(size=3) * [0.4, 0.4, 0.01]
            dist = d + (40 if i in spike else 0)
            if rng.random() < 0.02:
                dist = float(rng.choice([math.nan, math.inf, -1.0, 1e9]))
            if 60 <= i < 75 and e % 2:
                dist = 33.0
            vel = [0.0, 0.0, 0.0] if 90 <= i < 110 and e == 2 else [float(x) for x in rng.normal(size=3)]
            pose = dict(x=float(p[0]), y=float(p[1]), z=float(p[2]), yaw=0.1)
            if 90 <= i < 110 and e in (2, 3):
                pose = dict(x=1.0, y=2.0, z=3.0, yaw=0.0)
            if rng.random() < 0.03:
                vel = None
            row = (rid, f"e{e}", i, None if rng.random() < 0.03 else dist, vel, None if rng.random() < 0.03 else pose, "x", 7)
            for _ in range(1 + (rng.random() < 0.05)):
                out.append((rid, *row[1:]))
                rid += 1
    rng.shuffle(out)
    return [tuple(v if not isinstance(v, np.generic) else v.item() for v in r) for r in out]


def brute(data):
    found = set()
    frames = {}
    for _, e, i, d, v, p, *_ in data:
        if e is not None and i is not None:
            frames.setdefault(e, {})[i] = (d, v, p)
    for e, by in frames.items():
        order = sorted(by)
        vel = {i: by[i][1] for i in order if by[i][1] is not None}
        pos = {i: (by[i][2]["x"], by[i][2]["y"], by[i][2]["z"]) for i in order if by[i][2] is not None}
        dist = {i: (by[i][0],) for i in order if by[i][0] is not None}
        for f, series in enumerate((dist, vel, pos)):
            at = list(series)
            x = [np.array(series[i], dtype=float) for i in at]
            name = spikes.FIELDS[f]
            gap = lambda a, b: float(spikes.distance(a[None], b[None])[0])
            for i, v in zip(at, x):
                limit = {1: 120, 2: 100_000}.get(f)
                if not np.isfinite(v).all() or (f == 0 and not 0 <= v[0] <= 10_000) or (limit and (abs(v) > limit).any()):
                    found.add((e, i, name))
            steps = [s for s in (gap(a, b) for a, b in zip(x[1:], x[:-1])) if s > 0 and math.isfinite(s)]
            if steps:
                lim = 20 * float(np.median(steps))
                for size in (1, 2, 3):
                    for s in range(1, len(x) - size):
                        if all(gap(x[s + k], x[s - 1]) >= lim and gap(x[s + k], x[s + size]) >= lim for k in range(size)):
                            found |= {(e, at[s + k], name) for k in range(size)}
            s = 0
            while s < len(x):
                t = s
                while t + 1 < len(x) and (x[t + 1] == x[s]).all():
                    t += 1
                if t - s + 1 >= 12:
                    inside = [i for i in order if at[s] <= i <= at[t]]
                    rest = all((np.array(vel[i]) == 0).all() for i in inside if i in vel) and len({pos[i] for i in inside if i in pos}) <= 1
                    if not rest:
                        found |= {(e, i, name) for i in at[s : t + 1]}
                s = t + 1
    return found


@pytest.mark.parametrize("block", [16, 64, 4096])
def test_equals_brute_force(spark, block):
    data = rows(block)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = {tuple(r)[:3] for r in spikes.implausible_readings(df, block=block).collect()}
    assert got == brute(data)


def test_null_keys_empty_table_and_repeats(spark):
    assert spikes.implausible_readings(spark.createDataFrame([], SCHEMA)).count() == 0
    data = [(1, None, 0, -5.0, None, None, None, None), (2, "a", None, -5.0, None, None, None, None), (3, "a", 0, -5.0, [1.0], None, None, None), (4, "a", 0, -5.0, [1.0], None, None, None)]
    got = [tuple(r) for r in spikes.implausible_readings(spark.createDataFrame(data, SCHEMA)).collect()]
    assert got == [("a", 0, "drone_distance_m", "impossible")]


def test_sparse_part_finds_all_spikes():
    rng = np.random.default_rng(3)
    for n, dim in ((12, 1), (40, 3), (333, 3), (900, 1)):
        x = np.cumsum(rng.normal(size=(n, dim)), axis=0) + 500
        for i in range(4, n - 4, 37):
            x[i : i + 1 + i % 3] += 60
        step = spikes.distance(x[1:], x[:-1])
        usual = np.array([np.median(step)])
        every = np.arange(n)
        true = every[spikes.confirmed(x, every, np.zeros(n, int), np.full(n, n), np.full(n, 20 * usual[0]), 3)]
        marked = spikes.candidates(x, np.ones(n, bool), np.array([0]), np.array([n]), usual)
        assert set(true) <= set(marked)


def test_usual_change_is_the_median():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 1000):
        v = rng.lognormal(size=n)
        got = spikes.median_of(*spikes.histogram(v))
        assert abs(got / np.median(v) - 1) < 2**-11
