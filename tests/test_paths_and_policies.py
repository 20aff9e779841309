import numpy as np

from skylattice.operators import kinematics, paths, policies


def test_straight_path():
    p = paths.smooth_path(np.array([[0, 0], [10, 0], [20, 0]]))
    assert abs(p["s"][-1] - 20) < 1e-6 and np.allclose(p["y"], 0) and np.allclose(p["curvature"], 0)
    assert p["speed"][0] == p["speed"][-1] == paths.LEAST and p["speed"].max() <= paths.TOP
    gain = np.diff(p["speed"] ** 2) / np.diff(p["s"]) / 2
    assert gain.max() <= paths.GAIN + 1e-6 and gain.min() >= -paths.BRAKE - 1e-6


def test_spline_passes_through_its_points():
    rng = np.random.default_rng(0)
    t = np.cumsum(rng.uniform(0.5, 2, 9))
    y = rng.normal(size=(9, 2))
    s = paths.natural_spline(t, y)
    assert np.allclose(s(t), y) and np.allclose(s(t[[0, -1]], 2), 0)
    mid = t[4] + np.array([-1e-6, 1e-6])
    for k in (0, 1, 2):
        assert np.allclose(*s(mid, k), atol=1e-4)


def test_routes_without_length(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 0.0, 0.0), ("b", 1, 0.0, 0.0), ("b", 2, 3.0, 4.0)], "route_id string, ord int, x double, y double")
    got = paths.smooth_routes(df).groupBy("route_id").max("s").collect()
    assert [(r[0], round(r[1], 6)) for r in got] == [("b", 5.0)]


def test_rollouts_repeat_by_seed(spark):
    specs = [(f"{p}{d}", p, d, 7, 0.0, 0.0, 0.0, 10.0, 0.0) for p in policies.POLICIES for d in ("easy", "hard")] + [("u", None, None, None, 0.0, 0.0, 0.0, 1.0, 0.0), ("n", "sharp_turn", "easy", 1, None, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(specs, "episode_id string, policy string, difficulty string, seed long, x double, y double, heading double, drone_x double, drone_y double")
    a, b = (sorted(map(tuple, policies.rollouts(df).collect())) for _ in range(2))
    assert a == b and len(a) == 13 * 60
    for r in a:
        level = "hard" if r[0].endswith("hard") else "easy" if r[0].endswith("easy") else "medium"
        assert r[5] <= policies.PRESETS[level]["speed"] * policies.TOP_SPEED + 1e-9


def test_altitude_stays_within_its_rates():
    z, f = -10.0, -10.0
    for _ in range(50):
        n, f = policies.next_altitude(z, f, -40.0, 0.2)
        assert -1.5 * 0.2 - 1e-9 <= n - z <= 2.0 * 0.2 + 1e-9
        z = n
    assert z < -20


def test_thinning(spark):
    df = spark.createDataFrame([(i, float(x), 0.0, float(sc), "s") for i, (x, sc) in enumerate([(0, 5), (1, 9), (2, 5), (10, 1)])] + [(9, None, 0.0, 1.0, "s")], "point_id long, x double, y double, score double, at string")
    assert {r.x for r in kinematics.thinned(df, 1.5).collect()} == {1.0, 10.0}
    assert kinematics.thinned(df.limit(0), 1.5).count() == 0


def test_thinning_equals_the_walk(spark):
    import random

    rng = random.Random(5)
    rows = [(i, rng.uniform(0, 20), rng.uniform(0, 20), float(i * 7919 % 1009)) for i in range(400)]
    kept = []
    for r in sorted(rows, key=lambda r: -r[3]):
        if all((r[1] - k[1]) ** 2 + (r[2] - k[2]) ** 2 >= 4 for k in kept):
            kept.append(r)
    got = kinematics.thinned(spark.createDataFrame(rows, "point_id long, x double, y double, score double"), 2.0)
    assert {r.point_id for r in got.collect()} == {k[0] for k in kept}


def test_spacing_equals_the_walk(spark):
    import random

    rng = random.Random(6)
    rows, want = [], set()
    for e in ("a", "b", "c"):
        x = y = 0.0
        last = None
        for i in range(300):
            x, y = x + rng.uniform(-0.5, 0.8) * (i % 90 > 20), y + rng.uniform(-0.5, 0.5) * (i % 90 > 20)
            rows.append((e, i * 3, x, y, "n"))
            if last is None or (x - last[0]) ** 2 + (y - last[1]) ** 2 >= 4:
                want.add((e, i * 3))
                last = (x, y)
    df = spark.createDataFrame(rows + [("d", 1, None, 0.0, "n"), (None, 1, 0.0, 0.0, "n")], "episode_id string, frame_idx int, target_x double, target_y double, last string").repartition(6)
    got = [(r.episode_id, r.frame_idx) for r in kinematics.spaced(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_following_keeps_to_the_path_and_its_speeds(spark):
    import numpy as np

    from skylattice.operators import paths

    points = [("r", i, 8.0 * i, 6.0 * (i % 2)) for i in range(8)] + [("one", 0, 1.0, 1.0)]
    routes = paths.smooth_routes(spark.createDataFrame(points, "route_id string, ord int, x double, y double"))
    got = paths.followed(routes).orderBy("tick").toPandas()
    path = routes.orderBy("k").toPandas()
    assert set(got["route_id"]) == {"r"} and np.isclose(got["s"].iloc[-1], path["s"].max())
    step = np.diff(got["s"])
    assert (step > 0).all() and (step <= np.interp(got["s"][:-1], path["s"], path["speed"]) * 0.2 + 1e-9).all()
    turn = np.abs((np.diff(got["heading"]) + np.pi) % (2 * np.pi) - np.pi)
    assert (turn <= np.radians(60) * 0.2 + 1e-9).all()
    assert paths.followed(routes.limit(0)).count() == 0
