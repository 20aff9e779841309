"""Searches around places are made in tiles: same answers as by brute force, and no candidate is shuffled."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skylattice.operators import occupancy as occ
from skylattice.operators import planning, sight

GRID = occ.Grid(voxel=4.0, building=17.0, large=17.5, large_cells=4)


def shuffled(spark, action):
    """Records that the stages of an action wrote to shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._jvm.java.util.ArrayList()

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
        return {(stages.apply(k).stageId(), stages.apply(k).attemptId()): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    before = total()
    out = action()
    return out, sum(n for k, n in total().items() if k not in before)


def scene(spark, points):
    return occ.extents(spark.createDataFrame(points, "x double, y double, z double"), GRID)


def town(r):
    return [(x + r.uniform(0, 4), y + r.uniform(0, 4), z) for x in range(-200, 500, 24) for y in range(-200, 300, 20) if r.random() < 0.5 for z in ((0.5, 7.0, 12.0) if r.random() < 0.6 else (1.0, 9.0, 19.0))]


def hidden_by_brute_force(case, points):
    columns, solid = {}, set()
    for x, y, z in points:
        columns.setdefault((math.floor(x / 4), math.floor(y / 4)), []).append(z)
    for x, y, z in points:
        c = math.floor(x / 4), math.floor(y / 4)
        if max(columns[c]) - min(columns[c]) > GRID.road_extent:
            solid.add((*c, math.floor(z / 4)))
    _, x, y, z, dx, dy, dz = case
    best = None
    for n in range(256):
        r, a = 6.0 + 3.0 * (n // 32), 2 * math.pi * (n % 32) / 32
        ox, oy = r * math.cos(a), r * math.sin(a)
        px, py = x + ox, y + oy
        if max(columns.get((math.floor(px / 4), math.floor(py / 4)), [0])) >= GRID.building:
            continue
        steps = max(4, math.floor(math.sqrt((px - dx) ** 2 + (py - dy) ** 2 + (z - dz) ** 2) / 4))
        if any(tuple(math.floor((p + (q - p) * (s / steps)) / 4) for p, q in ((dx, px), (dy, py), (dz, z))) in solid for s in range(1, steps)):
            away = (ox * (x - dx) + oy * (y - dy)) / max(1e-6, math.sqrt((x - dx) ** 2 + (y - dy) ** 2))
            best = max(best or (-(10**12), 0), (math.floor((2.0 * away + r) * 1e6 + 0.5), -n))
    return best and (-best[1], best[0])


@pytest.fixture(scope="module")
def hiding(spark):
    r = random.Random(4)
    points = town(r)
    cases = [(n, r.uniform(-150, 400), r.uniform(-150, 250), 1.0, r.uniform(-200, 450), r.uniform(-200, 300), r.uniform(4, 15)) for n in range(60)]
    cases += [(60, 10.0, 10.0, 1.0, 10.0, 10.0, 18.0), (61, 0.0, 0.0, 1.0, 5000.0, -7000.0, 60.0), (62, 90.0, 30.0, 1.0, -60000.0, 30.0, 9.0), (63, 90000.0, 90000.0, 1.0, 0.0, 0.0, 9.0), (64, -90.0, 20.0, 1.0, -90.0, 400.0, 6.0)]
    cases += [(n, *cases[n % 60][1:]) for n in range(65, 400)]
    return points, cases


def test_hiding_places_are_those_of_brute_force_however_far_the_drone(spark, hiding):
    points, cases = hiding
    v, columns = scene(spark, points)
    asked = spark.createDataFrame(cases, "case_id long, x double, y double, z double, dx double, dy double, dz double")
    found = planning.hiding_places(asked, v, columns, columns.where("is_building"), GRID)
    got = {r.case_id: (r.candidate, r.score_e6) for r in found.collect()}
    want = {c[0]: hidden_by_brute_force(c, points) for c in cases[:65]}
    assert {k: v for k, v in got.items() if k < 65} == {k: v for k, v in want.items() if v}
    assert sum(v is not None for v in want.values()) > 50 and want[62] and not want[63]
    assert all(got.get(n) == got.get(n % 60) for n in range(65, 400))


def test_hiding_places_shuffle_no_candidates(spark, hiding):
    points, cases = hiding
    v, columns = scene(spark, points)
    asked = spark.createDataFrame([(n, *c[1:]) for n, c in enumerate(cases[:60] * 50)], "case_id long, x double, y double, z double, dx double, dy double, dz double")
    _, records = shuffled(spark, lambda: planning.hiding_places(asked, v, columns, columns.where("is_building"), GRID).collect())
    assert records < 32 * 3000, records


def walls_of(points):
    top = {}
    for x, y, z in points:
        c = math.floor(x / 4), math.floor(y / 4)
        top[c] = max(top.get(c, z), z)
    return {c for c, z in top.items() if z >= GRID.building}


def seed_by_brute_force(anchor, walls):
    _, x, y = anchor
    best = None
    for n, dx, dy in sight.rings(180.0, 12.0, 12):
        ix, iy = math.floor((x + dx) / 4), math.floor((y + dy) / 4)
        if (ix, iy) in walls:
            continue
        step = lambda h, s: (ix + round(s * math.cos(2 * math.pi * h / 8)), iy + round(s * math.sin(2 * math.pi * h / 8)))  # noqa: E731, B023
        free = [next((s for s in range(1, 13) if step(h, s) in walls), 13) - 1 for h in range(8)]
        score, h = max((free[h] + 0.25 * free[(h + 4) % 8] + 2.0 * (free[(h + 2) % 8] + free[(h + 6) % 8] + 1), -h) for h in range(8))
        best = max(best or (-1e9, 0, 0), (round(score - 0.03 * math.sqrt((x + dx - x) ** 2 + (y + dy - y) ** 2), 6), -n, h))
    return best and (-best[1], -best[2], best[0])


def test_road_seeds_are_those_of_brute_force_and_no_place_is_shuffled(spark):
    r = random.Random(5)
    points = [(4 * i + 1.0, 4 * j + 1.0, 20.0) for i in range(-60, 60) for j in range(-60, 60) if r.random() < 0.15] + [(4 * i + 1.0, 4 * j + 1.0, 20.0) for i in range(1000, 1100) for j in range(1000, 1100)]
    columns = scene(spark, points)[1]
    anchors = [(n, r.uniform(-250, 250), r.uniform(-250, 250)) for n in range(100)] + [(100, 1e7, -1e7), (101, float("nan"), 0.0), (102, None, 0.0), (103, 4200.0, 4200.0)]
    asked = spark.createDataFrame(anchors, "anchor_id long, x double, y double")
    found, records = shuffled(spark, lambda: sight.road_seeds(asked, columns.where("is_building"), GRID).collect())
    got = {a.anchor_id: (a.n, a.heading, a.score) for a in found}
    walls = walls_of(points)
    assert {a[0]: got.get(a[0]) for a in anchors[:12]} == {a[0]: seed_by_brute_force(a, walls) for a in anchors[:12]}
    assert got[100] == (0, 0, 65.0) and got[101][:2] == got[102][:2] == (0, 0) and math.isnan(got[101][2]) and got[102][2] is None
    assert 103 not in got and len(got) == 103
    assert records < 300_000, records


def test_spiral_starts_are_the_first_good_places_and_no_place_is_shuffled(spark):
    r = random.Random(6)
    points = [(4 * i + 1.0, 4 * j + 1.0, z) for i in range(-50, 50) for j in range(-50, 50) if r.random() < 0.5 for z in ([20.0] if r.random() < 0.1 else [r.choice([0.0, 0.3, 0.6]), r.choice([0.9, 7.0, 7.0])])]
    columns = scene(spark, points)[1]
    anchors = [(n, r.uniform(-150, 150), r.uniform(-150, 150)) for n in range(300)] + [(300, float("nan"), 0.0), (301, None, 0.0), (302, 9000.0, -9000.0)]
    asked = spark.createDataFrame(anchors, "anchor_id long, x double, y double")
    walls = columns.where("is_building")
    found, records = shuffled(spark, lambda: sight.spiral_starts(asked, walls, columns, GRID).collect())
    got = {a.anchor_id: (a.n, a.score) for a in found}
    assert len(got) == 303 and got[300] == got[301] == (0, None) and got[302][0] == 0 and got[302][1] > 0
    assert records < 200_000, records

    few = [a for a in anchors[:6]]
    starts = spark.createDataFrame([(1000 * a + n, x + dx, y + dy, x, y) for a, x, y in few for n, dx, dy in sight.rings(32.0, 4.0, 8)], "start_id long, x double, y double, anchor_x double, anchor_y double")
    cells = starts.select("start_id", occ.cell(F.col("x"), 4.0).alias("ix"), occ.cell(F.col("y"), 4.0).alias("iy"))
    gates = sight.init_gates(starts, occ.corridor(occ.free_runs(cells, walls, 8, 12), 8).where("place = 1"), columns, GRID).where("reason = 'ok'").collect()
    first = {}
    for g in sorted(gates, key=lambda g: g.start_id):
        first.setdefault(g.start_id // 1000, (g.start_id % 1000, g.score))
    assert len(first) > 2
    assert {a[0]: got[a[0]] for a in few} == {a[0]: first.get(a[0], (0, None)) for a in few}


def test_nearest_sites_are_those_of_brute_force_and_points_are_shuffled_as_they_are(spark):
    r = random.Random(7)
    sites = [(n, r.uniform(-60, 60), r.uniform(-60, 60)) for n in range(400)] + [(n, float(r.randint(-8, 8)), 300.0 + r.randint(-8, 8)) for n in range(400, 700)] + [(700, float("nan"), 0.0), (701, None, 5.0), (702, -95.0, -5.0)]
    points = [(n, r.uniform(-120, 120), r.uniform(-120, 120)) for n in range(4000)] + [(n, float(r.randint(-30, 30)), 300.0 + r.randint(-30, 30) / 2) for n in range(4000, 5000)] + [(5000, float("nan"), 0.0), (5001, None, 0.0), (5002, 1e300, 0.0)]
    p, s = spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(sites, "site_id long, x double, y double")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        found, records = shuffled(spark, lambda: occ.nearest(p, s, 30.0).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    want = {}
    for n, x, y in points[:5000]:
        d, site = min((math.sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)), k) for k, sx, sy in sites if sx is not None and not math.isnan(sx))
        if d <= 30.0:
            want[n] = (site, d)
    assert {a.point_id: (a.site_id, a.distance) for a in found} == want and 2000 < len(want) < 4900
    assert records < 4 * 5000 + 20 * 700, records
