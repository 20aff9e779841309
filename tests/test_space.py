from skylattice.operators import occupancy as occ

G = occ.Grid(voxel=1.0, building=6.0, large=12.0, large_cells=9)


def cells(spark, *xy):
    return spark.createDataFrame(list(xy), "ix int, iy int")


def test_components(spark):
    line = [(i, 0) for i in range(70)] + [(100, 100), (101, 101), (200, 5)]
    got = occ.components(cells(spark, *line)).groupBy("label").count().collect()
    assert sorted(r["count"] for r in got) == [1, 2, 70]


def test_rail_and_building_on_a_ray(spark):
    wall = [(5.5, y + 0.5, z + 0.5) for y in range(-3, 3) for z in range(20)]
    rail = [(15.5, 0.5, 3.5)]
    pts = spark.createDataFrame([(float(x), float(y), float(z)) for x, y, z in wall + rail], "x double, y double, z double")
    flags = occ.building_flags(occ.columns2d(pts, G), G)
    rays = spark.createDataFrame([(1, 0.0, 0.5, 10.0, 10.0, 0.5, 10.0), (2, 0.0, 0.5, 30.0, 10.0, 0.5, 28.0), (3, 12.0, 0.5, 3.5, 19.0, 0.5, 3.5)], "ray_id long, ax double, ay double, az double, bx double, by double, bz double")
    got = {r.ray_id: r.blocked for r in occ.line_of_sight(rays, occ.voxels(pts, G), flags, G).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_nearest_and_pairs(spark):
    sites = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 500.0, 0.0)], "site_id long, x double, y double")
    points = spark.createDataFrame([(1, 5.0, 0.0), (2, 9.0, 1.0), (3, 200.0, 0.0)], "point_id long, x double, y double")
    assert {(r.point_id, r.site_id) for r in occ.nearest(points, sites, 20.0).collect()} == {(1, 1), (2, 2)}
    assert [(r.site_a, r.site_b) for r in occ.site_pairs(sites, 5, 20).collect()] == [(1, 2)]


def test_moves_and_free_runs(spark):
    blocked = cells(spark, (5, 0))
    moves = spark.createDataFrame([(1, 0.5, 0.5, 10.5, 0.5), (2, 0.5, 3.5, 10.5, 3.5)], "move_id long, ax double, ay double, bx double, by double")
    assert {r.move_id: r.share for r in occ.resolved_moves(moves, blocked, G).collect()} == {1: 0.25, 2: 1.0}
    starts = spark.createDataFrame([(1, 0, 0)], "start_id long, ix int, iy int")
    free = {r.heading: r.free for r in occ.free_runs(starts, blocked, 8, 12).collect()}
    assert free[0] == 4 and free[4] == 12


def test_points_without_place_are_left_out(spark):
    pts = spark.createDataFrame([(float("nan"), 0.0, 0.0), (None, 0.0, 0.0), (float("inf"), 0.0, 0.0), (0.5, 0.5, 0.5)], "x double, y double, z double")
    assert occ.voxels(pts, G).count() == 1
