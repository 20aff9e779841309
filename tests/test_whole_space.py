"""Grids and rays cover all of the map, however far an episode travels."""

import pytest

from skylattice.plans import space

POSE = "struct<x: double, y: double, z: double, yaw: double>"


def pose(x, y, z):
    return (float(x), float(y), float(z), 0.0)


@pytest.fixture
def far(spark, tmp_path):
    rows = [(1, "e", 0, pose(1800, 900, -30), pose(1800, 900, -1)), (2, "e", 1, pose(0, 0, -10), pose(300, 0, -1)), (3, "e", 2, pose(float("nan"), 0, -10), pose(5, 5, -1)), (4, "e", 3, pose(2**31, 0, -10), pose(5, 5, -1)), (5, "e", 4, None, pose(5, 5, -1))]
    spark.createDataFrame(rows, f"record_id long, episode_id string, frame_idx int, drone_pose_world {POSE}, target_pose_world {POSE}").write.parquet(f"{tmp_path}/frame_records.parquet")
    return str(tmp_path)


def test_grids_hold_far_points(spark, far):
    got = {(r.ix, r.iy) for r in space.column_heights(spark, far).collect()}
    assert (450, -225) in got and (75, 0) in got
    assert {(r.ix, r.iy) for r in space.building_footprint(spark, far).where("blocks").collect()} >= {(450, -225)}


def test_every_ray_has_an_answer(spark, far):
    for q in (space.occupied_lookup, space.los_raymarch, space.building_los, space.roof_los, space.move_resolution, space.height_lookup):
        assert {r[0] for r in q(spark, far).collect()} == {1, 2, 3, 4}, q.__name__
    blocked = {r.ray_id: r.blocked for r in space.los_raymarch(spark, far).collect()}
    assert blocked[1] is not None and blocked[2] is None and blocked[3] is None
    assert {r.move_id: r.share_e2 for r in space.move_resolution(spark, far).collect()}[2] == 100
    assert {r.point_id for r in space.nearest_site(spark, far).collect()} == {1}


def test_dilation_reaches_the_ground(spark, far):
    got = {(r.ix, r.iy, r.iz) for r in space.dilate_3d(spark, far).collect()}
    assert {(450, -225, 0), (451, -225, 0), (450, -224, 0), (450, -225, 1), (450, -225, -1)} <= got
