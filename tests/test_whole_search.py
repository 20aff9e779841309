"""Searches ask about every frame, with the whole candidate grid."""

import math

import pytest

from skylattice.plans import search

POSE = "struct<x: double, y: double, z: double, yaw: double>"


def pose(x, y, z, yaw=0.0):
    """Map coordinates, y and z turned over."""
    return (float(x), -float(y), -float(z), yaw)


@pytest.fixture
def world(spark, tmp_path):
    wall = [(1, "w", 0, None, pose(26, 0, 1)), (2, "w", 1, None, pose(26, 0, 7)), (3, "w", 2, None, pose(502, 506, 8)), (4, "w", 3, None, pose(502, 506, 1))]
    asked = [(10, "e", 0, pose(0, 0, 2), pose(20, 0, 2)), (11, "e", 1, pose(0, 0, 2), pose(20, 0, 2)), (12, "e", 2, pose(502, 480, 2), pose(502, 502, 2, math.pi / 2))]
    spark.createDataFrame(wall + asked, f"record_id long, episode_id string, frame_idx int, drone_pose_world {POSE}, target_pose_world {POSE}").write.parquet(f"{tmp_path}/frame_records.parquet")
    return str(tmp_path)


def test_hiding_places_of_every_frame(spark, world):
    got = {r.case_id: (r.candidate, r.score_e6) for r in search.hide_goal(spark, world).collect()}
    assert got[10] == got[11] == (7 * 32, 81_000_000)


def test_vantage_of_every_target_and_its_heading(spark, world):
    got = {r.target_id: r.candidate for r in search.clear_vantage(spark, world).collect()}
    assert set(got) >= {3, 4, 10, 11, 12} and got[10] == got[11] == 10 and got[12] == 17
