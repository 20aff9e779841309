"""Routes go through every frame of an episode."""

from skylattice.plans import checks

POSE = "struct<x: double, y: double, z: double, yaw: double>"


def test_routes_use_all_frames(spark, tmp_path):
    bend = lambda i: 3.0 if i == 7 else 0.0  # noqa: E731  (between two multiples of 25)
    rows = [(i, "e", i, (float(i), bend(i), 0.0, 0.0)) for i in range(701)] + [(900 + i, "odd", 25 * i + 1, (float(i), 0.0, 0.0, 0.0)) for i in range(4)]
    df = spark.createDataFrame(rows, f"record_id long, episode_id string, frame_idx int, target_pose_world {POSE}")
    extra = {"timestamp_s": "double", "drone_pose_world": POSE, "target_velocity": "array<double>", "drone_distance_m": "double", "drone_bearing_to_target_rad": "double", "tracker_mode": "string", "target_visible": "boolean", "in_camera_frustum": "boolean", "line_of_sight_clear": "boolean", "occlusion_risk": "double", "collision": "boolean"}
    df.selectExpr("*", *[f"cast(null as {t}) as {c}" for c, t in extra.items()]).write.parquet(f"{tmp_path}/frame_records.parquet")
    got = {r.route_id: r for r in checks.smooth_routes(spark, str(tmp_path)).collect()}
    assert got["e"].length_e1 > 7030 and got["odd"].length_e1 == 30
