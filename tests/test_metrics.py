"""Small episodes with known metrics."""

from skylattice.operators import metrics

FRAMES = "record_id long, episode_id string, frame_idx int, timestamp_s double, drone_pose_world struct<x:double,y:double,z:double,yaw:double>, target_pose_world struct<x:double,y:double,z:double,yaw:double>, target_velocity array<double>, drone_distance_m double, drone_bearing_to_target_rad double, tracker_mode string, target_visible boolean, in_camera_frustum boolean, line_of_sight_clear boolean, occlusion_risk double, collision boolean"


def measured(spark, pattern, level="easy", dt=0.1, collision_at=None, step=1.0):
    data = [(i, "e", i, i * dt, dict(x=i * step, y=0.0, z=-18.0, yaw=0.0), None, None, None, None, None, c == "V", None, None, None, i == collision_at) for i, c in enumerate(pattern)]
    frames = metrics.distinct_frames(spark.createDataFrame(data, FRAMES))
    episodes = spark.createDataFrame([("e", level)], "episode_id string, difficulty_level string")
    return metrics.episode_metrics(frames, episodes)


def test_continuity_and_lost(spark):
    r = measured(spark, "VVVVVLLVVV").first()
    assert (r.continuity, r.lost_frames, r.total_frames) == (0.5, 2, 10)


def test_reacquisition(spark):
    r = measured(spark, "VVLLLVVLVV").first()
    assert (r.reacquisition_events, r.reacquisition_frames) == (2, 2.0)
    assert measured(spark, "VVLL").first().reacquisition_events == 0


def test_a_leading_loss_counts_as_redetection_only(spark):
    r = measured(spark, "LLVV").first()
    assert (r.reacquisition_events, r.redetection_events, r.redetection_steps) == (0, 1, 3.0)
    r = measured(spark, "VVLLVVVLVV", dt=1.0)
    assert metrics.series_metrics(r).first().redetection_time_s == 2.5


def test_path(spark):
    r = measured(spark, "V" * 11).first()
    assert (r.path_length, r.path_efficiency) == (10.0, 1.0)


def test_success_thresholds(spark):
    assert not measured(spark, "V" * 65 + "L" * 35, "easy").first().tracking_success
    assert measured(spark, "V" * 65 + "L" * 35, "hard").first().tracking_success
    assert not measured(spark, "V" * 10, collision_at=3).first().tracking_success


def test_episode_without_frames(spark):
    r = measured(spark, "").first()
    assert (r.total_frames, r.tracking_success, r.visibility_ratio) == (0, False, 0.0)


def test_quantiles_equal_sorting(spark):
    import numpy as np

    from skylattice.operators import metrics

    rng = np.random.default_rng(1)
    data = {"a": rng.normal(0, 50, 501), "b": np.repeat([0.0, 3.0], 200), "c": np.array([-1e9]), "d": np.exp(rng.normal(0, 9, 300)), None: rng.integers(-3, 4, 99).astype(float)}
    rows = [(g, float(v), "x") for g, vs in data.items() for v in vs] + [("a", None, "x"), ("a", float("nan"), "x"), ("e", None, "x")]
    df = spark.createDataFrame(rows, "grp string, v double, bin string").repartition(5)
    for q in (0.0, 0.1, 0.5, 0.99, 1.0):
        got = {r.grp: r.at for r in metrics.quantile(df, "grp", "v", q, "at").collect()}
        assert set(got) == set(data)
        for g, vs in data.items():
            assert np.isclose(got[g], np.quantile(vs, q), rtol=1e-12, atol=1e-12)
