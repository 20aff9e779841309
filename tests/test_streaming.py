from skylattice.streaming import live

SCHEMA = "episode_id string, frame_idx int, received_at timestamp, tracker_mode string, target_visible boolean, collision boolean"


def stream(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).selectExpr("episode_id", "frame_idx", "cast(received_at as timestamp_ntz) as received_at", "tracker_mode", "target_visible", "collision").write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))


def test_live_equals_batch(spark, tmp_path):
    from datetime import datetime

    t = datetime(2025, 1, 1)
    rows = [("a", i, t, "track", i % 2 == 0, None) for i in range(10)] + [("a", 4, t, "track", True, None)] + [("b", 3, t, None, None, True), (None, 1, t, "x", True, True)]
    out = live.drained(live.live_metrics(stream(spark, tmp_path, rows)), "update", str(tmp_path / "live_test"))
    assert {tuple(r) for r in out.drop("batch").collect()} == {("a", 10, 5, 0, 9), ("b", 1, 0, 1, 3)}


def test_repeats_leave_once(spark, tmp_path):
    from datetime import datetime

    rows = [("a", 1, datetime(2025, 1, 1), "t", True, False)] * 3 + [("a", 2, datetime(2025, 1, 1), "t", True, False)]
    out = live.drained(live.without_repeats(stream(spark, tmp_path, rows)), "append", str(tmp_path / "once_test"))
    assert out.count() == 2


def test_windows_and_ticks_are_files(spark, tmp_path):
    from datetime import datetime

    rows = [("a", i // 2, datetime(2025, 1, 1, 0, i), "T", True, False) for i in range(20)] + [(None, 1, datetime(2025, 1, 1), "t", True, False)]
    df = stream(spark, tmp_path, rows)
    out = live.drained(live.window_counts(df), "complete", str(tmp_path / "window_test"))
    assert sum(r.frames for r in out.collect()) == 21 and "batch" not in out.columns
    assert live.append_ticks(df, str(tmp_path / "tick_test")).count() == 10
