import json

import pytest
from pyspark.sql import functions as F

from skylattice.operators import episode_files
from skylattice.operators.text import TIER_TEMPLATES
from skylattice.sources import config, files

META = {
    "episode_id": "e", "scene_id": "s", "difficulty_level": "hard", "target_behavior_type": "b", "target_class": "car", "instruction": "Track the car.", "max_steps": 5,
    "camera_config": {"hfov_deg": 90}, "uav_initial_pose": [0, 0, -18, 0], "target_initial_pose": [1, 2, 0], "environment_summary": {"a": 1}, "occluder_summary": {"b": 1}, "random_seed": 77,
}
SCORES = {"tracking_success": True, "target_visibility_ratio": 0.5, "line_of_sight_continuity": 0.4, "target_lost_ratio": 0.5, "re_acquisition_time_frames": 0, "collision_rate": 0.0, "path_length_m": 3.0}


def frame(i, **more):
    return {"frame_id": i, "image_path": f"images/{i}.png", "step_index": i, "timestamp": 0.1 * i, "uav_pose": [0, 0, 0, 0], "target_pose": [1, 1, 0], "target_velocity": [0, 0, 0], "target_visible": True, "distance_to_target": 2.0, "relative_bearing": 0.1, "collision": False} | more


def episode(root, name, frames=2, without=(), **docs):
    at = root / name
    (at / "images").mkdir(parents=True)
    rows = docs.pop("rows", [frame(i) for i in range(frames)])
    for i in range(frames):
        (at / "images" / f"{i}.png").write_bytes(b"x")
    content = {"metadata.json": META, "trajectories.json": {"target_trajectory": [1], "uav_trajectory": [1], "expert_viewpoints": [1]}, "instruction.json": {"instruction": "Track the car."}, "metrics.json": SCORES, "visibility.json": {}} | {k.replace("_json", ".json"): v for k, v in docs.items()}
    for file, doc in content.items():
        if file not in without:
            (at / file).write_text(doc if isinstance(doc, str) else json.dumps(doc))
    (at / "config.yaml").write_text("seed: 77\n")
    if "frames.jsonl" not in without:
        (at / "frames.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_a_file_without_a_byte_is_missing(spark, tmp_path):
    episode(tmp_path, "e")
    (tmp_path / "e" / "frames.jsonl").write_bytes(b"")
    assert episode_files.folder_report(spark, str(tmp_path)).first().issues == ["missing required file: frames.jsonl"]


def test_folder_report(spark, tmp_path):
    episode(tmp_path, "good")
    episode(tmp_path, "bare", without=("metrics.json", "visibility.json"))
    episode(tmp_path, "broken", metadata_json="{", metrics_json=SCORES | {"target_visibility_ratio": True}, instruction_json={"instruction": " "}, trajectories_json={"target_trajectory": [], "uav_trajectory": [1]})
    episode(tmp_path, "frames", rows=[frame(0), frame(1, image_path="images/none.png"), frame(True), frame(3, collision=1), frame(4, timestamp="x"), frame(5, occlusion_risk=2), "oops"], instruction_json={"instruction": "Turn left."})
    episode(tmp_path, "empty", rows=[])
    got = {r.folder.rsplit("/", 1)[1]: r for r in episode_files.folder_report(spark, str(tmp_path)).collect()}
    assert set(got) == {"good", "bare", "broken", "frames", "empty"}
    good = got["good"]
    assert (good.passed, good.issues, good.warnings, good.frames, good.images, good.visibility_ratio, good.success, good.difficulty) == (True, [], [], 2, 2, 0.5, True, "hard")
    assert got["bare"].issues == ["missing required file: metrics.json"] and got["bare"].warnings == ["missing recommended file: visibility.json"]
    assert got["broken"].issues == ["instruction.json: empty instruction", "metadata unreadable", "target_visibility_ratio out of [0,1]", "trajectories.json: missing/empty target_trajectory"]
    assert got["broken"].warnings == ["trajectories.json: no expert_viewpoints"]
    bad = got["frames"].issues
    assert [i for i in bad if i.startswith("frame invalid")] == ["frame invalid: collision must be true or false", "frame invalid: frame_id must be an integer", "frame invalid: occlusion_risk out of [0, 1]"]
    assert "... 4 frames failed field validation" in bad and "frames.jsonl unreadable: 1 lines" in bad and "5/7 recorded image paths do not exist" in bad
    assert got["frames"].warnings == ["instruction violates a rule: nav_verb:turn left"]
    assert got["empty"].issues == ["frames.jsonl is empty"]
    assert {r.folder.rsplit("/", 1)[1]: (r.seed, r.logged) for r in episode_files.seed_logged(spark, str(tmp_path)).collect()}["good"] == (77, True)


def test_folders(spark, tmp_path):
    episode(tmp_path, "a")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x_meta.jsonl").write_text("{}")
    names = lambda df: {r.folder.rsplit("/", 1)[1] for r in df.collect()}
    assert names(files.episode_folders(spark, str(tmp_path))) == {"a"}
    assert names(files.series_folders(spark, str(tmp_path))) == {"b"}
    for f in ("metadata.json", "frames.jsonl", "y_meta.jsonl"):
        (tmp_path / f).write_text("{}")
    assert names(files.episode_folders(spark, str(tmp_path))) == {tmp_path.name}
    assert names(files.series_folders(spark, str(tmp_path))) == {tmp_path.name}


def test_replay_and_records(spark, tmp_path):
    (tmp_path / "pose.jsonl").write_text('{"action": {"pos": [1, 2, 3], "yaw": 0.5}}\n{"action": null}\n{"other": 1}\n{"action": {"pos": [1]}}\nbroken\n')
    assert [(r.x, r.y, r.z, r.yaw) for r in files.replay_poses(spark, str(tmp_path)).collect()] == [(1.0, -2.0, -3.0, 0.5)]
    df = spark.createDataFrame([("a", 1), ("b", None)], "episode_id string, v int")
    files.write_records(df, str(tmp_path / "deep" / "out"))
    assert spark.read.json(str(tmp_path / "deep" / "out")).count() == 2
    with pytest.raises(Exception, match="v is missing"):
        files.write_records(df, str(tmp_path / "no"), F.when(F.col("v").isNull(), "v is missing"))


def test_configuration(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "p.yaml").write_text("default_profile: wide\nprofiles:\n  wide: {min_corridor_width_m: 14, strategy: x}\n  narrow:\n")
    doc = config.document(tmp_path / "p.yaml")
    assert config.start_profile(doc).min_corridor_width_m == 14 and config.start_profile(doc, "narrow") == config.StartProfile()
    with pytest.raises(KeyError):
        config.start_profile(doc, "none")
    assert config.document(tmp_path / "missing.yaml") == {}
    assert config.merged({"a": 1, "render": {"w": 1, "h": 2}}, {"render": {"w": 3}, "b": 4}) == {"a": 1, "b": 4, "render": {"w": 3, "h": 2}}
    (tmp_path / "t.yaml").write_text("tiers:\n  easy: ['Go.']\n")
    assert config.tier_templates(tmp_path / "t.yaml", TIER_TEMPLATES)["easy"] == ("Go.",) and config.tier_templates(tmp_path / "t.yaml", TIER_TEMPLATES)["hard"] == TIER_TEMPLATES["hard"]
    (tmp_path / "bad.yaml").write_text("- a\n- b\n")
    assert config.tier_templates(tmp_path / "bad.yaml", TIER_TEMPLATES) == TIER_TEMPLATES
