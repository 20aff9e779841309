import json

from skylattice.operators import nested

SCHEMA = "raw_id long, payload string, path string, kind string"


def links(spark, *payloads):
    df = spark.createDataFrame([(i, p, "x", "y") for i, p in enumerate(payloads)], SCHEMA)
    return {tuple(r)[:4] for r in nested.export_links(df).collect()}


def test_shapes_of_poses(spark):
    poses = [[1, 2, 3], [1, 2, 3, 0.5], {"x": 1, "y": 2.5, "z": 3}, {"pos": [1, 2, 3], "heading": 1}, [1, 2], {"x": 1, "y": None, "z": 3}, "n/a", None, [], {}, {"pos": [1]}, [True, 2, 3]]
    got = links(spark, *[json.dumps({"drone_pose_world": p}) for p in poses])
    assert {r[0] for r in got} == {0, 1, 2, 3}
    assert {r[1:] for r in got} == {("pose", "", "")}


def test_candidates_terms_and_images(spark):
    a = {"adversary_log": {"decision": {"candidates": [{"terms": [{"term": "a"}, None, {"term": "b"}]}, None, {"terms": {"term": "c"}}]}}}
    b = {"adversary_log": json.dumps({"candidates": {"score": 1, "terms": None}}), "images_saved": {"rgb": "a.png", "seg": "", "depth": {"path": "d.png", "meta": {"w": 1, "h": 2}}, "chase": None, "top": {"path": None}}}
    c = {"adversary_log": {"agent": {"decision": {"candidates": []}}}, "images_saved": [{"modality": "rgb", "path": "x", "bytes": 5}, {"modality": "seg", "path": ""}, {"modality": "rgb", "path": "x", "bytes": 5}, None]}
    got = links(spark, json.dumps(a), json.dumps(json.dumps(b)), json.dumps(c), "{broken", "[1]", "null", "3", "", json.dumps("text"))
    assert got == {
        (0, "candidate", "", "0"), (0, "candidate", "", "2"), (0, "term", "0", "0"), (0, "term", "0", "2"), (0, "term", "2", "0"),
        (1, "candidate", "", "0"), (1, "image", "", "rgb"), (1, "image", "", "depth"), (2, "image", "", "rgb"),
    }


def test_parent_links_of_deep_arrays(spark):
    record = {"a": 1, "l": [{"m": [{"v": 1}, {"v": 2}]}, {"m": {"v": 3}}, {"w": [1, 2]}]}
    df = spark.createDataFrame([(7, json.dumps(record), None, None), (None, None, None, None)], SCHEMA)
    rows = {(r.path, r.node_key): r for r in nested.flatten(df, "raw_id", "payload").collect()}
    assert set(rows) == {("", ""), ("l", "0"), ("l", "1"), ("l", "2"), ("l.m", "0/0"), ("l.m", "0/1"), ("l.m", "1/0")}
    assert rows["l.m", "0/1"].parent_path == "l" and rows["l.m", "0/1"].parent_key == "0" and rows["l.m", "0/1"].fields == {"v": "2"}
    assert rows["l", "2"].fields == {"w": "[1, 2]"} and rows["", ""].fields == {"a": "1"}


def test_merged_schema_and_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nested.export_links(empty).count() == 0 and nested.infer_schema(empty, "payload").count() == 0
    df = spark.createDataFrame([(1, '{"a": 1}', None, None), (2, '{"a": "x", "b": [1]}', None, None)], SCHEMA)
    got = {r.path: r.kinds for r in nested.infer_schema(df, "payload").collect()}
    assert got == {"": ["object"], "a": ["number", "string"], "b": ["array"], "b[]": ["number"]}


def test_very_deep_and_long_payloads(spark):
    deep = "[" * 100_000 + "]" * 100_000
    long = json.dumps({"adversary_log": {"candidates": [{"terms": []}] * 5000}})
    got = links(spark, deep, long)
    assert len(got) == 5000


def test_typed_tables_and_arrays_of_arrays(spark):
    records = [
        {"a": 1, "b": "x", "on": True, "s": ["p", "q"], "m": [[1, 2], [3], None], "l": [{"v": 1.5, "n": {"w": "y"}, "k": [[{"z": 1}], [{"z": 2}, {"z": 3}]]}, {"v": None}]},
        {"a": 2, "b": 7, "l": {"v": 2, "_key": 4}, "m": []},
        {"a": None},
    ]
    df = spark.createDataFrame([(i, json.dumps(r), None, None) for i, r in enumerate(records)], SCHEMA)
    t = nested.tables(df, "raw_id", "payload")
    assert set(t) == {"", "m", "l", "l.k", "l.k[]"}
    root = {r._record_id: r for r in t[""].collect()}
    assert (root[0].a, root[0].b, root[0].on, root[0].s) == (1.0, "x", True, ["p", "q"]) and (root[1].a, root[1].b, root[1].on) == (2.0, "7", None) and root[2].a is None
    assert {(r._key, r._ordinal): r.value for r in t["m"].collect()} == {("0", 0): [1.0, 2.0], ("1", 1): [3.0]}
    rows = {(r._record_id, r._key): r for r in t["l"].collect()}
    assert rows[0, "0"].v == 1.5 and rows[0, "0"].n_w == "y" and rows[0, "1"].v is None and rows[1, "0"].v == 2.0 and rows[1, "0"]._key_2 == 4.0
    deep = {(r._key, r._parent_key): r.z for r in t["l.k[]"].collect()}
    assert deep == {("0/0/0", "0/0"): 1.0, ("0/1/0", "0/1"): 2.0, ("0/1/1", "0/1"): 3.0}
    assert {r._key for r in t["l.k"].collect()} == {"0/0", "0/1"}


def test_too_many_paths_are_refused_however_they_are_spread(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(nested, "MAX_PATHS", 20)
    df = spark.createDataFrame([(i, json.dumps({f"k{i}": i}), None, None) for i in range(30)], SCHEMA)
    for parts in (1, 15):
        with pytest.raises(ValueError):
            nested.flatten(df.repartition(parts), "raw_id", "payload")
