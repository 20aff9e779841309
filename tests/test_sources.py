import struct

import numpy as np
import pytest

from skylattice.sources import files, pcd


def head(n, kind):
    return f"VERSION .7\nFIELDS i x y z\nSIZE 2 4 4 4\nTYPE U F F F\nCOUNT 1 1 1 1\nPOINTS {n}\nDATA {kind}\n".encode()


POINTS = np.array([[1, 2, 3], [4.5, -5, 6], [7, 8, 9.25]], dtype="<f4")


def stored(data: bytes) -> bytes:
    """LZF with literals only."""
    return b"".join(bytes([len(data[i : i + 32]) - 1]) + data[i : i + 32] for i in range(0, len(data), 32))


def test_binary_and_compressed(spark, tmp_path):
    rows = b"".join(struct.pack("<H", i) + p.tobytes() for i, p in enumerate(POINTS))
    soa = np.arange(3, dtype="<u2").tobytes() + POINTS.T.tobytes()
    (tmp_path / "a.pcd").write_bytes(head(3, "binary") + rows)
    (tmp_path / "b.pcd").write_bytes(head(3, "binary_compressed") + struct.pack("<II", len(stored(soa)), len(soa)) + stored(soa))
    got = pcd.read_points(spark, str(tmp_path)).orderBy("file", "point_id").collect()
    assert [[r.x, r.y, r.z] for r in got] == POINTS.tolist() * 2
    assert pcd.read_points(spark, str(tmp_path), stride=2).count() == 4


def test_lzf_copies_may_overlap():
    assert pcd.lzf(bytes([0, 97, (7 << 5), 1, 0]), 11) == b"a" * 11
    with pytest.raises(ValueError):
        pcd.lzf(bytes([32, 5]), 3)


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": NaN, "b": [1, Infinity]}\nbroken\n')
    (tmp_path / "b.jsonl").write_text('{"a": "x"}\n')
    assert files.jsonl_lenient(spark, str(tmp_path)).count() == 3
    strict = {r.file[-7:]: (r.lines, r.broken, r.ok) for r in files.jsonl_strict(spark, str(tmp_path)).collect()}
    assert strict == {"a.jsonl": (3, 2, False), "b.jsonl": (1, 0, True)}


def test_folders_landmarks_and_grid(spark, tmp_path):
    (tmp_path / "e1").mkdir()
    (tmp_path / "e2").mkdir()
    for f in ("metadata.json", "frames.jsonl"):
        (tmp_path / "e1" / f).write_text("{}")
    (tmp_path / "e2" / "metadata.json").write_text("{}")
    assert [r.folder[-2:] for r in files.episode_folders(spark, str(tmp_path)).collect()] == ["e1"]
    (tmp_path / "lm.jsonl").write_text('{"type":"Building","filename":"X=1.5Y=-2Z=3.png","height":9}\n{"type":"tree","filename":"X=1Y=2Z=3.png"}\n')
    got = files.landmarks(spark, str(tmp_path), glob="lm.jsonl").collect()
    assert [(r.x, r.y, r.z, r.height) for r in got] == [(1.5, -2.0, 3.0, 9.0)]
    grid = spark.createDataFrame([(1, 2)], "ix int, iy int")
    files.write_grid(grid, str(tmp_path / "grid"))
    assert files.load_grid(spark, str(tmp_path / "grid")).collect() == grid.collect()
    grid.write.parquet(str(tmp_path / "old"))
    with pytest.raises(ValueError):
        files.load_grid(spark, str(tmp_path / "old"))


def test_scout_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"targets": [{"n": 1}, {"n": 2}]}')
    (tmp_path / "b.json").write_text('[{"n": 3}]')
    (tmp_path / "c.json").write_text("oops")
    assert files.scout_targets(spark, str(tmp_path)).count() == 3
