import random

import pytest

from skylattice.operators import occupancy


@pytest.mark.parametrize("tile", [4, 64])
def test_components_equal_a_flood(spark, monkeypatch, tile):
    monkeypatch.setattr(occupancy, "TILE", tile)
    rng = random.Random(tile)
    cells = {(rng.randint(-20, 20), rng.randint(-20, 20)) for _ in range(500)} | {(i, 40) for i in range(-30, 30)} | {(100 + (i // 9) % 2 * 9, i) for i in range(60)}
    label, left = {}, set(cells)
    while left:
        todo, part = [left.pop()], []
        while todo:
            x, y = todo.pop()
            part.append((x, y))
            near = {(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
        label |= {c: min(part) for c in part}
    df = spark.createDataFrame([(*c, "x") for c in cells] + [(*next(iter(cells)), "x")], "ix int, iy int, label string").repartition(5)
    got = {(r.ix, r.iy): r.label for r in occupancy.components(df).collect()}
    assert got == {c: (m[0] + (1 << 30)) * (1 << 31) + m[1] + (1 << 30) for c, m in label.items()}
    assert occupancy.components(df.limit(0)).count() == 0
