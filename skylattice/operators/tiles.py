"""Questions about places, answered tile by tile against the scene around them.

The map is cut into square tiles of cells. The questions of a tile meet the cells of the tile and of the eight around it in
one shuffle, and are answered in numpy; candidates are made and dropped there and never shuffled. Tiles with many questions
are split into parts, each with its own copy of the cells, whose number is bounded by the tile's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.session import materialize

#: Questions of a tile that one task answers; cell numbers stay below CELLS either way.
SHARE, CELLS = 25_000, 1 << 30
#: Pairs of a point and a site that are compared at once, besides those of one point.
PAIRS = 1_000_000


def tile(cell: Column, side: int) -> Column:
    return F.floor(cell / F.lit(side)).cast("int")


def answered(asked: DataFrame, scene: DataFrame, side: int, answer: Callable[[pa.Table, pa.Table, tuple[int, int]], pa.Table], schema: str, share: int = SHARE) -> DataFrame:
    """answer(questions, cells, corner) of the questions (tx, ty, ...) of each tile of `side` cells along a side, and of the
    scene's cells (ix, iy, ...) in the 3 * side squared cells from the corner ix, iy on."""
    keys = ["tx", "ty", "part"]
    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = materialize(asked.groupBy("tx", "ty").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("parts")).coalesce(1), "tiles")
    hashed = F.xxhash64(*[c for c in asked.columns if c not in keys])
    salted = asked.join(tiles, ["tx", "ty"]).withColumn("part", F.pmod(hashed, F.col("parts")).cast("int")).drop("parts")
    around = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = scene.withColumn("o", F.explode(around)).select(*scene.columns, (tile(F.col("ix"), side) + F.col("o.dx")).alias("tx"), (tile(F.col("iy"), side) + F.col("o.dy")).alias("ty"))
    near = near.join(tiles, ["tx", "ty"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def run(key: tuple[pa.Scalar, ...], questions: pa.Table, cells: pa.Table) -> pa.Table:
        return answer(questions, cells, tuple((k.as_py() - 1) * side for k in key[:2]))

    return salted.repartition(n, *keys).groupBy(*keys).cogroup(near.repartition(n, *keys).groupBy(*keys)).applyInArrow(run, schema)


def numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns as arrays, NaN for null."""
    return [pc.fill_null(table[c].cast(pa.float64()), float("nan")).to_numpy() for c in names]


def on_grid(cells: pa.Table, corner: tuple[int, int], wide: int, values: np.ndarray | None = None, empty: float | bool = False) -> np.ndarray:
    """The cells' values (True without any) on a grid of `wide` cells along a side, empty elsewhere."""
    out = np.full((wide, wide), empty)
    out[tuple(cells[c].to_numpy() - o for c, o in zip(("ix", "iy"), corner))] = True if values is None else values
    return out


class Solids:
    """Solid voxels (ix, iy, iz) of a grid, met by rays."""

    def __init__(self, cells: pa.Table, corner: tuple[int, int], wide: int, voxel: float):
        self.corner, self.wide, self.voxel = corner, wide, voxel
        self.column = on_grid(cells, corner, wide)
        x, y = (cells[c].to_numpy().astype(np.int64) - o for c, o in zip(("ix", "iy"), corner))
        self.keys = np.sort(self.key(x * wide + y, cells["iz"].to_numpy().astype(np.int64)))

    @staticmethod
    def key(column: np.ndarray, iz: np.ndarray) -> np.ndarray:
        return (column << 32) + iz + CELLS

    def holds(self, at: list[np.ndarray]) -> np.ndarray:
        x, y = (np.floor(c / self.voxel).astype(np.int64) - o for c, o in zip(at, self.corner))
        out = (x >= 0) & (y >= 0) & (x < self.wide) & (y < self.wide)
        some = np.flatnonzero(out)
        out[some] = self.column[x[some], y[some]]
        some = np.flatnonzero(out)
        asked = self.key(x[some] * self.wide + y[some], np.floor(at[2][some] / self.voxel).astype(np.int64))
        out[some] = self.keys[np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)] == asked if len(some) else False
        return out

    def meet(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the rays a -> b [3, n] have one of their inner samples (see occupancy.samples) in a solid voxel. Only the
        samples that lie over the grid are looked at."""
        way = b - a
        steps = np.maximum(4, np.floor(np.sqrt(way[0] ** 2 + way[1] ** 2 + way[2] ** 2) / self.voxel))
        first, last = np.ones(a.shape[1]), steps - 1
        for p, d, o in zip(a, way, self.corner):
            lo, hi = (o - 1) * self.voxel, (o + self.wide + 1) * self.voxel
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                ends = (lo - p) / d, (hi - p) / d
            inside = (p >= lo) & (p <= hi)
            enter, leave = (np.where(d == 0, np.where(inside, flat, -flat), f(*ends)) for f, flat in ((np.minimum, -np.inf), (np.maximum, np.inf)))
            first, last = np.maximum(first, np.floor(enter * steps) - 1), np.minimum(last, np.ceil(leave * steps) + 1)
        met = np.zeros(a.shape[1], dtype=bool)
        live = np.flatnonzero(first <= last)
        step = first
        while len(live):
            t = step[live] / steps[live]
            hit = self.holds([p[live] + d[live] * t for p, d in zip(a, way)])
            met[live[hit]] = True
            step[live] += 1
            live = live[~hit]
            live = live[step[live] <= last[live]]
        return met


class Sites:
    """Places x, y, in the order of their ids, that are searched from the nearest cells on. Cells hold about two of them but
    are no smaller than a sixteenth of the reach."""

    def __init__(self, x: np.ndarray, y: np.ndarray, reach: float):
        self.low = np.array([x.min(), y.min()])
        extent = max(np.ptp(x), np.ptp(y), reach)
        self.size = max(extent / max(1.0, math.sqrt(len(x) / 2)), reach / 16)
        self.wide = int(extent / self.size) + 2
        cell = self.cells(x, 0) * self.wide + self.cells(y, 1)
        self.order = np.lexsort((y, x, cell))  # of equal places the first, by id, is enough
        x, y, cell = x[self.order], y[self.order], cell[self.order]
        fresh = np.append(True, (np.diff(x) != 0) | (np.diff(y) != 0) | (np.diff(cell) != 0))
        self.x, self.y, self.order, self.reach = x[fresh], y[fresh], self.order[fresh], reach
        self.first = np.searchsorted(cell[fresh], np.arange(self.wide * self.wide + 1))

    def cells(self, c: np.ndarray, axis: int) -> np.ndarray:
        return np.floor((c - self.low[axis]) / self.size).astype(np.int64)

    def take(self, x: np.ndarray, y: np.ndarray, p: np.ndarray, at: np.ndarray, count: np.ndarray, best: np.ndarray, number: np.ndarray) -> None:
        """Compare points p with the `count` sites of cell `at`."""
        starts = np.cumsum(count) - count
        site = np.arange(count.sum()) + np.repeat(self.first[at] - starts, count)
        d = np.sqrt((np.repeat(x[p], count) - self.x[site]) ** 2 + (np.repeat(y[p], count) - self.y[site]) ** 2)
        least = np.minimum.reduceat(d, starts)
        first = np.minimum.reduceat(np.where(d == np.repeat(least, count), self.order[site], np.iinfo(np.int64).max), starts)
        nearer = (least <= self.reach) & ((least < best[p]) | ((least == best[p]) & (first < number[p])))
        best[p[nearer]], number[p[nearer]] = least[nearer], first[nearer]

    def nearest(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and distance of the nearest site within reach of each point, the smaller number of equally near ones; -1
        without one. Rings of cells are looked at until none can hold a nearer site."""
        best, number = np.full(len(x), np.inf), np.full(len(x), -1)
        cx, cy = self.cells(x, 0), self.cells(y, 1)
        live, ring = np.arange(len(x)), 0
        while len(live):
            for i, j in ((i, j) for i in range(-ring, ring + 1) for j in range(-ring, ring + 1) if max(abs(i), abs(j)) == ring):
                at_x, at_y = cx[live] + i, cy[live] + j
                on = (at_x >= 0) & (at_y >= 0) & (at_x < self.wide) & (at_y < self.wide)
                at = at_x[on] * self.wide + at_y[on]
                count = self.first[at + 1] - self.first[at]
                some = count > 0
                p, at, count = live[on][some], at[some], count[some]
                for block in np.split(np.arange(len(p)), np.flatnonzero(np.diff(np.cumsum(count) // PAIRS)) + 1):
                    if len(block):
                        self.take(x, y, p[block], at[block], count[block], best, number)
            live = live[ring * self.size <= np.minimum(best[live], self.reach) * (1 + 1e-9) + 1e-6]
            ring += 1
        return number, best
