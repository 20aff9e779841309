"""Searches over candidate places: vantage points, hiding places, start gates, corridors, and a viewpoint plan in time.

Candidates are constants that are exploded next to each question, tested by equi-joins against the grid and reduced to
the best by one aggregation; hiding places are tried tile by tile instead. Ties go to the first candidate.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.geo import wrap_to_pi
from skylattice.operators import occupancy as occ
from skylattice.operators import tiles
from skylattice.session import materialize


def evaluated(frames: DataFrame, hfov: Column, reach: float = 100.0) -> DataFrame:
    """visible, in_frustum, los_clear, source and score of each frame. A recorded judgement stands; otherwise geometry
    decides where the drone's yaw is known; what can't be told is null and the score then is 1."""
    dx, dy = F.col("target_x") - F.col("uav_x"), F.col("target_y") - F.col("uav_y")
    off = F.coalesce("drone_bearing_to_target_rad", wrap_to_pi(F.atan2(dy, dx) - F.col("uav_yaw")))
    geometric = (F.abs(off) <= hfov / 2) & (F.sqrt(dx * dx + dy * dy) <= reach)
    frustum = F.coalesce("in_camera_frustum", geometric)
    visible = F.coalesce("target_visible", frustum & F.coalesce("line_of_sight_clear", F.lit(True)))
    source = F.concat_ws("+", F.when(F.col("target_visible").isNotNull(), "recorded").otherwise("derived"), F.when(F.col("in_camera_frustum").isNull() & geometric.isNotNull(), "geometry"), F.when(F.col("line_of_sight_clear").isNotNull(), "los"))
    score = F.when(~visible, 0.0).when(visible.isNull() | off.isNull(), 1.0).otherwise(0.1 + 0.9 * F.greatest(F.lit(0.0), 1.0 - F.abs(off) / (hfov / 2)))
    return frames.select("episode_id", "frame_idx", visible.alias("visible"), frustum.alias("in_frustum"), F.col("line_of_sight_clear").alias("los_clear"), source.alias("source"), score.alias("score"))


def vantage_points(targets: DataFrame, voxel_set: DataFrame, flags: DataFrame, g: occ.Grid, height: float = 12.0) -> DataFrame:
    """For each target (target_id, x, y, z, heading) the clear viewpoint of least cost |ahead| + 0.6 |aside| among 4 x 7
    offsets; targets without a clear one are left out."""
    grid = [(n, f, s) for n, (f, s) in enumerate((f, s) for f in (-16.0, -8.0, 8.0, 16.0) for s in (-18.0, -12.0, -6.0, 0.0, 6.0, 12.0, 18.0))]
    offsets = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(f).alias("f"), F.lit(s).alias("s")) for n, f, s in grid])
    c, s = F.cos("heading"), F.sin("heading")
    spread = targets.withColumn("o", F.explode(offsets)).withColumn("ray_id", F.col("target_id") * len(grid) + F.col("o.n"))
    spread = spread.select("target_id", "ray_id", "o", (F.col("x") + c * F.col("o.f") - s * F.col("o.s")).alias("ax"), (F.col("y") + s * F.col("o.f") + c * F.col("o.s")).alias("ay"), (F.col("z") + height).alias("az"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"))
    clear = occ.line_of_sight(spread, voxel_set, flags, g).where("not blocked").select("ray_id")
    cost = (F.abs("o.f") + 0.6 * F.abs("o.s")).alias("cost")
    return spread.join(clear, "ray_id").select("target_id", F.struct(cost, F.col("o.n").alias("n")).alias("c")).groupBy("target_id").agg(F.min("c").alias("c")).select("target_id", F.col("c.n").alias("candidate"), F.col("c.cost").alias("cost"))


#: Candidates that are tried before others, best first: so many at a time.
TRIED = (2, 8, 32)


def best_hidden(cases: np.ndarray, free: np.ndarray, places: np.ndarray, solids: tiles.Solids) -> tuple[np.ndarray, np.ndarray]:
    """score in millionths and number of the best free place [case, place] that a solid voxel hides, number -1 without one.
    cases: x, y, z, dx, dy, dz [6, case]; places: offsets x, y and distance [3, place]. Better places are tried first."""
    count = places.shape[1]
    ux, uy = cases[0] - cases[3], cases[1] - cases[4]
    away = (places[0] * ux[:, None] + places[1] * uy[:, None]) / np.maximum(1e-6, np.sqrt(ux * ux + uy * uy))[:, None]
    score = np.floor((2.0 * away + places[2]) * 1e6 + 0.5).astype(np.int64)
    none = np.iinfo(np.int64).min
    ranked = np.sort(np.where(free, score * count + np.arange(count)[::-1], none), axis=1)[:, ::-1]
    best = np.full(cases.shape[1], none)
    live = np.arange(cases.shape[1])
    for lo, hi in zip((0, *TRIED), (*TRIED, count)):
        live = live[ranked[live, lo] != none] if lo < count else live[:0]
        tried = ranked[live, lo:hi]
        row, rank = np.nonzero(tried != none)
        n, case = count - 1 - tried[row, rank] % count, cases[:, live[row]]
        hidden = np.zeros(tried.shape, dtype=bool)
        hidden[row, rank] = solids.meet(case[3:], np.stack([case[0] + places[0, n], case[1] + places[1, n], case[2]]))
        found = hidden.any(axis=1)
        best[live[found]] = tried[found, hidden[found].argmax(axis=1)]
        live = live[~found]
    return np.where(best == none, 0, best // count), np.where(best == none, -1, count - 1 - best % count)


def hiding_places(cases: DataFrame, voxel_set: DataFrame, flags: DataFrame, blocked: DataFrame, g: occ.Grid, radii: tuple[float, ...] = (6.0, 9.0, 12.0, 15.0, 18.0, 21.0, 24.0, 27.0), angles: int = 32) -> DataFrame:
    """For each case (case_id, x, y, z of the target, dx, dy, dz of the drone, all real) the best free place around the
    target that the drone can't see: away from the drone counts double, distance once. Cases meet the scene of their target's
    tile. Where the drone is beyond it, only the free places are found there, and the rays then meet every tile on the way."""
    places = np.array([(r * math.cos(2 * math.pi * a / angles), r * math.sin(2 * math.pi * a / angles), r) for r in radii for a in range(angles)]).T
    side = max(32, math.ceil(4 * max(radii) / g.voxel))
    wide, reach = 3 * side, (side - 1) * g.voxel
    solid = voxel_set.join(flags.where("blocks").select("ix", "iy"), ["ix", "iy"], "left_semi").where(F.abs("iz") <= math.ceil(occ.REAL / g.voxel) + 1).select("ix", "iy", "iz")
    names = ["x", "y", "z", "dx", "dy", "dz"]
    kind = dict(cases.dtypes)["case_id"]

    def answer(questions: pa.Table, cells: pa.Table, corner: tuple[int, int]) -> pa.Table:
        is_wall = cells["iz"].is_null()
        walls = tiles.on_grid(cells.filter(is_wall), corner, wide)
        solids = tiles.Solids(cells.filter(pc.invert(is_wall)), corner, wide, g.voxel)
        out = []
        for lo in range(0, questions.num_rows, 2048):
            part = questions.slice(lo, 2048)
            c = np.stack(tiles.numbers(part, *names))
            if "free" in part.column_names:
                free = np.unpackbits(np.frombuffer(b"".join(part["free"].to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1), axis=1, count=places.shape[1]).astype(bool)
                far = np.zeros(part.num_rows, dtype=bool)
            else:
                at = [np.floor((c[k][:, None] + places[k]) / g.voxel).astype(np.int64) - corner[k] for k in (0, 1)]
                free = ~walls[at[0], at[1]]
                far = np.sqrt((c[0] - c[3]) ** 2 + (c[1] - c[4]) ** 2) > reach
            score, n = best_hidden(c, free & ~far[:, None], places, solids)
            bits = pa.array([b.tobytes() if f else None for b, f in zip(np.packbits(free, axis=1), far)], pa.binary())
            found = pa.table([part["case_id"], pa.array(score), pa.array(n.astype(np.int32)), bits, *(part[c] for c in names)], ["case_id", "score", "n", "free", *names])
            out.append(found.filter(pa.array((n >= 0) | far)))
        return pa.concat_tables(out)

    schema = f"case_id {kind}, score bigint, n int, free binary, {', '.join(f'{c} double' for c in names)}"
    to = [tiles.tile(occ.cell(F.col(c), g.voxel), side).alias(f"t{c}") for c in "xy"]
    scene = solid.unionByName(blocked.select("ix", "iy", F.lit(None).cast("int").alias("iz")).distinct())
    first = materialize(tiles.answered(cases.select("case_id", *names, *to), scene, side, answer, schema), "hiding-places")
    legs = F.ceil(F.sqrt((F.col("x") - F.col("dx")) ** 2 + (F.col("y") - F.col("dy")) ** 2) / (0.5 * side * g.voxel))
    along = lambda k, c: tiles.tile(occ.cell(F.col(f"d{c}") + (F.col(c) - F.col(f"d{c}")) * (k / legs), g.voxel), side).alias(f"t{c}")
    way = F.array_distinct(F.transform(F.sequence(F.lit(0), legs.cast("int")), lambda k: F.struct(along(k, "x"), along(k, "y"))))
    far = first.where("free is not null").withColumn("t", F.explode(way)).select("case_id", *names, "free", "t.tx", "t.ty")
    found = first.where("n >= 0").select("case_id", "score", "n").unionByName(tiles.answered(far, solid, side, answer, schema).select("case_id", "score", "n"))
    best = found.groupBy("case_id").agg(F.max(F.struct("score", (-F.col("n")).alias("o"))).alias("c"))
    return best.select("case_id", (-F.col("c.o")).alias("candidate"), F.col("c.score").alias("score_e6"))


def start_gates(corridors: DataFrame, starts: DataFrame, columns: DataFrame, least: tuple[int, int] = (3, 4), steep: float = 1.5) -> DataFrame:
    """Why a start can't be used, tested in order: no place, blocked, too narrow, too short ahead, steep ground; ok
    otherwise. corridors: the best heading of each start (start_id, forward, width)."""
    ground = columns.where("ground_z is not null").select("ix", "iy", "ground_z")
    around = starts.select("start_id", "ix", "iy", F.explode(occ.square(1)).alias("o")).select("start_id", (F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"))
    slope = around.join(ground, ["ix", "iy"]).groupBy("start_id").agg((F.max("ground_z") - F.min("ground_z")).alias("slope"))
    own = starts.join(columns.select("ix", "iy", "is_building"), ["ix", "iy"], "left").select("start_id", "ix", "is_building")
    all_ = own.join(corridors.select("start_id", "forward", "width", "score"), "start_id", "left").join(slope, "start_id", "left")
    reason = (
        F.when(F.col("ix").isNull(), "no_place")
        .when(F.coalesce("is_building", F.lit(False)), "not_drivable")
        .when(F.coalesce("width", F.lit(0)) < least[0], "too_narrow")
        .when(F.coalesce("forward", F.lit(0)) < least[1], "short_forward")
        .when(F.coalesce("slope", F.lit(0.0)) > steep, "steep_ground")
        .otherwise("ok")
    )
    return all_.select("start_id", reason.alias("reason"), F.when(reason == "ok", F.col("score") - 3 * F.coalesce("slope", F.lit(0.0))).alias("score"))


def wall_probe(starts: DataFrame, blocked: DataFrame, reach: int = 2) -> DataFrame:
    """start_id, walls (which of eight directions meet a blocked cell within reach, as a bit mask), adjacent."""
    free = occ.free_runs(starts, blocked, 8, reach)
    bit = F.when(F.col("free") < reach, F.expr("shiftleft(1, heading)")).otherwise(0)
    return free.groupBy("start_id").agg(F.sum(bit).cast("int").alias("walls")).withColumn("adjacent", F.col("walls") > 0)


def alley_corridors(pairs: DataFrame, sites: DataFrame, blocked: DataFrame, g: occ.Grid, gap: tuple[float, float] = (10.0, 36.0)) -> DataFrame:
    """site_a, site_b, width, score of gaps between two buildings whose midpoint is free: narrow ones score higher."""
    p = lambda n: sites.select(F.col("site_id").alias(f"site_{n}"), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
    mid = pairs.where(F.col("gap").between(*gap)).join(p("a"), "site_a").join(p("b"), "site_b")
    mid = mid.withColumn("ix", occ.cell((F.col("ax") + F.col("bx")) / 2, g.voxel)).withColumn("iy", occ.cell((F.col("ay") + F.col("by")) / 2, g.voxel))
    free = mid.join(blocked.select("ix", "iy").distinct(), ["ix", "iy"], "left_anti")
    return free.select("site_a", "site_b", F.col("gap").alias("width"), (4.0 * F.greatest(F.lit(0.0), gap[1] - F.col("gap"))).alias("score"))


def lifted(points: DataFrame, voxel_set: DataFrame, g: occ.Grid, lifts: tuple[int, ...] = (0, 1, 2, 3, 5)) -> DataFrame:
    """point_id, lift: the first of the lifts (in voxels) at which the point's voxel and the four around it are free; null
    if none is, or if the point has no voxel."""
    points = points.withColumns({f"_i{c}": occ.cell(F.col(c), g.voxel) for c in "xyz"})
    placed = points.dropna(subset=["_ix", "_iy", "_iz"])
    probes = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    offsets = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, n in enumerate(lifts) for i, j in probes])
    spread = placed.withColumn("o", F.explode(offsets)).select("point_id", F.col("o.k").alias("k"), (F.col("_ix") + F.col("o.i")).alias("ix"), (F.col("_iy") + F.col("o.j")).alias("iy"), (F.col("_iz") + F.col("o.n")).alias("iz"))
    taken = spread.join(voxel_set, ["ix", "iy", "iz"], "left_semi").select("point_id", "k").distinct()
    every = placed.select("point_id", F.explode(F.sequence(F.lit(0), F.lit(len(lifts) - 1))).alias("k"))
    free = every.join(taken, ["point_id", "k"], "left_anti").groupBy("point_id").agg(F.min("k").alias("k"))
    return points.select("point_id").join(free, "point_id", "left").select("point_id", F.try_element_at(F.array(*[F.lit(n) for n in lifts]), F.col("k") + 1).alias("lift"))
