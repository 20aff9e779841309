"""Lines of sight with raised ends, annotated buildings, hiding from several drones, sideways room, penalties, gates of a
start, and height fields.

As in occupancy: everything is keyed by cells, so each question becomes exploded offsets, an equi-join and one
aggregation; places on rings around anchors are looked up tile by tile instead. Rays longer than `reach` are not sampled;
their answer is null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.geo import wrap_to_pi
from skylattice.operators import occupancy as occ
from skylattice.operators import tiles
from skylattice.session import materialize

#: Metres. Height of an eye, of a target above its ground, and the least height of a target above the map.
EYE, AGL, LEAST_END = 12.0, 1.0, 0.5


def length3() -> Column:
    return F.sqrt(sum(((F.col(f"b{c}") - F.col(f"a{c}")) ** 2 for c in "xyz"), F.lit(0.0)))


def raised(rays: DataFrame, columns: DataFrame, g: occ.Grid, eye: float = EYE, agl: Column | float = AGL) -> DataFrame:
    """Rays whose eye is at least `eye` high and whose target stands `agl` above its local ground (the map's elevation
    where none is known). Null ends stay null."""
    ground = columns.select(F.col("ix").alias("_tx"), F.col("iy").alias("_ty"), "ground_z")
    placed = rays.withColumn("_tx", occ.cell(F.col("bx"), g.voxel)).withColumn("_ty", occ.cell(F.col("by"), g.voxel)).join(ground, ["_tx", "_ty"], "left")
    az = F.when(F.col("az").isNotNull(), F.greatest(F.col("az"), F.lit(eye)))
    bz = F.greatest(F.coalesce("ground_z", F.lit(g.elevation)) + agl, F.lit(g.elevation + LEAST_END))
    return placed.withColumns({"az": az, "bz": bz}).select(*rays.columns)


def sight(rays: DataFrame, voxel_set: DataFrame, flags: DataFrame, columns: DataFrame, g: occ.Grid, largest: bool = False, reach: float | None = None, agl: Column | float = AGL) -> DataFrame:
    """ray_id, blocked, first_t, ahead (horizontal metres from the first hit to the target) along raised rays. A ray
    shorter than half a voxel is clear."""
    r = raised(rays, columns, g, agl=agl)
    short = length3() < g.voxel * 0.5
    hit = occ.line_of_sight(r, voxel_set, flags, g, largest, reach)
    flat = F.sqrt((F.col("bx") - F.col("ax")) ** 2 + (F.col("by") - F.col("ay")) ** 2)
    both = r.select("ray_id", short.alias("short"), flat.alias("flat")).join(hit, "ray_id")
    clear = F.coalesce("short", F.lit(False))
    first = F.when(~clear, F.col("first_t"))
    return both.select("ray_id", F.when(clear & F.col("blocked").isNotNull(), F.lit(False)).otherwise(F.col("blocked")).alias("blocked"), first.alias("first_t"), ((1 - first) * F.col("flat")).alias("ahead"))


def between(seen: DataFrame, near: float = 12.0, least: float = 0.08, most: float = 0.92) -> DataFrame:
    """ray_id, between: whether the first hit lies properly between both ends and near the target; null where unknown."""
    good = F.col("first_t").between(least, most) & (F.col("ahead") <= near)
    return seen.select("ray_id", F.when(F.col("blocked").isNotNull(), F.coalesce(good, F.lit(False))).alias("between"))


def annotated_sight(rays: DataFrame, buildings: DataFrame, radius: float = 10.0, least: float = 8.0, ground: float = 0.0, near: float = 14.0, reach: float | None = None) -> DataFrame:
    """ray_id, blocked, between: whether the ray enters the column of an annotated building (building_id, x, y, height),
    and, if so, whether one stands near the target. Buildings enter the nine cells around their own, cells being as large
    as their columns, and meet the samples there; nothing is broadcast."""
    r = rays.withColumn("az", F.when(F.col("az").isNotNull(), F.greatest(F.col("az"), F.lit(EYE)))).withColumn("bz", F.greatest(F.col("bz"), F.lit(ground + AGL)))
    inside = occ.within(reach) & (length3() >= 0.5)
    steps = F.greatest(F.lit(6), F.floor(length3() / 1.5).cast("int"))
    on = r.where(inside).withColumn("steps", steps).withColumn("t", F.explode(F.transform(F.sequence(F.lit(1), F.col("steps") - 1), lambda i: i / F.col("steps"))))
    for c in "xyz":
        on = on.withColumn(c, F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * F.col("t"))
    on = on.where(F.col("z") >= ground + 0.5).select("ray_id", "x", "y", "z", occ.cell(F.col("x"), radius).alias("cx"), occ.cell(F.col("y"), radius).alias("cy"))
    spread = buildings.withColumn("o", F.explode(occ.square(1))).select("height", F.col("x").alias("px"), F.col("y").alias("py"), (occ.cell(F.col("x"), radius) + F.col("o.dx")).alias("cx"), (occ.cell(F.col("y"), radius) + F.col("o.dy")).alias("cy"))
    far = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2)
    hit = on.join(spread, ["cx", "cy"]).where((F.col("z") <= F.greatest(F.lit(least), F.col("height"))) & (far <= radius)).select("ray_id").distinct().withColumn("hit", F.lit(True))
    beside = occ.nearest(rays.select(F.col("ray_id").alias("point_id"), F.col("bx").alias("x"), F.col("by").alias("y")), buildings.withColumnRenamed("building_id", "site_id"), radius + near).select(F.col("point_id").alias("ray_id"), F.lit(True).alias("beside"))
    out = r.select("ray_id", occ.within(reach).alias("known")).join(hit, "ray_id", "left").join(beside, "ray_id", "left")
    blocked = F.when(F.col("known"), F.coalesce("hit", F.lit(False)))
    return out.select("ray_id", blocked.alias("blocked"), (blocked & F.coalesce("beside", F.lit(False))).alias("between"))


def chase_pose(x: Column, y: Column, z: Column, heading: Column, distance: float = 12.0) -> tuple[Column, Column, Column]:
    """Map place of a nominal chaser: behind the target, EYE above it."""
    return x - distance * F.cos(heading), y - distance * F.sin(heading), z + EYE


def hidden_from_all(cases: DataFrame, drones: DataFrame, voxel_set: DataFrame, flags: DataFrame, columns: DataFrame, g: occ.Grid, hfov: float = math.radians(50.0), reach: float = 100.0) -> DataFrame:
    """case_id, hidden, drones: from how many of its drones (case_id, drone_no, x, y, z, yaw) the target (case_id, x, y, z)
    is out of range, out of view or behind something; it is hidden from all where both are equal. Only drones that have
    it in range and view need a ray."""
    d = drones.select("case_id", "drone_no", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"), "yaw")
    r = d.join(cases.select("case_id", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz")), "case_id")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    seen = (F.sqrt(dx * dx + dy * dy) <= reach) & (F.abs(wrap_to_pi(F.atan2(dy, dx) - F.col("yaw"))) <= hfov)
    r = r.withColumn("seen", F.coalesce(seen, F.lit(False))).withColumn("ray_id", F.struct("case_id", "drone_no"))
    rays = r.where("seen").select("ray_id", "ax", "ay", "az", "bx", "by", "bz")
    blocked = sight(rays, voxel_set, flags, columns, g, agl=F.greatest(F.lit(0.5), F.col("bz"))).where("blocked").select("ray_id")
    behind = r.where("seen").select("ray_id", "case_id").join(blocked, "ray_id").groupBy("case_id").agg(F.count(F.lit(1)).alias("behind"))
    total = r.groupBy("case_id").agg(F.count(F.lit(1)).alias("drones"), F.count_if(~F.col("seen")).alias("away"))
    return total.join(behind, "case_id", "left").select("case_id", (F.col("away") + F.coalesce("behind", F.lit(0))).alias("hidden"), "drones")


def sideways_room(points: DataFrame, blocked: DataFrame, g: occ.Grid, most: float = 16.0, step: float = 2.0) -> DataFrame:
    """point_id, room, bonus: metres that are free to both sides along x, in steps, and the bonus of a narrow place."""
    n = int(most / step)
    moves = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(k).alias("k"), F.lit(float(s * k * step)).alias("dx")) for s in (-1, 1) for k in range(1, n + 1)])
    on = points.select("point_id", "x", "y", F.explode(moves).alias("o")).select("point_id", "o.side", "o.k", occ.cell(F.col("x") + F.col("o.dx"), g.voxel).alias("ix"), occ.cell(F.col("y"), g.voxel).alias("iy"))
    wall = on.join(blocked.select("ix", "iy").distinct(), ["ix", "iy"], "left_semi").groupBy("point_id", "side").agg(F.min("k").alias("k"))
    lost = wall.groupBy("point_id").agg(F.sum(n - (F.col("k") - 1)).alias("lost"))
    room = (2 * n - F.coalesce("lost", F.lit(0))) * step
    return points.select("point_id").join(lost, "point_id", "left").select("point_id", room.alias("room"), (1.5 * F.greatest(F.lit(0.0), 12.0 - room)).alias("bonus"))


def edge_penalty(points: DataFrame, blocked: DataFrame, g: occ.Grid, margin: float = 1.0) -> DataFrame:
    """point_id, penalty: how many of the four places `margin` away are blocked."""
    sides = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((margin, 0.0), (-margin, 0.0), (0.0, margin), (0.0, -margin))])
    on = points.select("point_id", "x", "y", F.explode(sides).alias("o")).select("point_id", occ.cell(F.col("x") + F.col("o.dx"), g.voxel).alias("ix"), occ.cell(F.col("y") + F.col("o.dy"), g.voxel).alias("iy"))
    hits = on.join(blocked.select("ix", "iy").distinct(), ["ix", "iy"], "left_semi").groupBy("point_id").agg(F.count(F.lit(1)).alias("penalty"))
    return points.select("point_id").join(hits, "point_id", "left").select("point_id", F.coalesce("penalty", F.lit(0)).alias("penalty"))


def lateral_penalty(segments: DataFrame, blocked: DataFrame, g: occ.Grid, half: float = 0.9, step: float = 1.0, reach: float = 100.0) -> DataFrame:
    """segment_id, penalty: how many places, half a car's width to either side along a segment (ax, ay, bx, by), are
    blocked; null for segments beyond reach."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    far = F.sqrt(dx * dx + dy * dy)
    s = segments.withColumn("far", far).withColumn("n", F.when((far >= 1e-6) & (far <= reach), F.greatest(F.lit(2), F.ceil(far / step).cast("int"))))
    on = s.where("n is not null").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("side", F.explode(F.array(F.lit(half), F.lit(-half))))
    t = F.col("i") / F.col("n")
    x, y = F.col("ax") + dx * t - dy / F.col("far") * F.col("side"), F.col("ay") + dy * t + dx / F.col("far") * F.col("side")
    hits = on.select("segment_id", occ.cell(x, g.voxel).alias("ix"), occ.cell(y, g.voxel).alias("iy")).join(blocked.select("ix", "iy").distinct(), ["ix", "iy"], "left_semi").groupBy("segment_id").agg(F.count(F.lit(1)).alias("penalty"))
    known = F.coalesce(far <= reach, F.lit(False))
    return segments.select("segment_id", known.alias("known")).join(hits, "segment_id", "left").select("segment_id", F.when(F.col("known"), F.coalesce("penalty", F.lit(0))).alias("penalty"))


def anchor_heading(headings: DataFrame, hints: DataFrame, count: int = 8, pull: float = 1.5) -> DataFrame:
    """start_id, heading, score: of a start's headings (start_id, heading, score) the best one, those away from its hint
    (start_id, hint in radians) less liked. Ties go to the smaller number."""
    turn = F.abs(wrap_to_pi(F.col("heading") * (2 * math.pi / count) - F.col("hint")))
    scored = headings.join(hints, "start_id").select("start_id", F.struct(F.round(F.col("score") - pull * turn, 6).alias("s"), (-F.col("heading")).alias("h")).alias("c"))
    return scored.groupBy("start_id").agg(F.max("c").alias("c")).select("start_id", (-F.col("c.h")).alias("heading"), F.col("c.s").alias("score"))


#: Limits of the gates in metres. Width, way ahead, way ahead and back, way that can be driven, slope,
#: clearance, and the least road score of the relaxed form.
STRICT = {"width": 10.0, "ahead": 18.0, "open": 30.0, "drive": 8.0, "slope": 1.2, "clearance": 5.5}
RELAXED = {"width": 6.0, "open": 24.0, "drive": 6.0, "clearance": 3.0, "score": 14.0}


def init_gates(starts: DataFrame, corridors: DataFrame, columns: DataFrame, g: occ.Grid, shift: float = 0.0, relaxed: bool = False) -> DataFrame:
    """start_id, reason, score: the first gate that a start (start_id, x, y, anchor_x, anchor_y) fails, or ok with a score.
    corridors: its best heading with forward, back and width in cells, and the road score. With relaxed, the anchor, the
    way ahead alone and the slope don't count, and the road score must be high enough."""
    limit = RELAXED if relaxed else STRICT
    at = starts.withColumn("ix", occ.cell(F.col("x"), g.voxel)).withColumn("iy", occ.cell(F.col("y"), g.voxel))
    ground = columns.select("ix", "iy", F.coalesce("ground_z", F.lit(g.elevation)).alias("ground"), F.coalesce("roof_z", F.lit(g.elevation)).alias("roof"), "is_building")
    around = at.select("start_id", F.explode(occ.square(1)).alias("o"), "ix", "iy").select("start_id", (F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"))
    level = around.join(ground.select("ix", "iy", "ground"), ["ix", "iy"], "left").fillna(g.elevation, ["ground"]).groupBy("start_id").agg((F.max("ground") - F.min("ground")).alias("slope"))
    own = at.join(ground.select("ix", "iy", "is_building", (F.col("roof") - F.col("ground")).alias("clearance")), ["ix", "iy"], "left")
    c = own.join(corridors.select("start_id", "forward", "back", F.col("width").alias("cells"), F.col("score").alias("road")), "start_id", "left").join(level, "start_id", "left")
    metres = lambda n: F.coalesce(n, F.lit(0)) * g.voxel
    width, ahead, open_ = metres("cells"), metres("forward"), metres("forward") + metres("back")
    drive, slope, clearance = F.least(ahead, F.lit(12.0)), F.coalesce("slope", F.lit(0.0)), F.coalesce("clearance", F.lit(0.0))
    moved = F.sqrt((F.col("x") - F.col("anchor_x")) ** 2 + (F.col("y") - F.col("anchor_y")) ** 2)
    rail = (clearance > 0.5) & (clearance < limit["clearance"])
    reason = F.when(F.col("ix").isNull() | F.col("iy").isNull(), "nan_pose")
    if not relaxed and shift > 0:
        reason = reason.when(moved > shift, "shift_too_far")
    reason = reason.when(F.coalesce("is_building", F.lit(False)), "not_drivable").when(width < limit["width"], "too_narrow")
    if not relaxed:
        reason = reason.when(ahead < limit["ahead"], "short_forward")
    reason = reason.when(open_ < limit["open"], "closed_island").when(drive < limit["drive"], "not_drivable_forward")
    if not relaxed:
        reason = reason.when(slope > limit["slope"], "steep_ground")
    reason = reason.when(rail, "on_rail_or_curb")
    road = F.coalesce("road", F.lit(0.0))
    if relaxed:
        reason = reason.when(road < limit["score"], "low_road_score").otherwise("road_seed_ok")
        return c.select("start_id", reason.alias("reason"), F.when(reason == "road_seed_ok", road).alias("score"))
    reason = reason.otherwise("ok")
    score = road + 0.4 * width + 0.15 * F.least(ahead, F.lit(60.0)) + 0.05 * drive - 3.0 * slope - 0.04 * F.greatest(F.lit(0.0), F.coalesce(moved, F.lit(0.0)) - 80.0)
    return c.select("start_id", reason.alias("reason"), F.when(reason == "ok", score).alias("score"))


def rings(radius: float, step: float, least: int) -> list[tuple[int, float, float]]:
    """(number, dx, dy) of the centre and of places on rings `step` apart, at least `least` on each, inner ones first."""
    out, r = [(0, 0.0, 0.0)], step
    while r <= radius + 1e-6:
        n = max(least, int(2 * math.pi * r / step))
        out += [(len(out) + k, r * math.cos(2 * math.pi * k / n), r * math.sin(2 * math.pi * k / n)) for k in range(n)]
        r += step
    return out


def roads(walls: np.ndarray, headings: int, reach: int) -> tuple[np.ndarray, ...]:
    """heading, forward, back, width and road score of the best heading of each cell of a grid, as occupancy.free_runs and
    occupancy.corridor have them. Beyond the grid all is free."""
    n, q = len(walls), headings // 4
    padded = np.pad(walls, reach)
    free = np.full((headings, n, n), reach)
    for h in range(headings):
        for s in range(reach, 0, -1):
            dx, dy = reach + round(s * math.cos(2 * math.pi * h / headings)), reach + round(s * math.sin(2 * math.pi * h / headings))
            free[h][padded[dx : dx + n, dy : dy + n]] = s - 1
    at = lambda k: np.roll(free, -k, axis=0)
    back, width = at(headings // 2), at(q) + at(3 * q) + 1
    score = free + 0.25 * back + 2.0 * width
    best = score.argmax(axis=0)
    return best, *(np.take_along_axis(c, best[None], axis=0)[0] for c in (free, back, width, score))


def anchored(anchors: DataFrame, g: occ.Grid, side: int) -> tuple[DataFrame, DataFrame]:
    """anchor_id, x, y with their tile, and those without a cell."""
    a = anchors.select("anchor_id", "x", "y", *[tiles.tile(occ.cell(F.col(c), g.voxel), side).alias(f"t{c}") for c in "xy"])
    a = materialize(a, "anchors")
    return a.dropna(subset=["tx", "ty"]), a.where("tx is null or ty is null")


def spots(part: pa.Table, offsets: np.ndarray, corner: tuple[int, int], voxel: float) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Cells in the grid from corner on, and distance, of every place around each anchor [anchor, place]."""
    own = [c[:, None] for c in tiles.numbers(part, "x", "y")]
    place = [c + o for c, o in zip(own, offsets)]
    return tuple(np.floor(p / voxel).astype(np.int64) - o for p, o in zip(place, corner)), np.sqrt((place[0] - own[0]) ** 2 + (place[1] - own[1]) ** 2)


def road_seeds(anchors: DataFrame, blocked: DataFrame, g: occ.Grid, radius: float = 180.0, step: float = 12.0, headings: int = 8, reach: int = 12) -> DataFrame:
    """anchor_id, n, heading, score: of the free places on rings around each anchor the one, with its heading, that looks
    most like a major road, near ones preferred. Ties go to the inner place and the smaller heading. Rings start at the
    x axis: no jitter is drawn. Anchors meet the blocked cells of their tile, where every cell's road is found once."""
    offsets = np.array([(dx, dy) for _, dx, dy in rings(radius, step, 12)]).T
    side = max(32, math.ceil(radius / g.voxel) + reach + 2)

    def answer(questions: pa.Table, cells: pa.Table, corner: tuple[int, int]) -> pa.Table:
        walls = tiles.on_grid(cells, corner, 3 * side)
        heading, *_, road = roads(walls, headings, reach)
        out = []
        for lo in range(0, questions.num_rows, 512):
            part = questions.slice(lo, 512)
            at, way = spots(part, offsets, corner, g.voxel)
            score = np.where(walls[at], -np.inf, np.rint((road[at] - 0.03 * way) * 1e6))
            n = score.argmax(axis=1)
            row = np.arange(len(n))
            some = np.isfinite(score[row, n])
            found = pa.table([part["anchor_id"], pa.array(n.astype(np.int32)), pa.array(heading[at][row, n].astype(np.int32)), pa.array(score[row, n] / 1e6)], ["anchor_id", "n", "heading", "score"])
            out.append(found.filter(pa.array(some)))
        return pa.concat_tables(out)

    placed, lost = anchored(anchors, g, side)
    found = tiles.answered(placed, blocked.select("ix", "iy").distinct(), side, answer, f"anchor_id {dict(anchors.dtypes)['anchor_id']}, n int, heading int, score double", share=2000)
    # without a cell nothing is blocked: the anchor itself, by its way, which is no number where it has no place
    way = F.sqrt((F.col("x") - F.col("x")) ** 2 + (F.col("y") - F.col("y")) ** 2)
    return found.unionByName(lost.select("anchor_id", F.lit(0).alias("n"), F.lit(0).alias("heading"), F.round(F.lit(reach + 0.25 * reach + 2.0 * (2 * reach + 1)) - 0.03 * way, 6).alias("score")))


def good_starts(ground: np.ndarray, clearance: np.ndarray, walls: np.ndarray, g: occ.Grid, is_building: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which cells of a grid pass the strict gates of init_gates, without the anchor's, and their score."""
    _, forward, back, cells, road = roads(walls, 8, 12)
    n = len(ground)
    padded = np.pad(ground, 1, constant_values=g.elevation)
    near = np.stack([padded[i : i + n, j : j + n] for i in range(3) for j in range(3)])
    slope = near.max(axis=0) - near.min(axis=0)
    width, ahead, open_ = cells * g.voxel, forward * g.voxel, forward * g.voxel + back * g.voxel
    drive = np.minimum(ahead, 12.0)
    rail = (clearance > 0.5) & (clearance < STRICT["clearance"])
    good = ~is_building & ~rail & (width >= STRICT["width"]) & (ahead >= STRICT["ahead"]) & (open_ >= STRICT["open"]) & (drive >= STRICT["drive"]) & (slope <= STRICT["slope"])
    return good, road + 0.4 * width + 0.15 * np.minimum(ahead, 60.0) + 0.05 * drive - 3.0 * slope


def spiral_starts(anchors: DataFrame, blocked: DataFrame, columns: DataFrame, g: occ.Grid, radius: float = 32.0, step: float = 4.0) -> DataFrame:
    """anchor_id, n, score: the first place of a spiral around each anchor that passes all gates of a start; without one n
    is 0, the anchor itself, and the score null. Anchors meet the columns of their tile, where every cell is judged once."""
    offsets = np.array([(dx, dy) for _, dx, dy in rings(radius, step, 8)]).T
    side = max(32, math.ceil(radius / g.voxel) + 14)
    wide = 3 * side

    def answer(questions: pa.Table, cells: pa.Table, corner: tuple[int, int]) -> pa.Table:
        is_column = cells["ground"].is_valid()
        own = cells.filter(is_column)
        walls = tiles.on_grid(cells.filter(pc.invert(is_column)), corner, wide)
        ground, roof, is_building = tiles.numbers(own, "ground", "roof", "is_building")
        on = lambda values, empty: tiles.on_grid(own, corner, wide, values, empty)
        good, judged = good_starts(on(ground, g.elevation), on(roof - ground, 0.0), walls, g, on(is_building > 0, False))
        out = []
        for lo in range(0, questions.num_rows, 2048):
            part = questions.slice(lo, 2048)
            at, moved = spots(part, offsets, corner, g.voxel)
            ok = good[at]
            n = ok.argmax(axis=1)
            row = np.arange(len(n))
            score = judged[at][row, n] - 0.04 * np.maximum(0.0, moved[row, n] - 80.0)
            out.append(pa.table([part["anchor_id"], pa.array(n.astype(np.int32)), pa.array(score, mask=~ok[row, n])], ["anchor_id", "n", "score"]))
        return pa.concat_tables(out)

    level = lambda c: F.coalesce(c, F.lit(g.elevation)).cast("double")
    walls = blocked.select("ix", "iy").distinct().withColumns({"ground": F.lit(None).cast("double"), "roof": F.lit(None).cast("double"), "is_building": F.lit(None).cast("boolean")})
    scene = columns.select("ix", "iy", level("ground_z").alias("ground"), level("roof_z").alias("roof"), F.coalesce("is_building", F.lit(False)).alias("is_building")).unionByName(walls)
    placed, lost = anchored(anchors, g, side)
    found = tiles.answered(placed, scene, side, answer, f"anchor_id {dict(anchors.dtypes)['anchor_id']}, n int, score double", share=5000)
    return found.unionByName(lost.select("anchor_id", F.lit(0).alias("n"), F.lit(None).cast("double").alias("score")))


def street_headings(free: DataFrame, hints: DataFrame, cell: float, short: float = 3.0) -> DataFrame:
    """start_id, heading: of a start's headings (start_id, heading, free cells ahead) the one with the longest free way, ties
    to the smaller number; where even that is shorter than `short` metres, the hint (start_id, hint number)."""
    best = free.groupBy("start_id").agg(F.max(F.struct("free", (-F.col("heading")).alias("h"))).alias("b"))
    both = best.join(hints, "start_id", "left")
    return both.select("start_id", F.when((F.col("b.free") * cell < short) & F.col("hint").isNotNull(), F.col("hint")).otherwise(-F.col("b.h")).cast("int").alias("heading"), (F.col("b.free") * cell).alias("ahead"))


def street_risk(blocked: DataFrame, g: occ.Grid, decay: float = 9.0, alley: float = 9.0, branch: float = 13.0, near: float = 26.0, weights: tuple[float, float, float] = (0.78, 0.70, 0.58)) -> DataFrame:
    """ix, iy, edge, alley, crossing, risk of the free cells near blocked ones: how near a wall is; how many of four axes
    have walls at both ends; how many of eight ways out are free. Cells beyond `near` of any wall have no risk and no row.
    Every cell asks about a fixed set of offsets, so the field is one equi-join and one aggregation."""
    at = lambda m: max(1, round(m / g.voxel))
    disc, p, q, reach = int(decay / g.voxel), at(alley), at(branch), at(near)
    walls = blocked.select("ix", "iy").distinct()
    cells = walls.select("ix", "iy", F.explode(occ.square(reach)).alias("o")).select((F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy")).distinct().join(walls, ["ix", "iy"], "left_anti")
    near_ = [("d", math.hypot(i, j) * g.voxel, i, j) for i in range(-disc, disc + 1) for j in range(-disc, disc + 1) if 0 < i * i + j * j <= (decay / g.voxel) ** 2]
    ends = [(f"{k}{side}", 0.0, side * i * p, side * j * p) for k, (i, j) in enumerate(((1, 0), (0, 1), (1, 1), (1, -1))) for side in (1, -1)]
    ring = [("r", 0.0, i * q, j * q) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    asks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("m"), F.lit(i).alias("dx"), F.lit(j).alias("dy")) for k, m, i, j in near_ + ends + ring])
    asked = cells.select(F.col("ix").alias("cx"), F.col("iy").alias("cy"), F.explode(asks).alias("a")).select("cx", "cy", "a.k", "a.m", (F.col("cx") + F.col("a.dx")).alias("ix"), (F.col("cy") + F.col("a.dy")).alias("iy"))
    hits = asked.join(walls, ["ix", "iy"], "left_semi").groupBy("cx", "cy").agg(F.min(F.when(F.col("k") == "d", F.col("m"))).alias("d"), F.count_if(F.col("k") == "r").alias("shut"), F.collect_set(F.when(~F.col("k").isin("d", "r"), F.col("k"))).alias("ends"))
    on = cells.join(hits.select(F.col("cx").alias("ix"), F.col("cy").alias("iy"), "d", "shut", "ends"), ["ix", "iy"], "left")
    has = lambda k: F.coalesce(F.array_contains("ends", k), F.lit(False))
    flanks = sum(((has(f"{k}1") & has(f"{k}-1")).cast("int") for k in range(4)), F.lit(0))
    edge = F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.col("d") / decay), F.lit(0.0))
    narrow = F.least(F.lit(1.0), flanks / 2.0)
    crossing = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (8 - F.coalesce("shut", F.lit(0)) - 3.0) / 4.0))
    out = on.select("ix", "iy", edge.alias("edge"), narrow.alias("alley"), crossing.alias("crossing"))
    return out.withColumn("risk", F.least(F.lit(1.0), F.greatest(weights[1] * F.col("alley"), weights[0] * F.col("edge")) + weights[2] * F.col("crossing")))


# Height fields --------------------------------------------------------------------------------------------------------


def ground_field(points: DataFrame, size: float, least: int = 4, bin_size: float = 1.0, share: float = 0.2, slab: float = 1.0, open_share: float = 0.6, highest: float = 1e9) -> DataFrame:
    """ix, iy, points, floor, roof, open, is_road of each column of at least `least` points.

    The floor is the lower edge of the lowest height bin with at least `share` of the fullest one's points; bins are
    max(4, the middle 98 % of heights / bin_size) equal parts of all heights; where those 98 % are flat it is the median.
    open is the share of points up to `slab` above the floor. Heights count in millimetres, so a column holds a bounded
    number of different ones and is reduced before the shuffle, however many points it has."""
    cell = [occ.cell(F.col(c), size).alias(f"i{c}") for c in "xy"]
    p = points.where(occ.real(F.col("x"), F.col("y"), F.col("z"))).select(*cell, F.floor(F.col("z") * 1000 + 0.5).cast("bigint").alias("mm")).dropna(subset=["ix", "iy"])
    counts = p.groupBy("ix", "iy", "mm").agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("ix", "iy")
    ranked = counts.select("*", F.sum("n").over(of).alias("total"), F.sum("n").over(of.orderBy("mm").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto")).where(F.col("total") >= least)

    def quantile(q: float) -> Column:
        place = F.lit(q) * (F.col("total") - 1)
        low = F.floor(place)
        at = lambda k: F.min(F.when(F.col("upto") > k, F.col("mm"))).over(of)
        a, b = at(low), at(F.least(low + 1, F.col("total") - 1))
        return a + (b - a) * (place - low)

    ranked = ranked.select("ix", "iy", "mm", "n", "total", quantile(0.01).alias("p01"), quantile(0.99).alias("p99"), quantile(0.5).alias("median"), F.min("mm").over(of).alias("lo"), F.max("mm").over(of).alias("hi"))
    bins = F.greatest(F.lit(4), F.floor((F.col("p99") - F.col("p01")) / (1000 * bin_size)).cast("int"))
    binned = ranked.withColumn("bins", bins).withColumn("bin", F.least(F.col("bins") - 1, F.floor(F.try_divide((F.col("mm") - F.col("lo")) * F.col("bins"), F.col("hi") - F.col("lo"))).cast("int")))
    full = binned.withColumn("m", F.sum("n").over(Window.partitionBy("ix", "iy", "bin"))).withColumn("peak", F.max("m").over(of))
    edge = F.min(F.when(F.col("m") >= share * F.col("peak"), F.col("bin"))).over(of)
    floor = F.when(F.col("p99") - F.col("p01") < 1.0, F.col("median")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * edge / F.col("bins"))
    whole = full.select("ix", "iy", "mm", "n", "total", "hi", floor.alias("floor_mm"))
    out = whole.groupBy("ix", "iy").agg(F.first("total").alias("points"), (F.first("floor_mm") / 1000).alias("floor"), (F.max("hi") / 1000).alias("roof"), (F.sum(F.when(F.col("mm") <= F.col("floor_mm") + 1000 * slab, F.col("n")).otherwise(0)) / F.first("total")).alias("open"))
    return out.withColumn("is_road", (F.col("open") >= open_share) & (F.col("floor") <= highest))


def surface_at(points: DataFrame, field: DataFrame, size: float, rings: int = 2) -> DataFrame:
    """point_id, ground, roof: the median floor and the highest roof of the nearest cells that have one: the point's own,
    else those one cell around, else two. At most (2 rings + 1)**2 cells meet a point."""
    spread = points.select("point_id", occ.cell(F.col("x"), size).alias("ix"), occ.cell(F.col("y"), size).alias("iy"), F.explode(occ.square(rings)).alias("o"))
    on = spread.select("point_id", (F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"), F.greatest(F.abs("o.dx"), F.abs("o.dy")).alias("ring"))
    met = on.join(field.select("ix", "iy", "floor", "roof"), ["ix", "iy"]).groupBy("point_id").agg(F.min("ring").alias("least"), F.array_sort(F.collect_list(F.struct("floor", "roof", "ring"))).alias("cells"))
    near = F.filter("cells", lambda c: c["ring"] <= F.col("least"))
    met = met.select("point_id", F.transform(near, lambda c: c["floor"]).alias("floors"), F.array_max(F.transform(near, lambda c: c["roof"])).alias("roof"))
    n = F.size("floors")
    middle = (F.element_at("floors", F.floor((n + 1) / 2).cast("int")) + F.element_at("floors", F.floor((n + 2) / 2).cast("int"))) / 2
    return points.select("point_id").join(met, "point_id", "left").select("point_id", F.when(F.col("floors").isNotNull(), middle).alias("ground"), "roof")
