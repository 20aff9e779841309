"""Viewpoints around a target, judged against the scene over the target's next steps, and a plan of them in time.

Each frame has 12 x 3 x 3 candidate places. A candidate is good if it sees the target now and at its next HORIZON places
(range, field of view and line of sight), bad if it is hidden from them, off the wished distance, or in or close above
something. Rays of a frame stay near it, so the scene is cut into tiles: frames meet the voxels of their tile and of the
eight around it in one shuffle, and the rays are marched in Arrow batches against a small dense grid. Tiles with many
frames are split into parts, each with its own copy of the tile's voxels, whose number is bounded by the tile's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.operators import occupancy as occ
from skylattice.operators.chunks import by_chunk, changes, codes, floats, whole_chunks
from skylattice.operators.sequence import annotate, following
from skylattice.session import materialize

#: Candidates, horizon, view, weights of visibility, occlusion, distance, collision and smoothness.
ANGLES, DISTANCE, ALTITUDE, RADII, HEIGHTS = 12, 12.0, 18.0, (0.8, 1.0, 1.2), (0.85, 1.0, 1.15)
HORIZON, HALF_VIEW, REACH = 4, math.radians(35.0), 100.0
SEEN, HIDDEN, OFF, HIT, MOVED = 1.0, 0.8, 0.3, 1.0, 0.2
#: Metres; a tile must be longer than any ray and candidate reach together. Frames of a tile that one task handles.
TILE, SHARE = 128.0, 50_000

#: x, y (map), altitude and radius of the candidates, in order.
PLACES = np.array([(r * DISTANCE * math.cos(a), -r * DISTANCE * math.sin(a), h * ALTITUDE, r * DISTANCE) for a in (-math.pi + 2 * math.pi * i / ANGLES for i in range(ANGLES)) for r in RADII for h in HEIGHTS])
EYES = (ALTITUDE, HEIGHTS[2] * ALTITUDE)
#: What a candidate's distance costs, and how near to a roof or in something it is by collision code.
FAR = OFF * np.minimum(1.0, np.abs(PLACES[:, 3] - DISTANCE) / DISTANCE)
COLLISION = np.array([0.0, 0.7, 1.0]) * HIT
#: Yaw from a candidate towards the target, and the cost of turning from one candidate's yaw to another's.
YAWS = np.arctan2(-PLACES[:, 1], -PLACES[:, 0])
TURNS = MOVED * 0.3 * np.abs((YAWS[:, None] - YAWS[None, :] + math.pi) % (2 * math.pi) - math.pi) / math.pi


def base_scores(judgements: np.ndarray) -> np.ndarray:
    """Scores of candidates from their codes: seen + 6 hidden + 36 collision, both counts of the horizon's places."""
    seen, hidden, hit = judgements % 6, judgements // 6 % 6, judgements // 36
    return SEEN * seen / (HORIZON + 1) - HIDDEN * hidden / (HORIZON + 1) - FAR - COLLISION[hit]


def ray_blocked(a: np.ndarray, b: np.ndarray, solid: np.ndarray, origin: np.ndarray, voxel: float) -> np.ndarray:
    """Which of the rays a -> b [n, 3] pass through a solid cell of the grid. Rays beyond REACH or shorter than half a
    cell are not blocked."""
    way = b - a
    length = np.sqrt((way**2).sum(axis=1))
    steps = np.maximum(4, (length / voxel).astype(np.int64))
    blocked = np.zeros(len(a), dtype=bool)
    live = np.flatnonzero((length <= REACH) & (length >= voxel * 0.5))
    step = 1
    while len(live):
        at = np.floor((a[live] + way[live] * (step / steps[live])[:, None]) / voxel).astype(np.int64) - origin
        inside = ((at >= 0) & (at < solid.shape)).all(axis=1)
        hit = np.zeros(len(live), dtype=bool)
        hit[inside] = solid[tuple(at[inside].T)]
        blocked[live[hit]] = True
        step += 1
        live = live[~hit & (step < steps[live])]
    return blocked


def judge(path: np.ndarray, solid: np.ndarray, taken: np.ndarray, roof: np.ndarray, origin: np.ndarray, voxel: float) -> np.ndarray:
    """Codes [frame, candidate] of frames whose target goes along path [frame, horizon + 1, 3]."""
    n, steps = path.shape[:2]
    flat = PLACES.reshape(ANGLES * len(RADII), len(HEIGHTS), 4)[:, 0, :2]
    spots = path[:, 0, None, :2] + flat[None]
    way = path[:, None, :, :2] - spots[:, :, None, :]
    ahead = path[:, None, 0, :2] - spots
    turn = np.arctan2(way[..., 1], way[..., 0]) - np.arctan2(ahead[..., 1], ahead[..., 0])[..., None]
    view = (np.sqrt((way**2).sum(axis=-1)) <= REACH) & (np.abs((turn + math.pi) % (2 * math.pi) - math.pi) <= HALF_VIEW)
    seen, hidden = [], []
    for eye in EYES:
        a = np.empty((*way.shape[:3], 3))
        a[..., :2], a[..., 2] = spots[:, :, None, :], eye
        b = np.broadcast_to(path[:, None], a.shape)
        blocked = ray_blocked(a.reshape(-1, 3), b.reshape(-1, 3), solid, origin, voxel).reshape(view.shape)
        seen.append((view & ~blocked).sum(axis=2))
        hidden.append(blocked.sum(axis=2))
    eyes = [0, 0, 1]
    place = path[:, None, 0, :2] + PLACES[None, :, :2]
    at = np.floor(np.concatenate([place, np.broadcast_to(PLACES[None, :, 2:3], (*place.shape[:2], 1))], axis=2) / voxel).astype(np.int64) - origin
    inside = ((at >= 0) & (at < taken.shape)).all(axis=2)
    at[~inside] = 0
    into = inside & taken[at[..., 0], at[..., 1], at[..., 2]]
    skims = inside & (PLACES[None, :, 2] < roof[at[..., 0], at[..., 1]] + 1.0)
    hit = np.where(into, 2, np.where(skims, 1, 0))
    both = [np.stack([x[k] for k in eyes], axis=2).reshape(n, len(PLACES)) for x in (seen, hidden)]
    return (both[0] + 6 * both[1] + 36 * hit).astype(np.uint8)


def judged(frames: DataFrame, voxel_set: DataFrame, flags: DataFrame, g: occ.Grid) -> DataFrame:
    """episode_id, frame_idx, x, y (map) and judgements (one byte per candidate) of each frame with a target place that a
    reading can have. frames: distinct, with target_x, target_y, target_z in NED; without z the target is half a metre
    high. flags: the columns with blocks, roof_z and ground_z. At an episode's end its last place repeats."""
    f = frames.where(occ.real(F.col("target_x"), F.col("target_y"))).select("episode_id", "frame_idx", F.col("target_x").alias("x"), (-F.col("target_y")).alias("y"), F.greatest(F.lit(0.5), F.coalesce(-F.col("target_z"), F.lit(0.5))).alias("agl"))
    f = f.withColumn("ix", occ.cell(F.col("x"), g.voxel)).withColumn("iy", occ.cell(F.col("y"), g.voxel)).join(flags.select("ix", "iy", "ground_z"), ["ix", "iy"], "left")
    f = f.select("episode_id", "frame_idx", "x", "y", F.greatest(F.coalesce("ground_z", F.lit(g.elevation)) + F.col("agl"), F.lit(g.elevation + 0.5)).alias("z"))
    f = following(f, "episode_id", "frame_idx", F.struct("x", "y", "z"), HORIZON, "next")
    way = F.concat(F.array(F.struct("x", "y", "z")), F.col("next"))
    tile = [F.floor(F.col(c) / TILE).cast("int").alias(f"t{c}") for c in "xy"]
    f = f.select("episode_id", "frame_idx", "x", "y", *tile, way.alias("way"))
    whole = F.transform(F.sequence(F.lit(1), F.lit(HORIZON + 1)), lambda i: F.element_at(F.col("way"), F.least(i, F.size("way"))))
    f = f.withColumn("way", whole)
    parts = [F.col(f"way.{c}").alias(f"{c}s") for c in "xyz"]
    f = materialize(f.select("episode_id", "frame_idx", "x", "y", "tx", "ty", *parts), "viewpoints")
    tiles = materialize(f.groupBy("tx", "ty").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("parts")), "viewpoint-tiles")
    salted = f.join(tiles, ["tx", "ty"]).withColumn("part", F.pmod(F.xxhash64("episode_id", "frame_idx"), F.col("parts")).cast("int"))
    top = math.ceil((max(EYES) + REACH) / g.voxel)
    low = voxel_set.where(F.col("iz").between(0, top)).join(flags.select("ix", "iy", "blocks"), ["ix", "iy"]).select("ix", "iy", "iz", "blocks", F.lit(None).cast("double").alias("roof"))
    roofs = flags.select("ix", "iy", F.lit(None).cast("int").alias("iz"), F.lit(False).alias("blocks"), F.col("roof_z").alias("roof"))
    scene = low.unionByName(roofs)
    home = [F.floor(F.col(f"i{c}") * g.voxel / TILE).cast("int") for c in "xy"]
    scene = scene.withColumn("o", F.explode(occ.square(1))).select("ix", "iy", "iz", "blocks", "roof", (home[0] + F.col("o.dx")).alias("tx"), (home[1] + F.col("o.dy")).alias("ty"))
    scene = scene.join(tiles, ["tx", "ty"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    none = lambda t, *names: [F.lit(None).cast(t).alias(n) for n in names]
    keys = ["tx", "ty", "part"]
    scene = scene.select(*keys, F.lit(0).alias("kind"), "ix", "iy", "iz", "blocks", "roof", *none("string", "episode_id"), *none("int", "frame_idx"), *none("double", "x", "y"), *none("array<double>", "xs", "ys", "zs"))
    asked = salted.select(*keys, F.lit(1).alias("kind"), *none("int", "ix", "iy", "iz"), *none("boolean", "blocks"), *none("double", "roof"), F.col("episode_id").cast("string").alias("episode_id"), "frame_idx", "x", "y", "xs", "ys", "zs")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = int(3 * TILE / g.voxel) + 3
        for table in whole_chunks(batches, keys):
            kind = codes(table["kind"])
            bounds = np.append(np.flatnonzero(changes([codes(table[k]) for k in keys])), table.num_rows)
            for a, b in zip(bounds[:-1], bounds[1:]):
                middle = a + int((kind[a:b] == 0).sum())
                if middle == b:
                    continue
                corner = [math.floor((table[k][int(a)].as_py() - 1) * TILE / g.voxel) - 1 for k in ("tx", "ty")]
                origin = np.array([*corner, 0])
                solid, taken = (np.zeros((wide, wide, top + 1), dtype=bool) for _ in range(2))
                roof = np.full((wide, wide), -np.inf)
                scenery = table.slice(a, middle - a)
                ix, iy = (codes(scenery[c]) - o for c, o in zip(("ix", "iy"), origin))
                ok = (ix >= 0) & (iy >= 0) & (ix < wide) & (iy < wide)
                height, is_roof = floats(scenery["roof"])
                roof[ix[ok & is_roof], iy[ok & is_roof]] = height[ok & is_roof]
                voxel_row = ok & ~is_roof
                iz = floats(scenery["iz"].cast(pa.float64()))[0]
                cells = ix[voxel_row], iy[voxel_row], iz[voxel_row].astype(np.int64)
                taken[cells] = True
                solid[cells] = scenery["blocks"].to_numpy().astype(bool)[voxel_row]
                for lo in range(middle, b, 256):
                    part = table.slice(lo, min(b, lo + 256) - lo)
                    path = np.stack([part[c].combine_chunks().flatten().to_numpy().reshape(part.num_rows, HORIZON + 1) for c in ("xs", "ys", "zs")], axis=2)
                    found = judge(path, solid, taken, roof, origin, g.voxel)
                    yield pa.RecordBatch.from_arrays([*(part[c].combine_chunks() for c in ("episode_id", "frame_idx", "x", "y")), pa.array([row.tobytes() for row in found], pa.binary())], ["episode_id", "frame_idx", "x", "y", "judgements"])

    return by_chunk(scene.unionByName(asked), keys, ["kind"]).mapInArrow(run, "episode_id string, frame_idx int, x double, y double, judgements binary")


def codes_of(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), len(PLACES)).astype(np.int64)


def best(found: DataFrame) -> DataFrame:
    """episode_id, frame_idx, candidate, score_e6: each frame's best candidate by itself; ties go to the first one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = np.floor(base_scores(codes_of(batch.column(2))) * 1e6 + 0.5).astype(np.int64)
                first = scores.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first.astype(np.int32)), pa.array(scores[np.arange(len(first)), first])], ["episode_id", "frame_idx", "candidate", "score_e6"])

    return found.select("episode_id", "frame_idx", "judgements").mapInArrow(run, "episode_id string, frame_idx int, candidate int, score_e6 bigint")


# A plan whose choice depends on the one before ------------------------------------------------------------------------


def next_choice(base: np.ndarray, before: np.ndarray, step: np.ndarray) -> np.ndarray:
    """For each candidate chosen before, the one chosen now: base score less the way and the turn. step: how far the
    target moved."""
    dx = step[0] + PLACES[None, :, 0] - PLACES[before][:, None, 0]
    dy = step[1] + PLACES[None, :, 1] - PLACES[before][:, None, 1]
    dz = PLACES[None, :, 2] - PLACES[before][:, None, 2]
    way = MOVED * 0.7 * np.minimum(1.0, np.sqrt(dx * dx + dy * dy + dz * dz) / DISTANCE)
    return np.argmax(np.round(base[None, :] - way - TURNS[before], 9), axis=1)


def planned(found: DataFrame, block: int = 512) -> DataFrame:
    """episode_id, frame_idx, candidate: the viewpoint chosen at each judged frame when staying near the last one counts.

    The choice at a frame is a function of the choice before it, and there are 108 choices; so each chunk of an episode
    is a map of 108 numbers, chunks are composed in order (a bounded number per episode), and every chunk is then
    followed from its true beginning. An episode with a third of all frames is planned by all tasks."""
    f = annotate(found, "episode_id", "frame_idx", lag={"p": F.struct("x", "y")})
    f = materialize(f.select("episode_id", F.expr(f"cast(floor(frame_idx / {block}) as int)").alias("chunk"), "frame_idx", "judgements", (F.col("x") - F.col("p")["x"]).alias("sx"), (F.col("y") - F.col("p")["y"]).alias("sy")), "plan")

    def parts(table: pa.Table):
        bounds = np.append(np.flatnonzero(changes([codes(table["episode_id"]), codes(table["chunk"])])), table.num_rows)
        return bounds, base_scores(codes_of(table["judgements"])), np.stack([floats(table[c])[0] for c in ("sx", "sy")], axis=1)

    def follow(base: np.ndarray, step: np.ndarray, state: np.ndarray) -> Iterator[np.ndarray]:
        for b, s in zip(base, step):
            if np.isnan(s[0]):
                state = np.full(len(state), int(np.argmax(np.round(b, 9))))
            else:
                kept, back = np.unique(state, return_inverse=True)
                state = next_choice(b, kept, s)[back]
            yield state

    def maps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_chunks(batches, ["episode_id", "chunk"]):
            bounds, base, step = parts(t)
            ends = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                for state in follow(base[a:b], step[a:b], np.arange(len(PLACES))):
                    pass
                ends.append(state.tolist())
            at = pa.array(bounds[:-1])
            yield pa.RecordBatch.from_arrays([t["episode_id"].take(at).combine_chunks(), t["chunk"].take(at).combine_chunks(), pa.array(ends, pa.list_(pa.int32()))], ["episode_id", "chunk", "map"])

    def begins(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_chunks(batches, ["episode_id"]):
            new, state, out = changes([codes(t["episode_id"])]), 0, []
            for first, m in zip(new, t["map"].to_pylist()):
                state = 0 if first else state
                out.append(state)
                state = m[state]
            yield pa.RecordBatch.from_arrays([t["episode_id"].combine_chunks(), t["chunk"].combine_chunks(), pa.array(out, pa.int32())], ["episode_id", "chunk", "begin"])

    def choices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_chunks(batches, ["episode_id", "chunk"]):
            bounds, base, step = parts(t)
            begin = codes(t["begin"])
            out = [s[0] for a, b in zip(bounds[:-1], bounds[1:]) for s in follow(base[a:b], step[a:b], begin[a : a + 1])]
            yield pa.RecordBatch.from_arrays([t["episode_id"].combine_chunks(), t["frame_idx"].combine_chunks(), pa.array(np.array(out, dtype=np.int32))], ["episode_id", "frame_idx", "candidate"])

    keys = ["episode_id", "chunk"]
    composed = by_chunk(f, keys, ["frame_idx"]).mapInArrow(maps, "episode_id string, chunk int, map array<int>")
    begin = by_chunk(composed, ["episode_id"], ["chunk"]).mapInArrow(begins, "episode_id string, chunk int, begin int")
    return by_chunk(f.join(begin, keys), keys, ["frame_idx"]).mapInArrow(choices, "episode_id string, frame_idx int, candidate int")
