"""Operators over a track in time: action labels, velocities, headings, turns, behaviour classes, smoothing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.functions.geo import wrap_to_pi
from skylattice.operators.chunks import by_chunk, changes, codes, floats, whole_chunks
from skylattice.operators.greedy import taken
from skylattice.operators.sequence import annotate, following
from skylattice.session import materialize

#: Fixed values of the behaviour classes.
COVER, DODGE_DEG, ZIGZAG, DEADBAND_DEG, LEAST_STEP = 0.12, 35.0, 4, 8.0, 1e-3


def actions(frames: DataFrame) -> DataFrame:
    """Change of pose against the frame before, wrapped turn, target speed, visibility, and the discrete label: a turn of
    more than eight degrees is left or right (by that many), anything else a move. The first frame has zeros."""
    pose = F.struct("uav_x", "uav_y", "uav_z", "uav_yaw")
    f = annotate(frames.select("episode_id", "frame_idx", "uav_x", "uav_y", "uav_z", "uav_yaw", "target_visible"), "episode_id", "frame_idx", lag={"b": pose})
    step = lambda c: F.coalesce(F.col(f"uav_{c}") - F.col("b")[f"uav_{c}"], F.lit(0.0))
    turn = F.coalesce(wrap_to_pi(F.col("uav_yaw") - F.col("b")["uav_yaw"]), F.lit(0.0))
    f = f.withColumn("turn", turn)
    degrees = F.degrees("turn")
    label = F.when(F.abs(degrees) > DEADBAND_DEG, F.when(degrees > 0, "right").otherwise("left")).otherwise("move")
    size = F.when(F.abs(degrees) > DEADBAND_DEG, F.abs(F.bround(degrees, 0)).cast("int")).otherwise(0)
    return f.select("episode_id", "frame_idx", step("x").alias("dx"), step("y").alias("dy"), step("z").alias("dz"), "turn", label.alias("action"), size.alias("degrees"), F.coalesce(F.col("target_visible").cast("int"), F.lit(0)).alias("visible"))


def action_vectors(frames: DataFrame) -> DataFrame:
    """The eight numbers of a frame's action: change of position and wrapped turn since the frame before (zeros in the
    first), the target's recorded velocity and whether it is seen. Null readings give nulls."""
    pose = F.struct("uav_x", "uav_y", "uav_z", "uav_yaw")
    f = annotate(frames.select("episode_id", "frame_idx", "uav_x", "uav_y", "uav_z", "uav_yaw", "vx", "vy", "vz", "target_visible"), "episode_id", "frame_idx", lag={"b": pose})
    first = F.col("b").isNull()
    step = [F.when(first, 0.0).otherwise(F.col(f"uav_{c}") - F.col("b")[f"uav_{c}"]).alias(f"d{c}") for c in "xyz"]
    turn = F.when(first, 0.0).otherwise(wrap_to_pi(F.col("uav_yaw") - F.col("b")["uav_yaw"])).alias("turn")
    return f.select("episode_id", "frame_idx", *step, turn, "vx", "vy", "vz", F.when(F.coalesce("target_visible", F.lit(False)), 1.0).otherwise(0.0).alias("visible"))


def filled_times(frames: DataFrame) -> DataFrame:
    """episode_id, frame_idx, timestamp_s: the recorded times of episodes that have them all; where any is missing, frame
    number times the mean tick between the first and last known time (0.05 without two)."""
    counted = annotate(frames.select("episode_id", "frame_idx", "timestamp_s", F.lit(1).alias("one")), "episode_id", "frame_idx", running={"n": F.col("one")})
    timed = F.when(F.col("timestamp_s").isNotNull(), F.col("n"))
    per = counted.groupBy("episode_id").agg(F.count(F.lit(1)).alias("rows"), F.count("timestamp_s").alias("known"), F.min(timed).alias("n0"), F.max(timed).alias("n1"), F.min_by("timestamp_s", timed).alias("t0"), F.max_by("timestamp_s", timed).alias("t1"))
    dt = F.when((F.col("known") >= 2) & (F.col("t1") > F.col("t0")), (F.col("t1") - F.col("t0")) / (F.col("n1") - F.col("n0"))).otherwise(0.05)
    per = per.select("episode_id", (F.col("known") < F.col("rows")).alias("fill"), dt.alias("dt"))
    return counted.join(per, "episode_id").select("episode_id", "frame_idx", F.when(F.col("fill"), (F.col("n") - 1) * F.col("dt")).otherwise(F.col("timestamp_s")).alias("timestamp_s"))


def waypoint_headings(points: DataFrame) -> DataFrame:
    """Heading from each point (episode_id, frame_idx, target_x, target_y) to the next, 0 where it doesn't move; the last
    point repeats the one before."""
    f = annotate(points.select("episode_id", "frame_idx", "target_x", "target_y"), "episode_id", "frame_idx", lead={"n": F.struct("target_x", "target_y")})
    dx, dy = F.col("n")["target_x"] - F.col("target_x"), F.col("n")["target_y"] - F.col("target_y")
    own = F.when(F.col("n").isNotNull(), F.when(dx * dx + dy * dy > 1e-9, F.atan2(dy, dx)).otherwise(0.0))
    f = annotate(f.select("episode_id", "frame_idx", own.alias("own")), "episode_id", "frame_idx", carry={"kept": F.col("own")})
    return f.select("episode_id", "frame_idx", F.coalesce("own", "kept", F.lit(0.0)).alias("heading"))


def resampled(points: DataFrame, step: float) -> DataFrame:
    """episode_id, k, x, y: places every `step` metres along the line through the points, from the first on, and linear
    between them. The way before each point is a running sum over chunks, so long lines are cut like all sequences."""
    f = annotate(points.select("episode_id", "frame_idx", "target_x", "target_y"), "episode_id", "frame_idx", lag={"p": F.struct("target_x", "target_y")})
    px, py = F.coalesce(F.col("p")["target_x"], F.col("target_x")), F.coalesce(F.col("p")["target_y"], F.col("target_y"))
    f = f.select("episode_id", "frame_idx", "target_x", "target_y", px.alias("px"), py.alias("py"), F.col("p").isNull().alias("first"))
    way = F.sqrt((F.col("target_x") - F.col("px")) ** 2 + (F.col("target_y") - F.col("py")) ** 2)
    f = annotate(f.withColumn("way", way), "episode_id", "frame_idx", running={"s": F.col("way")})
    before = F.col("s") - F.col("way")
    inside = F.when(F.col("first"), F.array(F.lit(0).cast("bigint"))).when(F.floor(F.col("s") / step) > F.floor(before / step), F.sequence(F.floor(before / step) + 1, F.floor(F.col("s") / step)))
    on = f.withColumn("k", F.explode(inside)).withColumn("t", F.when(F.col("way") > 0, (F.col("k") * step - before) / F.col("way")).otherwise(0.0))
    return on.select("episode_id", "k", *[(F.col(f"p{c}") + (F.col(f"target_{c}") - F.col(f"p{c}")) * F.col("t")).alias(c) for c in "xy"])


def stuck_resets(frames: DataFrame, slow: float = 0.05, patience: int = 6) -> DataFrame:
    """episode_id, frame_idx where a target that moved less than `slow` at `patience` frames in a row is taken out of its
    place; counting then begins anew. A run of slow steps resets at each multiple of the patience."""
    f = annotate(frames.where("target_x is not null and target_y is not null").select("episode_id", "frame_idx", "target_x", "target_y"), "episode_id", "frame_idx", lag={"p": F.struct("target_x", "target_y")})
    way = F.sqrt((F.col("target_x") - F.col("p")["target_x"]) ** 2 + (F.col("target_y") - F.col("p")["target_y"]) ** 2)
    f = f.select("episode_id", "frame_idx", F.coalesce(way < slow, F.lit(False)).alias("still"))
    f = annotate(f, "episode_id", "frame_idx", running={"n": F.lit(1)})
    f = annotate(f, "episode_id", "frame_idx", carry={"moved": F.when(~F.col("still"), F.col("n"))})
    length = F.col("n") - F.coalesce("moved", F.lit(0))
    return f.where(F.col("still") & (F.pmod(length, F.lit(patience)) == 0)).select("episode_id", "frame_idx")


def velocities(frames: DataFrame) -> DataFrame:
    """Target velocity by central differences, one-sided at the ends; the recorded one where there is one."""
    f = frames.where("target_x is not null and target_y is not null and timestamp_s is not null").select("episode_id", "frame_idx", "timestamp_s", "target_x", "target_y", "vx", "vy")
    at = F.struct("timestamp_s", "target_x", "target_y")
    f = annotate(f, "episode_id", "frame_idx", lag={"p": at}, lead={"n": at}).withColumn("own", at)
    a, b = F.coalesce("p", "own"), F.coalesce("n", "own")
    dt = F.greatest(b["timestamp_s"] - a["timestamp_s"], F.lit(1e-6))
    return f.select("episode_id", "frame_idx", *[F.coalesce(f"v{c}", (b[f"target_{c}"] - a[f"target_{c}"]) / dt).alias(f"v{c}") for c in "xy"])


def headings(frames: DataFrame) -> DataFrame:
    """Heading of each step of the target; a step of a millimetre or less keeps the last heading, at first 0. before: the
    heading of the frame before, null in the first."""
    f = frames.where("target_x is not null and target_y is not null").select("episode_id", "frame_idx", "target_x", "target_y", "target_visible", "line_of_sight_clear")
    f = annotate(f, "episode_id", "frame_idx", lag={"p": F.struct("target_x", "target_y")})
    dx, dy = F.col("target_x") - F.col("p")["target_x"], F.col("target_y") - F.col("p")["target_y"]
    moved = F.when(F.sqrt(dx * dx + dy * dy) > LEAST_STEP, F.atan2(dy, dx))
    f = annotate(f.withColumn("h", moved).withColumn("first", F.col("p").isNull()).drop("p"), "episode_id", "frame_idx", carry={"kept": F.col("h")})
    # the last step that moved before this one is the heading of the frame before
    return f.select("episode_id", "frame_idx", F.coalesce("h", "kept", F.lit(0.0)).alias("heading"), F.when(~F.col("first"), F.coalesce("kept", F.lit(0.0))).alias("before"), "target_visible", "line_of_sight_clear")


def behavior(frames: DataFrame) -> DataFrame:
    """Per episode: population deviation of the turn rate, direction changes (sign flips of turns beyond the deadband,
    smaller turns taken out first), occluded share, and the class of them."""
    h = headings(frames)
    turn = F.degrees(wrap_to_pi(F.col("heading") - F.col("before")))
    h = h.withColumn("turn", turn)
    sign = F.when(F.abs("turn") > DEADBAND_DEG, F.signum("turn").cast("int"))
    h = annotate(h.select("episode_id", "frame_idx", "turn", "target_visible", "line_of_sight_clear", sign.alias("sign")), "episode_id", "frame_idx", carry={"last": F.col("sign")})
    flips = F.count_if(F.col("sign").isNotNull() & F.col("last").isNotNull() & (F.col("sign") != F.col("last")))
    hidden = F.avg((~F.coalesce("line_of_sight_clear", "target_visible", F.lit(True))).cast("double"))
    out = h.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.stddev_pop("turn"), F.lit(0.0)).alias("turn_std"), flips.alias("direction_changes"), hidden.alias("occluded"))
    kind = F.when(F.col("occluded") >= COVER, "cover_using").when(F.col("n") < 3, "straight").when(F.col("turn_std") >= DODGE_DEG, "dodging").when(F.col("direction_changes") >= ZIGZAG, "zigzag").otherwise("straight")
    return out.withColumn("behavior", kind)


def lookahead(frames: DataFrame, k: int = 4) -> DataFrame:
    """Mean occlusion over this and the next k frames; at the end the last frame stands in for missing ones. Only the
    last k frames of an episode look past its end, so their number decides the repetition."""
    f = frames.select("episode_id", "frame_idx", F.when(F.coalesce("line_of_sight_clear", F.lit(True)), 0).otherwise(1).alias("hidden"))
    f = following(f, "episode_id", "frame_idx", F.col("hidden"), k, "next")
    last = F.coalesce(F.try_element_at("next", F.lit(-1)), F.col("hidden"))
    total = F.aggregate("next", F.col("hidden"), lambda a, x: a + x) + last * (k - F.size("next"))
    return f.select("episode_id", "frame_idx", "hidden", (total / (k + 1)).alias("risk"))


def fold(x: float, a: np.ndarray, new: np.ndarray) -> np.ndarray:
    """x after each step x += a (new - x): affine maps, composed by doubling, so a chunk takes a logarithmic number of
    array operations."""
    scale, shift = 1.0 - a, a * new
    step = 1
    while step < len(a):
        shift[step:] = scale[step:] * shift[:-step] + shift[step:]
        scale[step:] = scale[step:] * scale[:-step]
        step *= 2
    return scale * x + shift


def smoothed(frames: DataFrame, column: str, tau: float = 0.5, exponential: bool = False) -> DataFrame:
    """Exponential smoothing x += a (new - x) of a column along an episode's frames, with a = clip(dt / tau, 0, 1) or, if
    exponential, 1 - exp(-dt / tau). The first reading stands.

    The recursion is affine: x' = (1 - a) x + a new. Affine maps compose, so each chunk of an episode is first reduced to
    one map, the maps are composed over chunks (a bounded number per episode), and each chunk then starts from its true
    value; no task handles a whole episode."""
    from skylattice.session import BLOCK

    f = frames.where(F.col(column).isNotNull() & F.col("timestamp_s").isNotNull()).select("episode_id", "frame_idx", "timestamp_s", F.col(column).cast("double").alias("new"))
    f = annotate(f, "episode_id", "frame_idx", lag={"t0": F.col("timestamp_s")})
    dt = (F.col("timestamp_s") - F.col("t0")) / tau
    step = 1.0 - F.exp(-F.greatest(F.lit(0.0), dt)) if exponential else F.greatest(F.lit(0.0), F.least(F.lit(1.0), dt))
    share = F.when(F.col("t0").isNull(), 1.0).otherwise(step)
    f = materialize(f.select("episode_id", F.expr(f"cast(floor(frame_idx / {BLOCK}) as int)").alias("chunk"), "frame_idx", "new", share.alias("a")), "ema")

    def maps(batches):
        for t in whole_chunks(batches, ["episode_id", "chunk"]):
            bounds = np.append(np.flatnonzero(changes([codes(t["episode_id"]), codes(t["chunk"])])), t.num_rows)
            a, new = floats(t["a"])[0], floats(t["new"])[0]
            scale = [float(np.prod(1 - a[i:j])) for i, j in zip(bounds[:-1], bounds[1:])]
            shift = [float(fold(0.0, a[i:j], new[i:j])[-1]) for i, j in zip(bounds[:-1], bounds[1:])]
            at = pa.array(bounds[:-1])
            yield pa.RecordBatch.from_arrays([t["episode_id"].take(at).combine_chunks(), t["chunk"].take(at).combine_chunks(), pa.array(scale), pa.array(shift)], ["episode_id", "chunk", "scale", "shift"])

    def starts(batches):
        for t in whole_chunks(batches, ["episode_id"]):
            new = changes([codes(t["episode_id"])])
            scale, shift = floats(t["scale"])[0], floats(t["shift"])[0]
            x, out = 0.0, []
            for i in range(t.num_rows):
                x = 0.0 if new[i] else x
                out.append(x)
                x = scale[i] * x + shift[i]
            yield pa.RecordBatch.from_arrays([t["episode_id"].combine_chunks(), t["chunk"].combine_chunks(), pa.array(out)], ["episode_id", "chunk", "x0"])

    def values(batches):
        for t in whole_chunks(batches, ["episode_id", "chunk"]):
            bounds = np.append(np.flatnonzero(changes([codes(t["episode_id"]), codes(t["chunk"])])), t.num_rows)
            a, new, x0 = (floats(t[c])[0] for c in ("a", "new", "x0"))
            out = np.concatenate([fold(x0[i], a[i:j], new[i:j]) for i, j in zip(bounds[:-1], bounds[1:])])
            yield pa.RecordBatch.from_arrays([t["episode_id"].combine_chunks(), t["frame_idx"].combine_chunks(), pa.array(out)], ["episode_id", "frame_idx", "smoothed"])

    reduced = by_chunk(f, ["episode_id", "chunk"], ["frame_idx"]).mapInArrow(maps, "episode_id string, chunk int, scale double, shift double")
    begin = by_chunk(reduced, ["episode_id"], ["chunk"]).mapInArrow(starts, "episode_id string, chunk int, x0 double")
    return by_chunk(f.join(begin, ["episode_id", "chunk"]), ["episode_id", "chunk"], ["frame_idx"]).mapInArrow(values, "episode_id string, frame_idx int, smoothed double")


def thinned(points: DataFrame, apart: float) -> DataFrame:
    """Greedy non-maximum suppression of points (point_id, x, y, score): by falling score (ties in a hash order, which keeps chains of conflicts short), those at least
    `apart` from all taken before them. Points meet in cells as large as `apart`, and conflicts are settled in rounds."""
    cell = lambda c: F.floor(F.col(c) / apart).cast("bigint")
    p = materialize(points.where("point_id is not null and x is not null and y is not null and score is not null").select("point_id", "x", "y", F.struct((-F.col("score")).alias("s"), F.xxhash64("point_id").alias("h"), "point_id").alias("at")), "peaks")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = p.withColumn("o", around).select(F.col("point_id").alias("before"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("at").alias("a"), (cell("x") + F.col("o.i")).alias("cx"), (cell("y") + F.col("o.j")).alias("cy"))
    b = p.select(F.col("point_id").alias("after"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("at").alias("b"), cell("x").alias("cx"), cell("y").alias("cy"))
    near = (F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2 < apart * apart
    kept = taken(p.select(F.col("point_id").alias("node"), F.lit(False).alias("given")), a.join(b, ["cx", "cy"]).where((F.col("a") < F.col("b")) & near).select("before", "after"))
    return points.join(kept.select(F.col("node").alias("point_id")), "point_id", "left_semi")


def spaced(points: DataFrame, apart: float = 2.0) -> DataFrame:
    """episode_id, frame_idx of the points (episode_id, frame_idx, target_x, target_y) that are at least `apart` from the
    last one kept; the first is kept. What is kept depends on all kept before, so an episode streams through one task,
    which holds one batch and the last kept point."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, bounds = batch.column(0), np.append(np.flatnonzero(changes([codes(batch.column(0))])), batch.num_rows)
            xy = np.stack([floats(pa.chunked_array([batch.column(i)]))[0] for i in (2, 3)], axis=1)
            keep = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                name = names[int(a)].as_py()
                last = last if name == entity else None
                entity, i = name, int(a)
                while i < b:
                    if last is not None:  # look ahead in stretches for the next point that is far enough
                        far = np.flatnonzero(((xy[i : i + 64] - last) ** 2).sum(axis=1)[: b - i] >= apart * apart)
                        if not len(far):
                            i += 64
                            continue
                        i += int(far[0])
                    keep.append(i)
                    last, i = xy[i], i + 1
            if keep:
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([names.take(at), batch.column(1).take(at)], ["episode_id", "frame_idx"])

    p = points.where("episode_id is not null and frame_idx is not null and target_x is not null and target_y is not null").select("episode_id", "frame_idx", "target_x", "target_y")
    return by_chunk(p, ["episode_id"], ["frame_idx"]).mapInArrow(run, "episode_id string, frame_idx int")
