"""Per-episode tracking metrics and dataset reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.operators.sequence import annotate, runs

#: Share of visible frames from which an episode counts as tracked, by difficulty. Fixed values.
SUCCESS = {"easy": 0.70, "medium": 0.70, "hard": 0.60}
SUCCESS_ELSE = 0.70
#: Tick length where an episode's times don't give one. Fixed value.
DEFAULT_DT = 0.05


def scaled(c: Column, digits: int = 4) -> Column:
    """c in units of 10**-digits, rounded half up: equal on every engine that has doubles."""
    return F.floor(c * F.lit(float(10**digits)) + F.lit(0.5)).cast("bigint")


def readable(c: Column) -> Column:
    """NaN and infinite readings count as null."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def distinct_frames(frame_records: DataFrame) -> DataFrame:
    """One row per frame (episode_id, frame_idx); frames stored more than once count once. Flat columns; NaN and infinite
    readings are null."""
    plain = ("target_visible", "in_camera_frustum", "line_of_sight_clear", "collision", "tracker_mode")
    numbers = ("timestamp_s", "occlusion_risk", "drone_distance_m", "drone_bearing_to_target_rad")
    poses = [(f"{p}.{c}", f"{n}_{c}") for p, n in (("drone_pose_world", "uav"), ("target_pose_world", "target")) for c in ("x", "y", "z", "yaw")]
    kept = frame_records.where("episode_id is not null and frame_idx is not null").groupBy("episode_id", "frame_idx")
    velocity = [F.first(readable(F.try_element_at("target_velocity", F.lit(i)))).alias(f"v{c}") for i, c in ((1, "x"), (2, "y"), (3, "z"))]
    return kept.agg(*[F.first(c).alias(c) for c in plain], *[F.first(readable(F.col(c))).alias(c) for c in numbers], *[F.first(readable(F.col(c))).alias(n) for c, n in poses], *velocity)


def distinct_episodes(episodes: DataFrame) -> DataFrame:
    """One row per episode, the one received last."""
    columns = [c for c in episodes.columns if c != "episode_id"]
    latest = episodes.where("episode_id is not null").groupBy("episode_id").agg(F.max_by(F.struct(*columns), F.struct(F.coalesce(F.col("received_at").cast("string"), F.lit("")), F.xxhash64(*columns))).alias("r"))
    return latest.select("episode_id", "r.*")


def threshold(difficulty: Column) -> Column:
    out = F.when(difficulty == "easy", SUCCESS["easy"])
    for level in ("medium", "hard"):
        out = out.when(difficulty == level, SUCCESS[level])
    return out.otherwise(SUCCESS_ELSE)


def run_metrics(frames: DataFrame) -> DataFrame:
    """Per episode: visible runs, re-acquisition gaps (lost after having been seen, and found again) and redetections
    (every lost run that ends, a leading one too)."""
    table = runs(frames.select("episode_id", "frame_idx", F.coalesce("target_visible", F.lit(False)).alias("visible")), "episode_id", "frame_idx", "visible")
    seen, lost = F.col("visible"), ~F.col("visible")
    ends = table.groupBy("episode_id").agg(
        F.max("run").alias("k"),
        F.coalesce(F.max(F.when(seen, F.col("length"))), F.lit(0)).alias("longest_visible"),
        F.count_if(seen).alias("visible_runs"),
        F.coalesce(F.sum(F.when(seen, F.col("length"))), F.lit(0)).alias("visible_frames"),
        F.count_if(lost).alias("lost_runs"),
        F.coalesce(F.sum(F.when(lost, F.col("length"))), F.lit(0)).alias("lost_frames"),
        F.min_by(F.struct("visible", "length"), "run").alias("head"),
        F.max_by(F.struct("visible", "length"), "run").alias("tail"),
    )
    first = F.when(~F.col("head")["visible"], F.col("head")["length"])
    last = F.when(~F.col("tail")["visible"], F.col("tail")["length"])
    single = F.col("k") == 1
    found_runs = F.col("lost_runs") - last.isNotNull().cast("int")
    found_frames = F.col("lost_frames") - F.coalesce(last, F.lit(0))
    lead_runs = F.when(single, F.lit(0)).otherwise(first.isNotNull().cast("int"))
    lead_frames = F.when(single, F.lit(0)).otherwise(F.coalesce(first, F.lit(0)))
    return ends.select(
        "episode_id", "longest_visible", "visible_runs", "visible_frames", "lost_frames",
        found_runs.alias("redetection_events"), found_frames.alias("redetection_frames"),
        (found_runs - lead_runs).alias("reacquisition_events"), (found_frames - lead_frames).alias("reacquisition_frames"),
    )


def frame_sums(frames: DataFrame) -> DataFrame:
    """Per episode: counts, collisions, times of the first and last frame, length of the flown path and net distance.
    Frames without a pose are bridged."""
    pose = F.when(F.col("uav_x").isNotNull() & F.col("uav_y").isNotNull() & F.col("uav_z").isNotNull(), F.struct("uav_x", "uav_y", "uav_z"))
    steps = annotate(frames.select("episode_id", "frame_idx", "timestamp_s", "collision", pose.alias("p")), "episode_id", "frame_idx", carry={"before": F.col("p")})
    d = sum(((F.col("p")[c] - F.col("before")[c]) ** 2 for c in ("uav_x", "uav_y", "uav_z")), F.lit(0.0))
    has_time = F.when(F.col("timestamp_s").isNotNull(), F.col("frame_idx"))
    has_pose = F.when(F.col("p").isNotNull(), F.col("frame_idx"))
    return steps.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("total_frames"),
        F.count_if(F.coalesce("collision", F.lit(False))).alias("collisions"),
        F.count("timestamp_s").alias("timed"),
        F.min_by("timestamp_s", has_time).alias("t0"),
        F.max_by("timestamp_s", has_time).alias("t1"),
        F.coalesce(F.sum(F.sqrt(d)), F.lit(0.0)).alias("path_length"),
        F.count("p").alias("points"),
        F.min_by("p", has_pose).alias("p0"),
        F.max_by("p", has_pose).alias("p1"),
    )


def episode_metrics(frames: DataFrame, episodes: DataFrame) -> DataFrame:
    """All metrics per episode, unrounded. Episodes without frames have zeros and no success."""
    level = episodes.select("episode_id", "difficulty_level")
    both = level.join(frame_sums(frames).join(run_metrics(frames), "episode_id"), "episode_id", "full")
    zero = [c for c in both.columns if c not in ("episode_id", "difficulty_level", "t0", "t1", "p0", "p1")]
    both = both.fillna(0, zero)
    n = F.col("total_frames")
    ratio = F.coalesce(F.try_divide("visible_frames", n), F.lit(0.0))
    net = F.sqrt(sum(((F.col("p1")[c] - F.col("p0")[c]) ** 2 for c in ("uav_x", "uav_y", "uav_z")), F.lit(0.0)))
    dt = F.when(F.col("timed") >= 2, (F.col("t1") - F.col("t0")) / (F.col("timed") - 1))
    dt = F.when(dt > 1e-6, dt)
    reacquisition = F.coalesce(F.try_divide("reacquisition_frames", "reacquisition_events"), F.lit(0.0))
    return both.select(
        "episode_id", "difficulty_level", "total_frames",
        ((ratio >= threshold(F.col("difficulty_level"))) & (F.col("collisions") == 0) & (n > 0)).alias("tracking_success"),
        ratio.alias("visibility_ratio"),
        F.coalesce(F.try_divide("longest_visible", n), F.lit(0.0)).alias("continuity"),
        F.coalesce(F.try_divide("visible_frames", "visible_runs"), F.lit(0.0)).alias("avg_visible_segment"),
        "lost_frames", (F.col("lost_frames") * dt).alias("lost_duration_s"),
        "reacquisition_events", reacquisition.alias("reacquisition_frames"), (reacquisition * dt).alias("reacquisition_s"),
        "redetection_events",
        F.coalesce(F.try_divide(F.col("redetection_frames") + F.col("redetection_events"), "redetection_events"), F.lit(0.0)).alias("redetection_steps"),
        (F.coalesce(F.col("collisions"), F.lit(0)) > 0).alias("collision_flag"),
        F.coalesce(F.try_divide("collisions", n), F.lit(0.0)).alias("collision_rate"),
        "path_length",
        F.when((F.col("points") >= 2) & (F.col("path_length") > 1e-6), F.least(F.lit(1.0), net / F.col("path_length"))).alias("path_efficiency"),
        dt.alias("dt"),
    )


def series_metrics(metrics: DataFrame) -> DataFrame:
    """The series view: track share, lost share, mean redetection time (lost frames plus one, times the tick)."""
    tick = F.coalesce("dt", F.lit(DEFAULT_DT))
    return metrics.select(
        "episode_id", "total_frames", F.col("visibility_ratio").alias("track_auc"),
        F.when(F.col("total_frames") > 0, F.col("lost_frames") / F.col("total_frames")).otherwise(0.0).alias("lost_rate"),
        "redetection_events", (F.col("redetection_steps") * tick).alias("redetection_time_s"), "collision_rate",
        (F.col("total_frames") * tick).alias("duration_s"),
    )


#: Bins of an octave; a bin holds about a hundredth of evenly spread values, and all values have at most 300,000 bins.
OCTAVE = 64


def quantile(values: DataFrame, group: str, value: str, q: float, name: str) -> DataFrame:
    """group and its quantile (linear between neighbours) of the values that are numbers; groups without one have no row.

    Values are counted in bins that keep their order, the bins that hold the two middle ranks are found among the counts,
    and only the values of these are looked at again, counted by value. No buffer holds a group's values."""
    x = F.col("v")
    level = F.lit(200_000) + F.floor((F.log2(F.abs(x)) + 1100) * OCTAVE).cast("int")
    v = values.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    v = v.withColumn("bin", F.when(x > 0, level).when(x < 0, -level).otherwise(0))
    of = Window.partitionBy("g")
    upto = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = v.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("m")).select("g", "bin", "m", F.sum("m").over(of).alias("n"), F.sum("m").over(upto).alias("upto"))
    place = F.lit(q) * (F.col("n") - 1)
    low = F.floor(place)
    ranks = F.array(low, F.least(low + 1, F.col("n") - 1))
    wanted = bins.select("g", "bin", (F.col("upto") - F.col("m")).alias("before"), "upto", F.explode(F.array(F.struct(ranks[0].alias("rank"), F.lit(0).alias("k")), F.struct(ranks[1].alias("rank"), F.lit(1).alias("k")))).alias("r"), (place - low).alias("part"))
    wanted = wanted.where("r.rank >= before and r.rank < upto").select("g", "bin", "before", "r.rank", "r.k", "part")
    inside = v.join(wanted.select("g", "bin").distinct(), (v["g"].eqNullSafe(wanted["g"])) & (v["bin"] == wanted["bin"]), "left_semi")
    counted = inside.groupBy("g", "bin", "v").agg(F.count(F.lit(1)).alias("m"))
    ranked = counted.select("g", "bin", "v", "m", F.sum("m").over(Window.partitionBy("g", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"))
    met = ranked.alias("a").join(wanted.alias("w"), F.col("a.g").eqNullSafe(F.col("w.g")) & (F.col("a.bin") == F.col("w.bin"))).where("w.rank - w.before < a.upto and w.rank - w.before >= a.upto - a.m")
    ends = met.groupBy(F.col("w.g").alias(group)).agg(F.max(F.when(F.col("w.k") == 0, F.col("a.v"))).alias("lo"), F.max(F.when(F.col("w.k") == 1, F.col("a.v"))).alias("hi"), F.max("w.part").alias("part"))
    return ends.select(group, (F.col("lo") * (1 - F.col("part")) + F.col("hi") * F.col("part")).alias(name))


def summary(series: DataFrame, columns: tuple[str, ...] = ("track_auc", "lost_rate", "redetection_time_s", "collision_rate", "total_frames")) -> DataFrame:
    """metric, mean, min, max, p10 (linear) over episodes, one row per metric."""
    rows = series.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("r")).select("r.*")
    parts = rows.groupBy("metric").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    return parts.join(quantile(rows, "metric", "value", 0.1, "p10"), "metric", "left")


def consistency_report(metrics: DataFrame, by: str = "difficulty_level") -> DataFrame:
    """Per group: episodes, successes over judged episodes, collisions, means that skip nulls. Null and empty groups are
    'unknown'."""
    group = F.when(F.coalesce(F.col(by), F.lit("")) == "", F.lit("unknown")).otherwise(F.col(by))
    return metrics.groupBy(group.alias("group_name")).agg(
        F.count(F.lit(1)).alias("episodes"),
        F.count_if("tracking_success").alias("successes"),
        F.count_if("collision_flag").alias("with_collision"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("visibility_ratio", "continuity", "path_length", "path_efficiency")],
    )


def visibility_reason(hfov_half: float = 0.4363, max_range: float = 80.0) -> Column:
    """Why a target isn't seen, tested in order: range, field of view, line of sight. The recorded flag wins when true."""
    d, bearing = F.col("drone_distance_m"), F.col("drone_bearing_to_target_rad")
    return (
        F.when(F.col("target_visible"), "ok")
        .when(d > max_range, "out_of_range")
        .when(~F.coalesce("in_camera_frustum", F.abs(bearing) <= hfov_half), "out_of_fov")
        .when(~F.coalesce("line_of_sight_clear", F.lit(True)), "los_blocked")
        .otherwise("los_blocked_occluder")
    )


def reason_counts(frames: DataFrame) -> DataFrame:
    """Per episode: totals and a map of reason to count, as the visibility summary has them."""
    counted = frames.groupBy("episode_id", visibility_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("episode_id").agg(F.sum("n").alias("frames"), F.sum(F.when(F.col("reason") == "ok", F.col("n")).otherwise(0)).alias("visible"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("vis_reason_counts"))
