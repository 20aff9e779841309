"""Record and batch validation as expressions and joins: each check gives rows, reports are unions and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.poses import parse_pose

#: Fields an episode must have; all but the seed must not be null. Fixed values.
EPISODE_FIELDS = (
    "episode_id", "scene_id", "difficulty_level", "target_behavior_type", "target_class", "instruction", "max_steps",
    "camera_config", "uav_initial_pose", "target_initial_pose", "environment_summary", "occluder_summary",
)
FRAME_FIELDS = ("frame_idx", "timestamp_s", "drone_pose_world", "target_pose_world", "target_velocity", "target_visible", "drone_distance_m", "drone_bearing_to_target_rad", "collision")
#: Frame errors listed one by one per episode; more are summed up in one line.
LISTED = 3


def first_failure(checks: list[tuple[Column, str]]) -> Column:
    """The message of the first failed check, null if all hold. A check that is null fails."""
    out = F.lit(None).cast("string")
    for ok, message in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)).otherwise(out)
    return out


def unit_interval(name: str) -> Column:
    """Null passes; NaN doesn't."""
    c = F.col(name)
    return c.isNull() | (~F.isnan(c) & c.between(0.0, 1.0))


def episode_failure() -> Column:
    checks = [(F.col(c).isNotNull(), f"{c} must not be null") for c in EPISODE_FIELDS]
    checks += [(F.trim("episode_id") != "", "episode_id must not be empty"), (F.col("max_steps") >= 0, "max_steps must be >= 0")]
    checks += [(parse_pose(c).isNotNull(), f"{c} is not a pose") for c in ("uav_initial_pose", "target_initial_pose")]
    return first_failure(checks)


def frame_failure() -> Column:
    checks = [(F.col(c).isNotNull(), f"{c} must not be null") for c in FRAME_FIELDS]
    checks += [(unit_interval("occlusion_risk"), "occlusion_risk out of [0, 1]"), (F.col("frame_idx") >= 0, "frame_idx must be >= 0")]
    return first_failure(checks)


def checked_episodes(episodes: DataFrame) -> DataFrame:
    return episodes.select("episode_id", episode_failure().alias("issue"))


def checked_frames(frames: DataFrame) -> DataFrame:
    return frames.select("record_id", "episode_id", "frame_idx", frame_failure().alias("issue"))


def frame_issues(frames: DataFrame) -> DataFrame:
    """episode_id, issue: the first LISTED errors of an episode and a summary line if there are more. The first ones are
    kept by a bounded aggregation, so an episode with many errors stays small."""
    bad = checked_frames(frames).where("issue is not null and episode_id is not null")
    counts = bad.groupBy("episode_id", "issue").agg(F.count(F.lit(1)).alias("n"), F.min("frame_idx").alias("first_frame"))
    per = counts.groupBy("episode_id").agg(F.sum("n").alias("failed"), F.slice(F.array_sort(F.collect_list(F.struct("first_frame", "issue"))), 1, LISTED).alias("first"))
    lines = F.transform("first", lambda s: F.concat(F.lit("frame "), s["first_frame"].cast("string"), F.lit(": "), s["issue"]))
    more = F.when(F.col("failed") > LISTED, F.array(F.concat(F.col("failed").cast("string"), F.lit(" frames failed field validation")))).otherwise(F.array().cast("array<string>"))
    return per.select("episode_id", F.explode(F.concat(lines, more)).alias("issue"))


def batch_report(episodes: DataFrame, frames: DataFrame) -> DataFrame:
    """Per episode: issues (sorted), passed, frames. Episodes without frames and frames without an episode are issues."""
    counts = frames.where("episode_id is not null").groupBy("episode_id").agg(F.count(F.lit(1)).alias("frames"))
    known = episodes.where("episode_id is not null").select("episode_id").distinct().withColumn("known", F.lit(True))
    presence = known.join(counts, "episode_id", "full")
    missing = presence.where("frames is null").select("episode_id", F.lit("no frames").alias("issue"))
    orphans = presence.where("known is null").select("episode_id", F.lit("no metadata").alias("issue"))
    issues = checked_episodes(episodes).where("issue is not null and episode_id is not null").distinct()
    every = issues.unionByName(frame_issues(frames)).unionByName(missing).unionByName(orphans)
    listed = every.groupBy("episode_id").agg(F.array_sort(F.collect_set("issue")).alias("issues"))
    out = presence.join(listed, "episode_id", "left")
    none = F.array().cast("array<string>")
    return out.select("episode_id", F.coalesce("frames", F.lit(0)).alias("frames"), F.coalesce("issues", none).alias("issues"), F.col("issues").isNull().alias("passed"))


def missing_files(references: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """The references whose path isn't in the listing; a null or empty path is missing."""
    return references.join(listing.select(F.col(path)).distinct(), path, "left_anti")


def batch_manifest(report: DataFrame) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("episodes"), F.count_if("passed").alias("passed"), F.sum("frames").alias("frames"))


def color_boxes(pixels: DataFrame, samples: DataFrame, least: int = 12) -> DataFrame:
    """image, x0, y0, x1, y1, pixels: the box of all pixels (image, x, y, r, g, b) that have their image's sampled colour
    (image, r, g, b). Near-black colours are background; boxes of fewer than `least` pixels don't count."""
    wanted = samples.where("greatest(r, g, b) > 2").select("image", "r", "g", "b")
    own = pixels.select("image", "x", "y", "r", "g", "b").distinct().join(wanted, ["image", "r", "g", "b"], "left_semi")
    box = own.groupBy("image").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("pixels"))
    return box.where(F.col("pixels") >= least)
