"""Queries over episodes and frames, and SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.functions.poses import parse_pose
from skylattice.operators import kinematics, metrics
from skylattice.operators.metrics import scaled
from skylattice.operators.sequence import annotate, runs
from skylattice.session import table


def frames(spark: SparkSession, d: str) -> DataFrame:
    return metrics.distinct_frames(table(spark, d, "frame_records"))


def episodes(spark: SparkSession, d: str) -> DataFrame:
    return metrics.distinct_episodes(table(spark, d, "episodes"))


def _metrics(spark, d):
    return metrics.episode_metrics(frames(spark, d), episodes(spark, d))


def episode_metrics(spark, d):
    m = _metrics(spark, d)
    e4 = ("visibility_ratio", "continuity", "collision_rate", "path_efficiency")
    e3 = ("avg_visible_segment", "lost_duration_s", "reacquisition_frames", "reacquisition_s", "path_length")
    return m.select("episode_id", "difficulty_level", "total_frames", "tracking_success", "lost_frames", "reacquisition_events", "collision_flag", *[scaled(F.col(c)).alias(f"{c}_e4") for c in e4], *[scaled(F.col(c), 3).alias(f"{c}_e3") for c in e3])


def redetection_metrics(spark, d):
    s = metrics.series_metrics(_metrics(spark, d))
    return s.select("episode_id", "redetection_events", *[scaled(F.col(c)).alias(f"{c}_e4") for c in ("track_auc", "lost_rate", "redetection_time_s", "duration_s")])


def metrics_summary(spark, d):
    s = metrics.summary(metrics.series_metrics(_metrics(spark, d)))
    return s.select("metric", *[scaled(F.col(c)).alias(f"{c}_e4") for c in ("mean", "min", "max", "p10")])


def consistency_report(spark, d):
    r = metrics.consistency_report(_metrics(spark, d))
    return r.select("group_name", "episodes", "successes", "with_collision", *[scaled(F.col(c)).alias(f"{c}_e4") for c in r.columns if c.startswith("mean_")])


def reason_counts(spark, d):
    r = metrics.reason_counts(frames(spark, d))
    at = lambda k: F.coalesce(F.try_element_at("vis_reason_counts", F.lit(k)), F.lit(0)).alias(k)
    return r.select("episode_id", "frames", "visible", *[at(k) for k in ("ok", "out_of_range", "out_of_fov", "los_blocked", "los_blocked_occluder")])


def _levels(spark, d):
    return episodes(spark, d).select("scene_id", F.coalesce("difficulty_level", F.lit("unknown")).alias("difficulty"), F.coalesce("target_behavior_type", F.lit("unknown")).alias("behavior"))


def report_cube(spark, d):
    return _levels(spark, d).cube("difficulty", "behavior").agg(F.count(F.lit(1)).alias("episodes"), F.countDistinct("scene_id").alias("scenes"))


def report_rollup(spark, d):
    return _levels(spark, d).rollup("scene_id", "difficulty").agg(F.count(F.lit(1)).alias("episodes"))


def tier_counts(spark, d):
    return episodes(spark, d).groupBy(F.coalesce(F.when(F.col("difficulty_level") != "", F.col("difficulty_level")), F.lit("?")).alias("tier")).agg(F.count(F.lit(1)).alias("episodes"), F.collect_set("target_class").alias("classes")).select("tier", "episodes", F.array_sort("classes").alias("classes"))


def visible_runs(spark, d):
    f = frames(spark, d).select("episode_id", "frame_idx", F.coalesce("target_visible", F.lit(False)).alias("visible"))
    return runs(f, "episode_id", "frame_idx", "visible").select("episode_id", "run", "visible", "length", "first_order", "last_order")


def relative_geometry(spark, d):
    """Bearing, distances, wrapped bearing error and frame flips of drone and target."""
    f = frames(spark, d).where("uav_x is not null and target_x is not null and uav_yaw is not null")
    dx, dy, dz = (F.col(f"target_{c}") - F.col(f"uav_{c}") for c in "xyz")
    off = geo.wrap_to_pi(geo.bearing(dx, dy) - F.col("uav_yaw"))
    mx, my, mz = geo.ned_to_map(F.col("uav_x"), F.col("uav_y"), F.col("uav_z"))
    return f.select("episode_id", "frame_idx", *[scaled(c, 3).alias(n) for c, n in ((geo.bearing(dx, dy), "bearing_e3"), (geo.horizontal(dx, dy), "horizontal_e3"), (geo.norm3(dx, dy, dz), "distance_e3"), (off, "off_e3"), (mx, "map_x_e3"), (my, "map_y_e3"), (mz, "altitude_e3"))])


def pixel_projection(spark, d):
    """Target pixel and whether it lies in the image, with each episode's camera."""
    cam = episodes(spark, d).select("episode_id", "camera_config.*").where("width is not null and height is not null")
    f = frames(spark, d).where("uav_x is not null and target_x is not null and uav_yaw is not null").join(cam, "episode_id")
    dx, dy, dz = (F.col(f"target_{c}") - F.col(f"uav_{c}") for c in "xyz")
    depth, right, below = geo.camera_frame(dx, dy, dz, F.col("uav_yaw"), F.col("pitch_deg"), F.col("body_forward_m"), F.col("body_down_m"))
    u, v = geo.pixel(depth, right, below, F.col("hfov_deg"), F.col("width"), F.col("height"))
    inside = (u >= 0) & (u < F.col("width")) & (v >= 0) & (v < F.col("height"))
    return f.select("episode_id", "frame_idx", scaled(u, 1).alias("u_e1"), scaled(v, 1).alias("v_e1"), F.coalesce(inside, F.lit(False)).alias("in_image"))


def visibility_score(spark, d):
    cam = episodes(spark, d).select("episode_id", F.radians("camera_config.hfov_deg").alias("hfov"))
    f = frames(spark, d).join(cam, "episode_id")
    s = geo.visibility_score(F.coalesce("target_visible", F.lit(False)), F.col("drone_bearing_to_target_rad"), F.col("hfov") / 2)
    return f.select("episode_id", "frame_idx", scaled(s).alias("score_e4"))


def action_labels(spark, d):
    a = kinematics.actions(frames(spark, d))
    return a.select("episode_id", "frame_idx", *[scaled(F.col(c), 3).alias(f"{c}_e3") for c in ("dx", "dy", "dz", "turn")], "action", "degrees", "visible")


def velocity_central(spark, d):
    v = kinematics.velocities(frames(spark, d))
    return v.select("episode_id", "frame_idx", scaled(F.col("vx"), 3).alias("vx_e3"), scaled(F.col("vy"), 3).alias("vy_e3"))


def heading_carry(spark, d):
    return kinematics.headings(frames(spark, d)).select("episode_id", "frame_idx", scaled(F.col("heading"), 4).alias("heading_e4"))


def behavior_class(spark, d):
    b = kinematics.behavior(frames(spark, d))
    return b.select("episode_id", "direction_changes", scaled(F.col("turn_std"), 2).alias("turn_std_e2"), scaled(F.col("occluded")).alias("occluded_e4"), "behavior")


def lookahead_occlusion(spark, d):
    r = kinematics.lookahead(frames(spark, d))
    return r.select("episode_id", "frame_idx", "hidden", scaled(F.col("risk")).alias("risk_e4"))


def smoothed_distance(spark, d):
    s = kinematics.smoothed(frames(spark, d), "drone_distance_m")
    return s.select("episode_id", "frame_idx", scaled(F.col("smoothed"), 3).alias("smoothed_e3"))


def stride_sample(spark, d):
    f = annotate(frames(spark, d).select("episode_id", "frame_idx"), "episode_id", "frame_idx", running={"n": F.lit(1)})
    return f.where((F.col("n") - 1) % 5 == 0).select("episode_id", "frame_idx")


def trail_window(spark, d):
    """Summed distance (in millimetres) and number of frames over the four frames before and two after. The trail is short, so rows go to chunks with a margin
    of neighbours rather than to one task per episode."""
    f = frames(spark, d).select("episode_id", "frame_idx", scaled(F.coalesce("drone_distance_m", F.lit(0.0)), 3).alias("x"))
    for i in range(1, 5):
        f = annotate(f, "episode_id", "frame_idx", lag={f"p{i}": F.col("x" if i == 1 else f"p{i - 1}")})
    for i in (1, 2):
        f = annotate(f, "episode_id", "frame_idx", lead={f"n{i}": F.col("x" if i == 1 else f"n{i - 1}")})
    names = ["x", "p1", "p2", "p3", "p4", "n1", "n2"]
    total = sum((F.coalesce(n, F.lit(0)) for n in names), F.lit(0).cast("bigint"))
    count = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    return f.select("episode_id", "frame_idx", total.alias("total_e3"), count.alias("frames"))


def first_visible(spark, d):
    f = frames(spark, d).where("target_visible")
    return f.groupBy("episode_id").agg(F.min_by(F.struct("frame_idx", "tracker_mode"), "frame_idx").alias("f"), F.count(F.lit(1)).alias("visible")).select("episode_id", "f.frame_idx", "visible")


def top_frames(spark, d):
    """The three frames with the highest occlusion risk of each episode; ties go to the first frame. Each task keeps its
    own three before the shuffle."""
    f = frames(spark, d).where("occlusion_risk is not null").select("episode_id", "frame_idx", "occlusion_risk")
    w = Window.partitionBy("episode_id").orderBy(F.desc("occlusion_risk"), "frame_idx")
    return f.withColumn("place", F.row_number().over(w)).where("place <= 3").select("episode_id", "place", "frame_idx", scaled(F.col("occlusion_risk")).alias("risk_e4"))


def policy_comparison(spark, d):
    """Two tracker modes of a scene side by side: frames, mean distance and share seen under each."""
    f = frames(spark, d).join(episodes(spark, d).select("episode_id", "scene_id"), "episode_id")
    f = f.withColumn("mode", F.regexp_replace(F.lower("tracker_mode"), "[^a-z]", ""))
    side = lambda m: f.where(F.col("mode") == m).groupBy("scene_id").agg(F.count(F.lit(1)).alias(f"{m}_frames"), scaled(F.avg(F.coalesce("target_visible", F.lit(False)).cast("double"))).alias(f"{m}_seen_e4"))
    return side("track").join(side("search"), "scene_id")


def initial_poses(spark, d):
    e = episodes(spark, d).select("episode_id", parse_pose("uav_initial_pose").alias("u"), parse_pose("target_initial_pose").alias("t"))
    return e.select("episode_id", *[scaled(F.col(f"{p}.{c}"), 3).alias(f"{p}_{c}_e3") for p in "ut" for c in ("x", "y", "z")], scaled(F.col("u.yaw"), 3).alias("u_yaw_e3"))


def environment_json(spark, d):
    e = episodes(spark, d)
    get = lambda c, p: F.get_json_object(c, p)
    return e.select("episode_id", get("environment_summary", "$.weather").alias("weather"), get("environment_summary", "$.buildings").cast("int").alias("buildings"), get("occluder_summary", "$.kinds[0]").alias("first_kind"), scaled(get("occluder_summary", "$.density").cast("double")).alias("density_e4"))


def session_gaps(spark, d):
    """Pauses: stretches of frames without a gap over one second, by a running count of gaps."""
    f = annotate(frames(spark, d).where("timestamp_s is not null").select("episode_id", "frame_idx", "timestamp_s"), "episode_id", "frame_idx", lag={"t0": F.col("timestamp_s")})
    cut = (F.col("t0").isNull() | (F.col("timestamp_s") - F.col("t0") > 1.0)).cast("int")
    f = annotate(f.withColumn("cut", cut), "episode_id", "frame_idx", running={"session": F.col("cut")})
    return f.groupBy("episode_id", "session").agg(F.count(F.lit(1)).alias("frames"), F.min("frame_idx").alias("first_frame"), F.max("frame_idx").alias("last_frame"))


QUERIES = {
    q.__name__: q
    for q in (
        episode_metrics, redetection_metrics, metrics_summary, consistency_report, reason_counts, report_cube, report_rollup, tier_counts, visible_runs,
        relative_geometry, pixel_projection, visibility_score, action_labels, velocity_central, heading_carry, behavior_class, lookahead_occlusion,
        smoothed_distance, stride_sample, trail_window, first_visible, top_frames, policy_comparison, initial_poses, environment_json, session_gaps,
    )
}

# SQL ----------------------------------------------------------------------------------------------------------------


def _fin(c: str) -> str:
    return f"CASE WHEN isfinite({c}) THEN {c} END"


_POSES = ", ".join(f"any_value({_fin(f'{p}.{c}')}) AS {n}_{c}" for p, n in (("drone_pose_world", "uav"), ("target_pose_world", "target")) for c in ("x", "y", "z", "yaw"))
_NUMBERS = ", ".join(f"any_value({_fin(c)}) AS {c}" for c in ("timestamp_s", "occlusion_risk", "drone_distance_m", "drone_bearing_to_target_rad"))
_VELOCITY = ", ".join(f"any_value({_fin(f'target_velocity[{i}]')}) AS v{c}" for i, c in ((1, "x"), (2, "y"), (3, "z")))
FRAMES = f"""fr AS (
  SELECT episode_id, frame_idx, any_value(target_visible) AS target_visible, any_value(in_camera_frustum) AS in_camera_frustum, any_value(line_of_sight_clear) AS line_of_sight_clear,
         any_value(collision) AS collision, any_value(tracker_mode) AS tracker_mode, {_NUMBERS}, {_POSES}, {_VELOCITY}
  FROM frame_records WHERE episode_id IS NOT NULL AND frame_idx IS NOT NULL GROUP BY 1, 2)"""
EPISODES = "ep AS (SELECT * FROM episodes WHERE episode_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY received_at DESC) = 1)"


def e(x: str, k: int = 4) -> str:
    return f"CAST(floor(({x}) * 1e{k} + 0.5) AS BIGINT)"


_RUNS = """m0 AS (SELECT episode_id, frame_idx, coalesce(target_visible, false) AS vis FROM fr),
m1 AS (SELECT *, CASE WHEN vis IS NOT DISTINCT FROM lag(vis) OVER w THEN 0 ELSE 1 END AS s FROM m0 WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx)),
m2 AS (SELECT *, sum(s) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS run FROM m1),
rn AS (SELECT episode_id, run, any_value(vis) AS visible, count(*) AS length, min(frame_idx) AS first_order, max(frame_idx) AS last_order FROM m2 GROUP BY 1, 2)"""
_METRICS = f"""WITH {FRAMES}, {EPISODES}, {_RUNS},
rk AS (SELECT *, max(run) OVER (PARTITION BY episode_id) AS k FROM rn),
ra AS (
  SELECT episode_id, max(length) FILTER (visible) AS longest, count(*) FILTER (visible) AS vruns, sum(length) FILTER (visible) AS vis, coalesce(sum(length) FILTER (NOT visible), 0) AS lost,
         count(*) FILTER (NOT visible AND run < k) AS red, coalesce(sum(length) FILTER (NOT visible AND run < k), 0) AS redf,
         count(*) FILTER (NOT visible AND run < k AND run > 1) AS rea, coalesce(sum(length) FILTER (NOT visible AND run < k AND run > 1), 0) AS reaf
  FROM rk GROUP BY 1),
pp AS (SELECT episode_id, frame_idx, uav_x x, uav_y y, uav_z z FROM fr WHERE uav_x IS NOT NULL AND uav_y IS NOT NULL AND uav_z IS NOT NULL),
ps AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS step FROM pp WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx)),
pa AS (SELECT episode_id, coalesce(sum(step), 0) AS len, count(*) AS pts, sqrt((arg_max(x, frame_idx) - arg_min(x, frame_idx)) ** 2 + (arg_max(y, frame_idx) - arg_min(y, frame_idx)) ** 2 + (arg_max(z, frame_idx) - arg_min(z, frame_idx)) ** 2) AS net FROM ps GROUP BY 1),
fa AS (SELECT episode_id, count(*) AS n, count(*) FILTER (coalesce(collision, false)) AS col, CASE WHEN count(timestamp_s) >= 2 THEN (arg_max(timestamp_s, frame_idx) - arg_min(timestamp_s, frame_idx)) / (count(timestamp_s) - 1) END AS dt0 FROM fr GROUP BY 1),
mm AS (
  SELECT coalesce(ep.episode_id, fa.episode_id) AS episode_id, difficulty_level, coalesce(n, 0) AS n, coalesce(longest, 0) AS longest, coalesce(vruns, 0) AS vruns, coalesce(vis, 0) AS vis, coalesce(lost, 0) AS lost,
         coalesce(red, 0) AS red, coalesce(redf, 0) AS redf, coalesce(rea, 0) AS rea, coalesce(reaf, 0) AS reaf, coalesce(col, 0) AS col, coalesce(len, 0) AS len, coalesce(pts, 0) AS pts, net, CASE WHEN dt0 > 1e-6 THEN dt0 END AS dt
  FROM ep FULL JOIN fa USING (episode_id) LEFT JOIN ra USING (episode_id) LEFT JOIN pa USING (episode_id)),
mt AS (
  SELECT *, CASE WHEN n > 0 THEN vis / n ELSE 0 END AS visibility_ratio, CASE WHEN n > 0 THEN longest / n ELSE 0 END AS continuity, CASE WHEN vruns > 0 THEN vis / vruns ELSE 0 END AS seg, CASE WHEN rea > 0 THEN reaf / rea ELSE 0 END AS reaq,
         CASE WHEN red > 0 THEN (redf + red) / red ELSE 0 END AS redq, CASE WHEN n > 0 THEN col / n ELSE 0 END AS colr, CASE WHEN pts >= 2 AND len > 1e-6 THEN least(1.0, net / len) END AS eff,
         n > 0 AND col = 0 AND CASE WHEN n > 0 THEN vis / n ELSE 0 END >= CASE difficulty_level WHEN 'hard' THEN 0.60 ELSE 0.70 END AS tracking_success
  FROM mm)"""
_SERIES = f"""{_METRICS}, se AS (
  SELECT episode_id, n AS total_frames, visibility_ratio AS track_auc, CASE WHEN n > 0 THEN lost / n ELSE 0 END AS lost_rate, red AS redetection_events, redq * coalesce(dt, 0.05) AS redetection_time_s, colr AS collision_rate, n * coalesce(dt, 0.05) AS duration_s FROM mt)"""


def _summary_sql() -> str:
    one = lambda m: f"SELECT '{m}' AS metric, {e(f'avg({m})')} AS mean_e4, {e(f'min({m})')} AS min_e4, {e(f'max({m})')} AS max_e4, {e(f'quantile_cont(CAST({m} AS DOUBLE), 0.1)')} AS p10_e4 FROM se"
    return _SERIES + " UNION ALL ".join(one(m) for m in ("track_auc", "lost_rate", "redetection_time_s", "collision_rate", "total_frames"))


_PAIR = "uav_x IS NOT NULL AND target_x IS NOT NULL AND uav_yaw IS NOT NULL"
_PI = "pi()"
_WRAP = lambda x: f"((({x}) + pi()) - 2 * pi() * floor((({x}) + pi()) / (2 * pi())) - pi())"
_ORDER = "(PARTITION BY episode_id ORDER BY frame_idx)"
_DX, _DY, _DZ = ("(target_{0} - uav_{0})".format(c) for c in "xyz")
_F = f"(cos(uav_yaw) * {_DX} + sin(uav_yaw) * {_DY} - body_forward_m)"
_R = f"(-sin(uav_yaw) * {_DX} + cos(uav_yaw) * {_DY})"
_DOWN = f"({_DZ} - body_down_m)"
_HEADINGS = f"""h0 AS (SELECT *, target_x - lag(target_x) OVER w AS dx, target_y - lag(target_y) OVER w AS dy FROM fr WHERE target_x IS NOT NULL AND target_y IS NOT NULL WINDOW w AS {_ORDER}),
h1 AS (SELECT *, CASE WHEN sqrt(dx * dx + dy * dy) > 1e-3 THEN atan2(dy, dx) END AS h FROM h0),
hd AS (SELECT episode_id, frame_idx, target_visible, line_of_sight_clear, coalesce(last_value(h IGNORE NULLS) OVER w, 0.0) AS heading FROM h1 WINDOW w AS {_ORDER})"""

ORACLE = {
    "episode_metrics": _METRICS
    + f"""SELECT episode_id, difficulty_level, n AS total_frames, tracking_success, lost AS lost_frames, rea AS reacquisition_events, col > 0 AS collision_flag,
      {e('visibility_ratio')} AS visibility_ratio_e4, {e('continuity')} AS continuity_e4, {e('colr')} AS collision_rate_e4, {e('eff')} AS path_efficiency_e4,
      {e('seg', 3)} AS avg_visible_segment_e3, {e('lost * dt', 3)} AS lost_duration_s_e3, {e('reaq', 3)} AS reacquisition_frames_e3, {e('reaq * dt', 3)} AS reacquisition_s_e3, {e('len', 3)} AS path_length_e3 FROM mt""",
    "redetection_metrics": _SERIES + f"SELECT episode_id, redetection_events, {e('track_auc')} AS track_auc_e4, {e('lost_rate')} AS lost_rate_e4, {e('redetection_time_s')} AS redetection_time_s_e4, {e('duration_s')} AS duration_s_e4 FROM se",
    "metrics_summary": _summary_sql(),
    "consistency_report": _METRICS
    + f"""SELECT CASE WHEN coalesce(difficulty_level, '') = '' THEN 'unknown' ELSE difficulty_level END AS group_name, count(*) AS episodes, count(*) FILTER (tracking_success) AS successes, count(*) FILTER (col > 0) AS with_collision,
      {e('avg(visibility_ratio)')} AS mean_visibility_ratio_e4, {e('avg(continuity)')} AS mean_continuity_e4, {e('avg(len)')} AS mean_path_length_e4, {e('avg(eff)')} AS mean_path_efficiency_e4 FROM mt GROUP BY 1""",
    "reason_counts": f"""WITH {FRAMES}, q AS (SELECT episode_id, CASE WHEN target_visible THEN 'ok' WHEN drone_distance_m > 80 THEN 'out_of_range'
      WHEN NOT coalesce(in_camera_frustum, abs(drone_bearing_to_target_rad) <= 0.4363) THEN 'out_of_fov' WHEN NOT coalesce(line_of_sight_clear, true) THEN 'los_blocked' ELSE 'los_blocked_occluder' END AS r FROM fr)
      SELECT episode_id, count(*) AS frames, """
    + ", ".join(f"count(*) FILTER (r = '{k}') AS {n}" for k, n in (("ok", "visible"), ("ok", "ok"), ("out_of_range", "out_of_range"), ("out_of_fov", "out_of_fov"), ("los_blocked", "los_blocked"), ("los_blocked_occluder", "los_blocked_occluder")))
    + " FROM q GROUP BY 1",
    "report_cube": f"WITH {EPISODES} SELECT difficulty, behavior, count(*) AS episodes, count(DISTINCT scene_id) AS scenes FROM (SELECT scene_id, coalesce(difficulty_level, 'unknown') AS difficulty, coalesce(target_behavior_type, 'unknown') AS behavior FROM ep) GROUP BY CUBE (difficulty, behavior)",
    "report_rollup": f"WITH {EPISODES} SELECT scene_id, difficulty, count(*) AS episodes FROM (SELECT scene_id, coalesce(difficulty_level, 'unknown') AS difficulty FROM ep) GROUP BY ROLLUP (scene_id, difficulty)",
    "tier_counts": f"WITH {EPISODES} SELECT coalesce(nullif(difficulty_level, ''), '?') AS tier, count(*) AS episodes, list_sort(list(DISTINCT target_class) FILTER (target_class IS NOT NULL)) AS classes FROM ep GROUP BY 1",
    "visible_runs": f"WITH {FRAMES}, {_RUNS} SELECT * FROM rn",
    "relative_geometry": f"WITH {FRAMES} SELECT episode_id, frame_idx, {e(f'atan2({_DY}, {_DX})', 3)} AS bearing_e3, {e(f'sqrt({_DX} * {_DX} + {_DY} * {_DY})', 3)} AS horizontal_e3, {e(f'sqrt({_DX} * {_DX} + {_DY} * {_DY} + {_DZ} * {_DZ})', 3)} AS distance_e3, {e(_WRAP(f'atan2({_DY}, {_DX}) - uav_yaw'), 3)} AS off_e3, {e('uav_x', 3)} AS map_x_e3, {e('-uav_y', 3)} AS map_y_e3, {e('-uav_z', 3)} AS altitude_e3 FROM fr WHERE {_PAIR}",
    "pixel_projection": f"""WITH {FRAMES}, {EPISODES}, c AS (SELECT fr.*, cc.* FROM fr JOIN (SELECT episode_id AS eid, unnest(camera_config) FROM ep) cc ON eid = episode_id WHERE width IS NOT NULL AND height IS NOT NULL AND {_PAIR}),
      k AS (SELECT *, cos(radians(pitch_deg)) * {_F} + sin(radians(pitch_deg)) * {_DOWN} AS depth, {_R} AS rt, -sin(radians(pitch_deg)) * {_F} + cos(radians(pitch_deg)) * {_DOWN} AS bl, (width / 2.0) / tan(radians(hfov_deg) / 2) AS foc FROM c),
      x AS (SELECT *, CASE WHEN depth > 1e-3 THEN width / 2.0 + foc * rt / depth END AS u, CASE WHEN depth > 1e-3 THEN height / 2.0 + foc * bl / depth END AS v FROM k)
      SELECT episode_id, frame_idx, {e('u', 1)} AS u_e1, {e('v', 1)} AS v_e1, coalesce(u >= 0 AND u < width AND v >= 0 AND v < height, false) AS in_image FROM x""",
    "visibility_score": f"WITH {FRAMES}, {EPISODES}, c AS (SELECT fr.*, radians(camera_config.hfov_deg) / 2 AS half FROM fr JOIN ep USING (episode_id)) SELECT episode_id, frame_idx, {e('CASE WHEN NOT coalesce(target_visible, false) THEN 0.0 WHEN drone_bearing_to_target_rad IS NULL OR half IS NULL THEN 1.0 ELSE 0.1 + 0.9 * greatest(0.0, 1.0 - abs(drone_bearing_to_target_rad) / half) END')} AS score_e4 FROM c",
    "action_labels": f"""WITH {FRAMES}, a AS (SELECT episode_id, frame_idx, target_visible, coalesce(uav_x - lag(uav_x) OVER w, 0) AS dx, coalesce(uav_y - lag(uav_y) OVER w, 0) AS dy, coalesce(uav_z - lag(uav_z) OVER w, 0) AS dz, coalesce({_WRAP('uav_yaw - lag(uav_yaw) OVER w')}, 0) AS turn FROM fr WINDOW w AS {_ORDER})
      SELECT episode_id, frame_idx, {e('dx', 3)} AS dx_e3, {e('dy', 3)} AS dy_e3, {e('dz', 3)} AS dz_e3, {e('turn', 3)} AS turn_e3, CASE WHEN abs(degrees(turn)) > 8 THEN CASE WHEN turn > 0 THEN 'right' ELSE 'left' END ELSE 'move' END AS action,
      CASE WHEN abs(degrees(turn)) > 8 THEN CAST(abs(round_even(degrees(turn), 0)) AS INT) ELSE 0 END AS degrees, coalesce(CAST(target_visible AS INT), 0) AS visible FROM a""",
    "velocity_central": f"""WITH {FRAMES}, a AS (SELECT *, coalesce(lag(timestamp_s) OVER w, timestamp_s) AS t0, coalesce(lead(timestamp_s) OVER w, timestamp_s) AS t1, coalesce(lag(target_x) OVER w, target_x) AS x0, coalesce(lead(target_x) OVER w, target_x) AS x1,
      coalesce(lag(target_y) OVER w, target_y) AS y0, coalesce(lead(target_y) OVER w, target_y) AS y1 FROM fr WHERE target_x IS NOT NULL AND target_y IS NOT NULL AND timestamp_s IS NOT NULL WINDOW w AS {_ORDER})
      SELECT episode_id, frame_idx, {e('coalesce(vx, (x1 - x0) / greatest(t1 - t0, 1e-6))', 3)} AS vx_e3, {e('coalesce(vy, (y1 - y0) / greatest(t1 - t0, 1e-6))', 3)} AS vy_e3 FROM a""",
    "heading_carry": f"WITH {FRAMES}, {_HEADINGS} SELECT episode_id, frame_idx, {e('heading')} AS heading_e4 FROM hd",
    "behavior_class": f"""WITH {FRAMES}, {_HEADINGS}, t0 AS (SELECT *, degrees({_WRAP('heading - lag(heading) OVER w')}) AS turn FROM hd WINDOW w AS {_ORDER}),
      t1 AS (SELECT *, CASE WHEN abs(turn) > 8 THEN sign(turn) END AS sg FROM t0), t2 AS (SELECT *, last_value(sg IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lst FROM t1),
      b AS (SELECT episode_id, count(*) AS n, coalesce(stddev_pop(turn), 0) AS turn_std, count(*) FILTER (sg IS NOT NULL AND lst IS NOT NULL AND sg <> lst) AS direction_changes, avg(CAST(NOT coalesce(line_of_sight_clear, target_visible, true) AS INT)) AS occluded FROM t2 GROUP BY 1)
      SELECT episode_id, direction_changes, {e('turn_std', 2)} AS turn_std_e2, {e('occluded')} AS occluded_e4, CASE WHEN occluded >= 0.12 THEN 'cover_using' WHEN n < 3 THEN 'straight' WHEN turn_std >= 35 THEN 'dodging' WHEN direction_changes >= 4 THEN 'zigzag' ELSE 'straight' END AS behavior FROM b""",
    "lookahead_occlusion": f"""WITH {FRAMES}, a AS (SELECT episode_id, frame_idx, CASE WHEN coalesce(line_of_sight_clear, true) THEN 0 ELSE 1 END AS h FROM fr),
      b AS (SELECT *, lead(h, 1) OVER w AS n1, lead(h, 2) OVER w AS n2, lead(h, 3) OVER w AS n3, lead(h, 4) OVER w AS n4, last_value(h) OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM a WINDOW w AS {_ORDER})
      SELECT episode_id, frame_idx, h AS hidden, {e('(h + coalesce(n1, l) + coalesce(n2, l) + coalesce(n3, l) + coalesce(n4, l)) / 5.0')} AS risk_e4 FROM b""",
    "stride_sample": f"WITH {FRAMES} SELECT episode_id, frame_idx FROM fr QUALIFY (row_number() OVER {_ORDER} - 1) % 5 = 0",
    "trail_window": f"WITH {FRAMES}, a AS (SELECT episode_id, frame_idx, {e('coalesce(drone_distance_m, 0.0)', 3)} AS x FROM fr) SELECT episode_id, frame_idx, CAST(sum(x) OVER w AS BIGINT) AS total_e3, count(*) OVER w AS frames FROM a WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND 2 FOLLOWING)",
    "first_visible": f"WITH {FRAMES} SELECT episode_id, min(frame_idx) AS frame_idx, count(*) AS visible FROM fr WHERE target_visible GROUP BY 1",
    "top_frames": f"WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY occlusion_risk DESC, frame_idx) AS place FROM fr WHERE occlusion_risk IS NOT NULL) SELECT episode_id, place, frame_idx, {e('occlusion_risk')} AS risk_e4 FROM r WHERE place <= 3",
    "policy_comparison": f"""WITH {FRAMES}, {EPISODES}, m AS (SELECT scene_id, regexp_replace(lower(tracker_mode), '[^a-z]', '', 'g') AS mode, coalesce(target_visible, false) AS vis FROM fr JOIN ep USING (episode_id)),
      a AS (SELECT scene_id, count(*) AS track_frames, {e('avg(CAST(vis AS INT))')} AS track_seen_e4 FROM m WHERE mode = 'track' GROUP BY 1), b AS (SELECT scene_id, count(*) AS search_frames, {e('avg(CAST(vis AS INT))')} AS search_seen_e4 FROM m WHERE mode = 'search' GROUP BY 1)
      SELECT * FROM a JOIN b USING (scene_id)""",
    "initial_poses": f"""WITH {EPISODES}, p AS (SELECT episode_id, CASE WHEN json_valid(uav_initial_pose) THEN uav_initial_pose END AS u, CASE WHEN json_valid(target_initial_pose) THEN target_initial_pose END AS t FROM ep), q AS (SELECT episode_id, """
    + ", ".join(f"TRY_CAST(coalesce(json_extract_string({p}, '$[{i}]'), json_extract_string({p}, '$.pos[{i}]'), json_extract_string({p}, '$.{c}')) AS DOUBLE) AS {p}{c}" for p in "ut" for i, c in enumerate("xyz"))
    + ", TRY_CAST(coalesce(json_extract_string(u, '$[3]'), json_extract_string(u, '$.yaw'), json_extract_string(u, '$.heading')) AS DOUBLE) AS yaw FROM p) SELECT episode_id, "
    + ", ".join(f"CASE WHEN {p}x IS NOT NULL AND {p}y IS NOT NULL AND {p}z IS NOT NULL THEN {e(p + c, 3)} END AS {p}_{c}_e3" for p in "ut" for c in "xyz")
    + f", CASE WHEN ux IS NOT NULL AND uy IS NOT NULL AND uz IS NOT NULL THEN {e('yaw', 3)} END AS u_yaw_e3 FROM q",
    "environment_json": f"WITH {EPISODES} SELECT episode_id, json_extract_string(environment_summary, '$.weather') AS weather, CAST(json_extract_string(environment_summary, '$.buildings') AS INT) AS buildings, json_extract_string(occluder_summary, '$.kinds[0]') AS first_kind, {e('CAST(json_extract_string(occluder_summary, ' + chr(39) + '$.density' + chr(39) + ') AS DOUBLE)')} AS density_e4 FROM ep",
    "session_gaps": f"""WITH {FRAMES}, a AS (SELECT *, CASE WHEN timestamp_s - lag(timestamp_s) OVER w <= 1.0 THEN 0 ELSE 1 END AS cut FROM fr WHERE timestamp_s IS NOT NULL WINDOW w AS {_ORDER}), b AS (SELECT *, sum(cut) OVER {_ORDER} AS session FROM a)
      SELECT episode_id, session, count(*) AS frames, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame FROM b GROUP BY 1, 2""",
    "smoothed_distance": f"""WITH RECURSIVE {FRAMES}, a AS (SELECT episode_id, frame_idx, drone_distance_m AS new, row_number() OVER w AS i, least(1.0, greatest(0.0, (timestamp_s - lag(timestamp_s) OVER w) / 0.5)) AS s FROM fr WHERE drone_distance_m IS NOT NULL AND timestamp_s IS NOT NULL WINDOW w AS {_ORDER}),
      r AS (SELECT episode_id, i, frame_idx, new AS x FROM a WHERE i = 1 UNION ALL SELECT a.episode_id, a.i, a.frame_idx, r.x + a.s * (a.new - r.x) FROM r JOIN a ON a.episode_id = r.episode_id AND a.i = r.i + 1)
      SELECT episode_id, frame_idx, {e('x', 3)} AS smoothed_e3 FROM r""",
}
