"""Queries over projections, names, labels and tracks, and SQL for them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skylattice.functions import geo
from skylattice.functions.poses import parse_pose
from skylattice.operators import kinematics, metrics, policies, text, validation
from skylattice.operators.metrics import scaled
from skylattice.operators.sequence import annotate
from skylattice.plans.tracking import EPISODES, FRAMES, e, episodes, frames
from skylattice.session import table

BOX = (-200.0, 200.0, -200.0, 200.0)
#: A camera as it stands in a reconstruction, and the scale of its images here.
CAMERA, SCALE = "0 PINHOLE 1920 1080 960.0 962.5 960.0 540.0", 0.25
WEDGE, STEP = 30.0, 5.0


def _digits(columns: dict[str, int]) -> list:
    return [scaled(F.col(c), k).alias(f"{c}_e{k}") for c, k in columns.items()]


def engine_coordinates(spark, d):
    """Drone poses in the engine's centimetres and degrees."""
    f = frames(spark, d).where("uav_x is not null and uav_y is not null and uav_z is not null")
    x, y, z = geo.ned_to_engine(*geo.ned_to_map(*[F.col(f"uav_{c}") for c in "xyz"]))
    f = f.select("episode_id", "frame_idx", x.alias("ex"), y.alias("ey"), z.alias("ez"), geo.map_yaw_to_engine_degrees(F.col("uav_yaw")).alias("yaw"))
    return f.select("episode_id", "frame_idx", *_digits({"ex": 1, "ey": 1, "ez": 1, "yaw": 2}))


def box_motion(spark, d):
    """Whether a target is in the box, where it is when held in it, and its velocity after a bounce."""
    f = frames(spark, d).where("target_x is not null and target_y is not null and vx is not null and vy is not null")
    x, y = F.col("target_x"), F.col("target_y")
    f = f.select("episode_id", "frame_idx", geo.inside_box(x, y, BOX).alias("inside"), geo.clamp(x, *BOX[:2]).alias("x"), geo.clamp(y, *BOX[2:]).alias("y"), geo.reflected(x, F.col("vx"), *BOX[:2]).alias("vx"), geo.reflected(y, F.col("vy"), *BOX[2:]).alias("vy"))
    return f.select("episode_id", "frame_idx", "inside", *_digits({"x": 3, "y": 3, "vx": 3, "vy": 3}))


def quaternion_headings(spark, d):
    """Headings read back from a quaternion of yaw and camera pitch."""
    cam = episodes(spark, d).select("episode_id", F.radians("camera_config.pitch_deg").alias("pitch"))
    f = frames(spark, d).where("uav_yaw is not null").join(cam.where("pitch is not null"), "episode_id")
    cy, sy, cp, sp = F.cos(F.col("uav_yaw") / 2), F.sin(F.col("uav_yaw") / 2), F.cos(F.col("pitch") / 2), F.sin(F.col("pitch") / 2)
    yaw = geo.quaternion_yaw(cy * cp, -sy * sp, cy * sp, sy * cp)
    return f.select("episode_id", "frame_idx", scaled(F.sin(yaw), 4).alias("sin_e4"), scaled(F.cos(yaw), 4).alias("cos_e4"))


def occluded_frames(spark, d):
    """Occluded: what is recorded, else whether the reason is exactly a blocked line of sight."""
    reason = metrics.visibility_reason()
    f = frames(spark, d).select("episode_id", "frame_idx", reason.alias("reason"), F.coalesce(~F.col("line_of_sight_clear"), reason == "los_blocked").alias("is_occluded"))
    return f


def action_vector(spark, d):
    a = kinematics.action_vectors(frames(spark, d))
    return a.select("episode_id", "frame_idx", *_digits({c: 3 for c in ("dx", "dy", "dz", "turn", "vx", "vy", "vz")}), F.col("visible").cast("int").alias("visible"))


def camera_projection(spark, d):
    """Targets in the image of a camera at the drone's place, by rotation matrix and intrinsics, and the ground point of
    the pixel on the plane of the target's height, rounded to metres."""
    cam = episodes(spark, d).select("episode_id", F.coalesce("camera_config.pitch_deg", F.lit(0.0)).cast("double").alias("pitch"))
    f = frames(spark, d).where("uav_x is not null and uav_y is not null and uav_z is not null and uav_yaw is not null and target_x is not null and target_y is not null and target_z is not null").join(cam, "episode_id")
    k = geo.intrinsics(F.lit(CAMERA), SCALE)
    # map axes: y and z are turned over, and so is the heading
    camera, point = ([F.col(f"{n}_x"), -F.col(f"{n}_y"), -F.col(f"{n}_z")] for n in ("uav", "target"))
    f = f.withColumn("k", k).withColumn("r", geo.packed(geo.extrinsics(F.degrees("uav_yaw"), -F.col("pitch"), F.lit(0.0))))
    rotation = geo.unpacked(F.col("r"))
    u, v, depth, valid = geo.projected(rotation, camera, point, F.col("k"))
    f = f.withColumns({"u": u, "v": v, "depth": depth, "valid": valid}).where("abs(depth) < 1e6")
    gx, gy = geo.ground_point(rotation, camera, F.col("u"), F.col("v"), F.col("k"), point[2])
    near = F.col("valid") & (F.abs(camera[2] - point[2]) > 0.5)
    f = f.select("episode_id", "frame_idx", "u", "v", "depth", "valid", F.when(near, F.abs(gx - point[0]) + F.abs(gy - point[1]) < 0.01).alias("meets_target"))
    return f.select("episode_id", "frame_idx", scaled(F.col("depth"), 2).alias("depth_e2"), "valid", *[F.when(F.col("valid"), scaled(F.col(c), 1)).alias(f"{c}_e1") for c in ("u", "v")], "meets_target")


def episode_names(spark, d):
    """The name an episode gets from its scene, behaviour, level, seed and number."""
    ep = episodes(spark, d).where("random_seed is not null")
    name = F.format_string("%s_%s_%s_seed%d_%03d", F.coalesce("scene_id", F.lit("")), F.coalesce("target_behavior_type", F.lit("")), F.coalesce("difficulty_level", F.lit("")), "random_seed", F.pmod("random_seed", F.lit(100)))
    return ep.select("episode_id", name.alias("name"))


def fov_centering(spark, d):
    f = frames(spark, d).where("uav_x is not null and uav_y is not null and uav_yaw is not null and target_x is not null and target_y is not null")
    ox, oy = geo.centering_offset(F.col("target_x") - F.col("uav_x"), F.col("target_y") - F.col("uav_y"), F.col("uav_yaw"))
    return f.select("episode_id", "frame_idx", ox.alias("ox"), oy.alias("oy")).select("episode_id", "frame_idx", *_digits({"ox": 3, "oy": 3}))


def frustum_wedges(spark, d):
    cam = episodes(spark, d).select("episode_id", F.col("camera_config.hfov_deg").cast("double").alias("hfov")).where("hfov is not null")
    f = frames(spark, d).where("uav_x is not null and uav_y is not null and uav_yaw is not null").join(cam, "episode_id")
    w = f.select("episode_id", "frame_idx", F.posexplode(geo.frustum_wedge(F.col("uav_x"), F.col("uav_y"), F.col("uav_yaw"), F.col("hfov"), WEDGE)).alias("corner", "p"))
    return w.select("episode_id", "frame_idx", "corner", scaled(F.col("p.x"), 2).alias("x_e2"), scaled(F.col("p.y"), 2).alias("y_e2"))


def valid_poses(spark, d):
    """Whether the pose of each record (its heading as a quaternion) is one."""
    p = F.col("target_pose_world")
    none = F.lit(0.0)
    f = table(spark, d, "frame_records").where(p.isNotNull())
    return f.select("record_id", geo.valid_pose(p["x"], p["y"], p["z"], F.cos(p["yaw"] / 2), none, none, F.sin(p["yaw"] / 2)).alias("valid"))


def last_labels(spark, d):
    return text.last_known(frames(spark, d), "episode_id", "frame_idx", F.lower(F.trim("tracker_mode")))


def first_values(spark, d):
    r = text.first_known(frames(spark, d).select("episode_id", "frame_idx", "tracker_mode", "target_visible", "drone_distance_m"), "episode_id", "frame_idx", ["tracker_mode", "target_visible", "drone_distance_m"])
    return r.select("episode_id", "tracker_mode", "target_visible", scaled(F.col("drone_distance_m"), 3).alias("distance_e3"))


def tier_fills(spark, d):
    """Instruction candidates of each episode from the templates of its tier."""
    ep = episodes(spark, d).withColumn("appearance", text.stand_in_appearance(F.col("episode_id"), F.col("target_class")))
    fills = text.tier_fills(F.col("episode_id"), F.col("difficulty_level"), F.col("appearance"), F.replace(F.col("target_behavior_type"), F.lit("_"), F.lit(" ")), F.lit(text.COVER_PHRASE))
    return ep.select("episode_id", F.posexplode(fills).alias("place", "text"))


def stand_in_appearance(spark, d):
    return episodes(spark, d).select("episode_id", text.stand_in_appearance(F.col("episode_id"), F.col("target_class")).alias("appearance"))


def building_names(spark, d):
    """File names of places and the coordinates read back from them."""
    f = frames(spark, d).where("frame_idx = 0 and abs(target_x) < 1e5 and abs(target_y) < 1e5 and abs(target_z) < 1e5")
    name = F.format_string("seg/x=%dY=%dZ=%d.PNG", *[scaled(F.col(f"target_{c}"), 0) for c in "xyz"])
    f = f.select("episode_id", name.alias("file")).withColumn("p", text.building_coordinates("file"))
    return f.select("episode_id", "file", *[F.col(f"p.{c}").cast("int").alias(c) for c in "xyz"])


def pose_numbers(spark, d):
    """The numbers in an initial pose's text, brackets and names taken out."""
    ep = episodes(spark, d).where("uav_initial_pose is not null").select("episode_id", F.regexp_replace("uav_initial_pose", r'["\[\]{}:]', " ").alias("t"))
    n = text.float_tokens("t")
    return ep.select("episode_id", F.size(n).alias("n"), scaled(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 2).alias("sum_e2"))


def shuffled_reports(spark, d):
    """A batch's reports in a seeded order: their places, without ever sorting more than a batch."""
    from pyspark.sql import Window

    r = table(spark, d, "demo_reports").where("batch_id is not null and report_id is not null").select("batch_id", "report_id").distinct()
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy(F.md5(F.concat_ws("|", F.lit("7"), F.col("report_id").cast("string"))), "report_id"))
    return r.select("batch_id", "report_id", place.alias("place"))


def first_category(spark, d):
    """Target names by the first level, from easy on, that lists them."""
    level = F.lower(F.trim("difficulty"))
    names = table(spark, d, "demo_reports").select(level.alias("category"), F.col("target_name").alias("name"))
    return text.first_category(names, {"easy": 0, "medium": 1, "hard": 2})


def scene_bounds(spark, d):
    """The square of each scene's readable drone and target places, with a margin."""
    f = frames(spark, d).join(episodes(spark, d).select("episode_id", F.coalesce("scene_id", F.lit("?")).alias("scene")), "episode_id")
    p = f.select("scene", F.explode(F.array(*[F.struct(F.col(f"{n}_x").alias("x"), F.col(f"{n}_y").alias("y")) for n in ("uav", "target")])).alias("p")).where("abs(p.x) < 1e5 and abs(p.y) < 1e5")
    b = p.groupBy("scene").agg(*[(fn(f"p.{c}") + m).alias(f"{c}{n}") for c in "xy" for fn, m, n in ((F.min, -10.0, 0), (F.max, 10.0, 1))])
    return b.select("scene", *_digits({"x0": 2, "x1": 2, "y0": 2, "y1": 2}))


def frustum_fraction(spark, d):
    f = frames(spark, d).where("in_camera_frustum is not null")
    return f.groupBy("episode_id").agg(F.count(F.lit(1)).alias("judged"), scaled(F.avg(F.col("in_camera_frustum").cast("double"))).alias("share_e4"))


def filled_times(spark, d):
    return kinematics.filled_times(frames(spark, d)).select("episode_id", "frame_idx", scaled(F.col("timestamp_s"), 3).alias("t_e3"))


def _track(spark, d):
    return frames(spark, d).where("abs(target_x) < 1e5 and abs(target_y) < 1e5")


def track_headings(spark, d):
    h = kinematics.waypoint_headings(_track(spark, d))
    return h.select("episode_id", "frame_idx", scaled(F.col("heading"), 3).alias("heading_e3"))


def track_resample(spark, d):
    """Per episode: places every five metres along the target's way, and their mean."""
    r = kinematics.resampled(_track(spark, d), STEP)
    return r.groupBy("episode_id").agg(F.count(F.lit(1)).alias("places"), F.max("k").alias("last"), scaled(F.avg("x"), 1).alias("x_e1"), scaled(F.avg("y"), 1).alias("y_e1"))


def stuck_resets(spark, d):
    return kinematics.stuck_resets(_track(spark, d))


def spaced_track(spark, d):
    return kinematics.spaced(_track(spark, d), 2.0)


def exponential_distance(spark, d):
    """The drone's distance, smoothed by 1 - exp(-dt / tau)."""
    s = kinematics.smoothed(frames(spark, d), "drone_distance_m", 0.8, exponential=True)
    return s.select("episode_id", "frame_idx", scaled(F.col("smoothed"), 3).alias("smoothed_e3"))


def smoothed_pose(spark, d):
    """The drone's place as a camera that is damped sees it: x and y follow within 0.45 s, z within 1.1 s."""
    f = frames(spark, d).where("abs(uav_x) < 1e5 and abs(uav_y) < 1e5 and abs(uav_z) < 1e5")
    x, y, z = (kinematics.smoothed(f, f"uav_{c}", t).select("episode_id", "frame_idx", scaled(F.col("smoothed"), 3).alias(f"{c}_e3")) for c, t in (("x", 0.45), ("y", 0.45), ("z", 1.1)))
    return x.join(y, ["episode_id", "frame_idx"]).join(z, ["episode_id", "frame_idx"])


def old_tracker(spark, d):
    return policies.old_tracker_modes(frames(spark, d))


def zipped_tracks(spark, d):
    """The n-th known drone place of an episode next to its n-th known target place, as far as both go."""
    def numbered(name):
        f = frames(spark, d).where(f"abs({name}_x) < 1e5 and abs({name}_y) < 1e5").select("episode_id", "frame_idx", f"{name}_x", f"{name}_y")
        return annotate(f, "episode_id", "frame_idx", running={"n": F.lit(1)}).drop("frame_idx")

    both = numbered("uav").join(numbered("target"), ["episode_id", "n"])
    return both.select("episode_id", "n", scaled(F.sqrt((F.col("uav_x") - F.col("target_x")) ** 2 + (F.col("uav_y") - F.col("target_y")) ** 2), 3).alias("gap_e3"))


def car_corners(spark, d):
    """The corners of the car that each target is taken for, on the map."""
    f = frames(spark, d).where("abs(target_x) < 1e5 and abs(target_y) < 1e5 and target_z is not null and target_yaw is not null")
    corners = geo.box_corners(F.col("target_x"), -F.col("target_y"), -F.col("target_z"), -F.col("target_yaw"))
    c = f.select("episode_id", "frame_idx", F.posexplode(corners).alias("corner", "p"))
    return c.select("episode_id", "frame_idx", "corner", *[scaled(F.col(f"p.{a}"), 2).alias(f"{a}_e2") for a in "xyz"])


def color_boxes(spark, d):
    """Where each episode's frames fall in an image of whole metres, coloured by tracker mode; sampled at its first frame."""
    f = frames(spark, d).where("abs(target_x) < 1e5 and abs(target_y) < 1e5")
    n = F.length(F.coalesce("tracker_mode", F.lit("")))
    px = f.select(F.col("episode_id").alias("image"), "frame_idx", F.floor("target_x").cast("int").alias("x"), F.floor("target_y").cast("int").alias("y"), (n * 20).alias("r"), n.alias("g"), F.when(F.coalesce("target_visible", F.lit(False)), 90).otherwise(0).alias("b"))
    first = px.groupBy("image").agg(F.min(F.struct("frame_idx", "r", "g", "b")).alias("s")).select("image", "s.r", "s.g", "s.b")
    return validation.color_boxes(px, first)


QUERIES = {
    q.__name__: q
    for q in (
        engine_coordinates, box_motion, quaternion_headings, occluded_frames, action_vector, camera_projection, episode_names, fov_centering, frustum_wedges, valid_poses,
        last_labels, first_values, tier_fills, stand_in_appearance, building_names, pose_numbers, shuffled_reports, first_category, scene_bounds, frustum_fraction,
        filled_times, track_headings, track_resample, stuck_resets, spaced_track, exponential_distance, smoothed_pose, old_tracker, zipped_tracks, car_corners, color_boxes,
    )
}

# SQL ----------------------------------------------------------------------------------------------------------------


def _wrap(x: str) -> str:
    return f"(({x} + pi()) - 2 * pi() * floor(({x} + pi()) / (2 * pi())) - pi())"


def _clamp(x: str, lo: float, hi: float) -> str:
    return f"greatest({lo}, least({hi}, {x}))"


def _bounce(p: str, v: str) -> str:
    return f"CASE WHEN ({p} <= -200.0 AND {v} < 0) OR ({p} >= 200.0 AND {v} > 0) THEN -{v} * 0.8 ELSE {v} END"


_REASON = """CASE WHEN target_visible THEN 'ok' WHEN drone_distance_m > 80.0 THEN 'out_of_range' WHEN NOT coalesce(in_camera_frustum, abs(drone_bearing_to_target_rad) <= 0.4363) THEN 'out_of_fov'
  WHEN NOT coalesce(line_of_sight_clear, true) THEN 'los_blocked' ELSE 'los_blocked_occluder' END"""
_TRACK = f"WITH {FRAMES}, tk AS (SELECT episode_id, frame_idx, target_x AS x, target_y AS y FROM fr WHERE abs(target_x) < 1e5 AND abs(target_y) < 1e5)"
_LAG = "x AS x1, lag(x) OVER w AS x0, y AS y1, lag(y) OVER w AS y0"
_OVER = "WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx)"
_APPEARANCE = "CASE kind " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(p) for p in v)}]" for k, v in text.STAND_INS.items()) + " END"
_KIND = f"CASE WHEN {' OR '.join(f'contains(low, {w!r})' for w in text.CAR_WORDS)} THEN 'car' WHEN contains(low, 'vehicle') THEN 'vehicle' ELSE 'default' END"
_STAND = f"""WITH {EPISODES}, k0 AS (SELECT *, lower(coalesce(target_class, '')) AS low FROM ep), k1 AS (SELECT *, {_KIND} AS kind FROM k0),
k2 AS (SELECT *, {_APPEARANCE} AS phrases FROM k1), ap AS (SELECT *, phrases[CAST(CAST('0x' || substr(md5(episode_id || '|' || kind), 1, 6) AS BIGINT) % len(phrases) AS INT) + 1] AS appearance FROM k2)"""
_POOL = "CASE tier " + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(p) for p in v)}]" for k, v in text.TIER_TEMPLATES.items()) + " END"
_TIER = "CASE difficulty_level " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.TIERS.items()) + " ELSE 'medium' END"


def _smooth(name: str, column: str, share: str, where: str = "true") -> str:
    """Two recursive steps: the readings in order, and the smoothed value of each."""
    return f"""{name}a AS (SELECT episode_id, frame_idx, {column} AS new, row_number() OVER w AS i, {share} AS s FROM fr WHERE {column} IS NOT NULL AND timestamp_s IS NOT NULL AND {where} {_OVER}),
      {name}r AS (SELECT episode_id, i, frame_idx, new AS x FROM {name}a WHERE i = 1 UNION ALL SELECT a.episode_id, a.i, a.frame_idx, r.x + a.s * (a.new - r.x) FROM {name}r r JOIN {name}a a ON a.episode_id = r.episode_id AND a.i = r.i + 1)"""


_DT = "(timestamp_s - lag(timestamp_s) OVER w)"
_REAL_UAV = "abs(uav_x) < 1e5 AND abs(uav_y) < 1e5 AND abs(uav_z) < 1e5"
_W, _H, _FX, _FY, _CX, _CY = 480, 270, 240.0, 240.625, 240.0, 135.0

ORACLE = {
    "engine_coordinates": f"WITH {FRAMES} SELECT episode_id, frame_idx, {e('100.0 * uav_x', 1)} AS ex_e1, {e('-100.0 * (-uav_y)', 1)} AS ey_e1, {e('100.0 * (-uav_z)', 1)} AS ez_e1, {e('-degrees(uav_yaw)', 2)} AS yaw_e2 FROM fr WHERE uav_x IS NOT NULL AND uav_y IS NOT NULL AND uav_z IS NOT NULL",
    "box_motion": f"WITH {FRAMES} SELECT episode_id, frame_idx, target_x BETWEEN -200 AND 200 AND target_y BETWEEN -200 AND 200 AS inside, {e(_clamp('target_x', -200.0, 200.0), 3)} AS x_e3, {e(_clamp('target_y', -200.0, 200.0), 3)} AS y_e3, {e(_bounce('target_x', 'vx'), 3)} AS vx_e3, {e(_bounce('target_y', 'vy'), 3)} AS vy_e3 FROM fr WHERE target_x IS NOT NULL AND target_y IS NOT NULL AND vx IS NOT NULL AND vy IS NOT NULL",
    "quaternion_headings": f"WITH {FRAMES}, {EPISODES} SELECT fr.episode_id, frame_idx, {e('sin(uav_yaw)', 4)} AS sin_e4, {e('cos(uav_yaw)', 4)} AS cos_e4 FROM fr JOIN ep USING (episode_id) WHERE uav_yaw IS NOT NULL AND camera_config.pitch_deg IS NOT NULL",
    "occluded_frames": f"WITH {FRAMES}, r AS (SELECT *, {_REASON} AS reason FROM fr) SELECT episode_id, frame_idx, reason, coalesce(NOT line_of_sight_clear, reason = 'los_blocked') AS is_occluded FROM r",
    "action_vector": f"""WITH {FRAMES}, l AS (SELECT *, row_number() OVER w AS n, lag(uav_x) OVER w AS px, lag(uav_y) OVER w AS py, lag(uav_z) OVER w AS pz, lag(uav_yaw) OVER w AS pyaw FROM fr {_OVER})
      SELECT episode_id, frame_idx, {', '.join(f"CASE WHEN n = 1 THEN 0 ELSE {e(f'uav_{c} - p{c}', 3)} END AS d{c}_e3" for c in 'xyz')}, CASE WHEN n = 1 THEN 0 ELSE {e(_wrap('uav_yaw - pyaw'), 3)} END AS turn_e3, {', '.join(f"{e(f'v{c}', 3)} AS v{c}_e3" for c in 'xyz')}, CAST(coalesce(target_visible, false) AS INT) AS visible FROM l""",
    "camera_projection": f"""WITH {FRAMES}, {EPISODES}, c AS (SELECT fr.episode_id, frame_idx, target_x - uav_x AS dx, -(target_y - uav_y) AS dy, -(target_z - uav_z) AS dz, -uav_yaw AS a, -radians(coalesce(camera_config.pitch_deg, 0.0)) AS p FROM fr JOIN ep USING (episode_id)
        WHERE uav_x IS NOT NULL AND uav_y IS NOT NULL AND uav_z IS NOT NULL AND uav_yaw IS NOT NULL AND target_x IS NOT NULL AND target_y IS NOT NULL AND target_z IS NOT NULL),
      r AS (SELECT *, -(sin(a) * dx + cos(a) * dy) AS cx, sin(p) * (cos(a) * dx - sin(a) * dy) - cos(p) * dz AS cy, cos(p) * (cos(a) * dx - sin(a) * dy) + sin(p) * dz AS depth FROM c),
      q AS (SELECT *, CASE WHEN depth > 1e-6 THEN {_FX} * cx / depth + {_CX} ELSE -1.0 END AS u, CASE WHEN depth > 1e-6 THEN {_FY} * cy / depth + {_CY} ELSE -1.0 END AS v FROM r WHERE abs(depth) < 1e6),
      w AS (SELECT *, depth > 1e-6 AND u >= 0 AND u < {_W} AND v >= 0 AND v < {_H} AS valid FROM q)
      SELECT episode_id, frame_idx, {e('depth', 2)} AS depth_e2, valid, CASE WHEN valid THEN {e('u', 1)} END AS u_e1, CASE WHEN valid THEN {e('v', 1)} END AS v_e1, CASE WHEN valid AND abs(dz) > 0.5 THEN true END AS meets_target FROM w""",
    "episode_names": f"WITH {EPISODES} SELECT episode_id, printf('%s_%s_%s_seed%d_%03d', coalesce(scene_id, ''), coalesce(target_behavior_type, ''), coalesce(difficulty_level, ''), random_seed, ((random_seed % 100) + 100) % 100) AS name FROM ep WHERE random_seed IS NOT NULL",
    "fov_centering": f"""WITH {FRAMES}, o AS (SELECT *, atan2(target_y - uav_y, target_x - uav_x) AS b FROM fr WHERE uav_x IS NOT NULL AND uav_y IS NOT NULL AND uav_yaw IS NOT NULL AND target_x IS NOT NULL AND target_y IS NOT NULL), m AS (SELECT *, {_clamp('10.0 * ' + _wrap('b - uav_yaw'), -8.0, 8.0)} AS m FROM o)
      SELECT episode_id, frame_idx, {e('-sin(b) * m', 3)} AS ox_e3, {e('cos(b) * m', 3)} AS oy_e3 FROM m""",
    "frustum_wedges": f"""WITH {FRAMES}, {EPISODES}, c AS (SELECT fr.*, radians(camera_config.hfov_deg) / 2 AS half FROM fr JOIN ep USING (episode_id) WHERE uav_x IS NOT NULL AND uav_y IS NOT NULL AND uav_yaw IS NOT NULL AND camera_config.hfov_deg IS NOT NULL)
      SELECT episode_id, frame_idx, 0 AS corner, {e('uav_x', 2)} AS x_e2, {e('uav_y', 2)} AS y_e2 FROM c UNION ALL SELECT episode_id, frame_idx, 1, {e('uav_x + 30 * cos(uav_yaw - half)', 2)}, {e('uav_y + 30 * sin(uav_yaw - half)', 2)} FROM c
      UNION ALL SELECT episode_id, frame_idx, 2, {e('uav_x + 30 * cos(uav_yaw + half)', 2)}, {e('uav_y + 30 * sin(uav_yaw + half)', 2)} FROM c""",
    "valid_poses": """SELECT record_id, coalesce(isfinite(p.x) AND isfinite(p.y) AND isfinite(p.z) AND isfinite(p.yaw), false) AND NOT coalesce(abs(p.x) < 1e-6 AND abs(p.y) < 1e-6 AND abs(p.z) < 1e-6 AND abs(cos(CASE WHEN isfinite(p.yaw) THEN p.yaw END / 2) - 1) < 1e-6, false) AS valid
      FROM (SELECT record_id, target_pose_world AS p FROM frame_records WHERE target_pose_world IS NOT NULL)""",
    "last_labels": f"WITH {FRAMES}, l AS (SELECT episode_id, frame_idx, nullif(lower(trim(tracker_mode)), '') AS m FROM fr) SELECT episode_id, coalesce(max_by(m, frame_idx) FILTER (m IS NOT NULL), 'vehicle') AS label FROM l GROUP BY 1",
    "first_values": f"WITH {FRAMES} SELECT episode_id, min_by(tracker_mode, frame_idx) FILTER (tracker_mode IS NOT NULL) AS tracker_mode, min_by(target_visible, frame_idx) FILTER (target_visible IS NOT NULL) AS target_visible, {e('min_by(drone_distance_m, frame_idx) FILTER (drone_distance_m IS NOT NULL)', 3)} AS distance_e3 FROM fr GROUP BY 1",
    "stand_in_appearance": _STAND + " SELECT episode_id, appearance FROM ap",
    "tier_fills": _STAND
    + f""", t0 AS (SELECT *, {_TIER} AS tier FROM ap), t1 AS (SELECT *, {_POOL} AS pool FROM t0), t2 AS (SELECT *, unnest(pool) AS t, unnest(range(len(pool))) AS i FROM t1),
      t3 AS (SELECT episode_id, md5(episode_id || '|' || i) AS o, trim(regexp_replace(replace(replace(replace(t, '{{appearance}}', coalesce(appearance, '')), '{{behavior}}', replace(coalesce(target_behavior_type, ''), '_', ' ')), '{{cover}}', '{text.COVER_PHRASE}'), '\\s+', ' ', 'g')) AS text FROM t2),
      t4 AS (SELECT episode_id, text, min(o) AS o FROM t3 GROUP BY 1, 2), t5 AS (SELECT *, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY o) - 1 AS INT) AS place FROM t4)
      SELECT episode_id, place, text FROM t5 WHERE place < 3""",
    "building_names": f"WITH {FRAMES}, f AS (SELECT episode_id, printf('seg/x=%dY=%dZ=%d.PNG', {e('target_x', 0)}, {e('target_y', 0)}, {e('target_z', 0)}) AS file FROM fr WHERE frame_idx = 0 AND abs(target_x) < 1e5 AND abs(target_y) < 1e5 AND abs(target_z) < 1e5) SELECT episode_id, file, "
    + ", ".join(f"CAST(regexp_extract(file, '(?i)X=([^Y]+)Y=([^Z]+)Z=(.+?)\\.png', {i}) AS INT) AS {c}" for i, c in ((1, "x"), (2, "y"), (3, "z")))
    + " FROM f",
    "pose_numbers": f"""WITH {EPISODES}, t AS (SELECT episode_id, list_filter(list_transform(regexp_split_to_array(trim(regexp_replace(uav_initial_pose, '["\\[\\]{{}}:]', ' ', 'g')), '[\\s,]+'), lambda x: TRY_CAST(x AS DOUBLE)), lambda x: x IS NOT NULL) AS n FROM ep WHERE uav_initial_pose IS NOT NULL)
      SELECT episode_id, CAST(len(n) AS INT) AS n, {e('coalesce(list_sum(n), 0)', 2)} AS sum_e2 FROM t""",
    "shuffled_reports": "SELECT batch_id, report_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY md5('7|' || report_id), report_id) AS INT) AS place FROM (SELECT DISTINCT batch_id, report_id FROM demo_reports WHERE batch_id IS NOT NULL AND report_id IS NOT NULL)",
    "first_category": "WITH n AS (SELECT target_name AS name, lower(trim(difficulty)) AS category FROM demo_reports WHERE target_name IS NOT NULL), r AS (SELECT *, CASE category WHEN 'easy' THEN 0 WHEN 'medium' THEN 1 WHEN 'hard' THEN 2 END AS r FROM n) SELECT min_by(category, r) AS category, name FROM r WHERE r IS NOT NULL GROUP BY name",
    "scene_bounds": f"""WITH {FRAMES}, {EPISODES}, p AS (SELECT episode_id, uav_x AS x, uav_y AS y FROM fr UNION ALL SELECT episode_id, target_x, target_y FROM fr)
      SELECT coalesce(scene_id, '?') AS scene, {e('min(x) - 10', 2)} AS x0_e2, {e('max(x) + 10', 2)} AS x1_e2, {e('min(y) - 10', 2)} AS y0_e2, {e('max(y) + 10', 2)} AS y1_e2 FROM p JOIN ep USING (episode_id) WHERE abs(x) < 1e5 AND abs(y) < 1e5 GROUP BY 1""",
    "frustum_fraction": f"WITH {FRAMES} SELECT episode_id, count(*) AS judged, {e('avg(CAST(in_camera_frustum AS INT))')} AS share_e4 FROM fr WHERE in_camera_frustum IS NOT NULL GROUP BY 1",
    "filled_times": f"""WITH {FRAMES}, n AS (SELECT episode_id, frame_idx, timestamp_s, row_number() OVER (PARTITION BY episode_id ORDER BY frame_idx) AS n FROM fr),
      g AS (SELECT episode_id, count(*) AS c, count(timestamp_s) AS known, min(n) FILTER (timestamp_s IS NOT NULL) AS n0, max(n) FILTER (timestamp_s IS NOT NULL) AS n1, min_by(timestamp_s, n) FILTER (timestamp_s IS NOT NULL) AS t0, max_by(timestamp_s, n) FILTER (timestamp_s IS NOT NULL) AS t1 FROM n GROUP BY 1)
      SELECT episode_id, frame_idx, {e('CASE WHEN known < c THEN (n - 1) * CASE WHEN known >= 2 AND t1 > t0 THEN (t1 - t0) / (n1 - n0) ELSE 0.05 END ELSE timestamp_s END', 3)} AS t_e3 FROM n JOIN g USING (episode_id)""",
    "track_headings": _TRACK
    + f""", l AS (SELECT episode_id, frame_idx, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM tk {_OVER}), h AS (SELECT *, CASE WHEN dx IS NOT NULL THEN CASE WHEN dx * dx + dy * dy > 1e-9 THEN atan2(dy, dx) ELSE 0.0 END END AS h FROM l)
      SELECT episode_id, frame_idx, {e('coalesce(h, lag(h) OVER w, 0.0)', 3)} AS heading_e3 FROM h {_OVER}""",
    "track_resample": _TRACK
    + f""", l AS (SELECT episode_id, frame_idx, {_LAG} FROM tk {_OVER}), s0 AS (SELECT *, coalesce(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 0.0) AS way FROM l), s1 AS (SELECT *, sum(way) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS s FROM s0),
      k0 AS (SELECT *, CASE WHEN x0 IS NULL THEN [0] ELSE range(CAST(floor((s - way) / 5) AS BIGINT) + 1, CAST(floor(s / 5) AS BIGINT) + 1) END AS ks FROM s1), k1 AS (SELECT *, unnest(ks) AS k FROM k0),
      k2 AS (SELECT episode_id, k, CASE WHEN way > 0 THEN (k * 5 - (s - way)) / way ELSE 0.0 END AS t, coalesce(x0, x1) AS x0, coalesce(y0, y1) AS y0, x1, y1 FROM k1)
      SELECT episode_id, count(*) AS places, max(k) AS last, {e('avg(x0 + (x1 - x0) * t)', 1)} AS x_e1, {e('avg(y0 + (y1 - y0) * t)', 1)} AS y_e1 FROM k2 GROUP BY 1""",
    "exponential_distance": f"WITH RECURSIVE {FRAMES}, {_smooth('d', 'drone_distance_m', f'1.0 - exp(-greatest(0.0, {_DT} / 0.8))')} SELECT episode_id, frame_idx, {e('x', 3)} AS smoothed_e3 FROM dr",
    "smoothed_pose": f"WITH RECURSIVE {FRAMES}, {', '.join(_smooth(c, f'uav_{c}', f'least(1.0, greatest(0.0, {_DT} / {t}))', _REAL_UAV) for c, t in (('x', 0.45), ('y', 0.45), ('z', 1.1)))} SELECT episode_id, frame_idx, {e('xr.x', 3)} AS x_e3, {e('yr.x', 3)} AS y_e3, {e('zr.x', 3)} AS z_e3 FROM xr JOIN yr USING (episode_id, frame_idx) JOIN zr USING (episode_id, frame_idx)",
    "spaced_track": _TRACK.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY frame_idx) AS n FROM tk), k AS (SELECT episode_id, frame_idx, x, y, n FROM n WHERE n = 1 UNION ALL
      SELECT episode_id, frame_idx, x, y, n FROM (SELECT b.*, row_number() OVER (PARTITION BY b.episode_id ORDER BY b.n) AS r FROM k a JOIN n b ON b.episode_id = a.episode_id AND b.n > a.n AND (b.x - a.x) ** 2 + (b.y - a.y) ** 2 >= 4.0) WHERE r = 1)
      SELECT episode_id, frame_idx FROM k""",
    "old_tracker": f"""WITH {FRAMES}, s AS (SELECT episode_id, frame_idx, timestamp_s AS t, coalesce(target_visible, false) AS seen FROM fr WHERE timestamp_s IS NOT NULL), b AS (SELECT *, CASE WHEN NOT seen AND coalesce(lag(seen) OVER w, true) THEN frame_idx END AS f0 FROM s {_OVER}),
      c AS (SELECT *, max(f0) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS f1 FROM b), l AS (SELECT c.*, c.t - a.t AS lost FROM c LEFT JOIN s a ON a.episode_id = c.episode_id AND a.frame_idx = c.f1)
      SELECT episode_id, frame_idx, CASE WHEN seen OR lost < 0.25 THEN 'track' WHEN lost < 0.6 THEN 'predict' ELSE 'search' END AS mode FROM l""",
    "zipped_tracks": f"""WITH {FRAMES}, u AS (SELECT episode_id, uav_x AS x, uav_y AS y, row_number() OVER w AS n FROM fr WHERE abs(uav_x) < 1e5 AND abs(uav_y) < 1e5 {_OVER}), t AS (SELECT episode_id, target_x AS tx, target_y AS ty, row_number() OVER w AS n FROM fr WHERE abs(target_x) < 1e5 AND abs(target_y) < 1e5 {_OVER})
      SELECT episode_id, n, {e('sqrt((x - tx) ** 2 + (y - ty) ** 2)', 3)} AS gap_e3 FROM u JOIN t USING (episode_id, n)""",
    "car_corners": f"""WITH {FRAMES}, o(corner, a, b, h) AS (VALUES {', '.join(f'({i}, {a}, {b}, {h})' for i, (a, b, h) in enumerate((a * 2.3, b * 1.0, h) for a in (1, -1) for b in (1, -1) for h in (0.0, 1.6)))})
      SELECT episode_id, frame_idx, corner, {e('target_x + a * cos(-target_yaw) - b * sin(-target_yaw)', 2)} AS x_e2, {e('-target_y + a * sin(-target_yaw) + b * cos(-target_yaw)', 2)} AS y_e2, {e('-target_z + h', 2)} AS z_e2 FROM fr, o WHERE abs(target_x) < 1e5 AND abs(target_y) < 1e5 AND target_z IS NOT NULL AND target_yaw IS NOT NULL""",
    "color_boxes": f"""WITH {FRAMES}, p AS (SELECT episode_id AS image, frame_idx, CAST(floor(target_x) AS INT) AS x, CAST(floor(target_y) AS INT) AS y, length(coalesce(tracker_mode, '')) * 20 AS r, length(coalesce(tracker_mode, '')) AS g, CASE WHEN coalesce(target_visible, false) THEN 90 ELSE 0 END AS b FROM fr WHERE abs(target_x) < 1e5 AND abs(target_y) < 1e5),
      s AS (SELECT image, min_by(struct_pack(r := r, g := g, b := b), frame_idx) AS c FROM p GROUP BY 1), q AS (SELECT DISTINCT image, x, y FROM p JOIN s USING (image) WHERE r = c.r AND g = c.g AND b = c.b AND greatest(r, g, b) > 2)
      SELECT image, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS pixels FROM q GROUP BY 1 HAVING count(*) >= 12""",
    "stuck_resets": _TRACK
    + f""", l AS (SELECT episode_id, frame_idx, {_LAG}, row_number() OVER w AS n FROM tk {_OVER}), s AS (SELECT *, coalesce(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) < 0.05, false) AS still FROM l),
      m AS (SELECT *, coalesce(max(CASE WHEN NOT still THEN n END) OVER (PARTITION BY episode_id ORDER BY frame_idx), 0) AS moved FROM s) SELECT episode_id, frame_idx FROM m WHERE still AND (n - moved) % 6 = 0""",
}
