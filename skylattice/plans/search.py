"""Queries that search candidate places, and SQL for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.operators import occupancy as occ
from skylattice.operators import planning, viewpoints
from skylattice.operators.metrics import distinct_episodes, distinct_frames, readable, scaled
from skylattice.plans import space
from skylattice.plans.tracking import EPISODES, FRAMES
from skylattice.session import table


def frame_evaluation(spark, d):
    cam = distinct_episodes(table(spark, d, "episodes")).select("episode_id", F.radians("camera_config.hfov_deg").alias("hfov"))
    f = distinct_frames(table(spark, d, "frame_records")).join(cam, "episode_id")
    return planning.evaluated(f, F.col("hfov")).withColumn("score", scaled(F.col("score"))).withColumnRenamed("score", "score_e4")


def _world(spark, d):
    columns = space._columns(spark, d)
    return space._voxels(spark, d), occ.building_flags(columns, space.GRID), columns


def clear_vantage(spark, d):
    """For the target of every record; a heading that isn't known counts as 0. y points the other way on the map."""
    v, flags, _ = _world(spark, d)
    p = F.col("target_pose_world")
    t = table(spark, d, "frame_records").select(F.col("record_id").alias("target_id"), p["x"].alias("x"), (-p["y"]).alias("y"), (-p["z"]).alias("z"), (-F.coalesce(readable(p["yaw"]), F.lit(0.0))).alias("heading"))
    r = planning.vantage_points(t.where(occ.real(F.col("x"), F.col("y"), F.col("z"))), v, flags, space.GRID)
    return r.select("target_id", "candidate", scaled(F.col("cost"), 2).alias("cost_e2"))


def hide_goal(spark, d):
    """For every record with both poses."""
    v, columns = occ.extents(space.points(spark, d), space.GRID)
    r = space.rays(spark, d).where(occ.real(*[F.col(f"{p}{c}") for p in "ab" for c in "xyz"]))
    cases = r.select(*[F.col(c).alias(n) for c, n in (("ray_id", "case_id"), ("bx", "x"), ("by", "y"), ("bz", "z"), ("ax", "dx"), ("ay", "dy"), ("az", "dz"))])
    return planning.hiding_places(cases, v, columns, columns.where("is_building"), space.GRID)


def start_gates(spark, d):
    columns = space._columns(spark, d)
    starts = space._starts(spark, d)
    road = occ.corridor(occ.free_runs(starts, columns.where("is_building"), 8, 12), 8).where("place = 1")
    g = planning.start_gates(road, starts, columns)
    return g.select("start_id", "reason", scaled(F.col("score"), 2).alias("score_e2"))


def wall_probe(spark, d):
    return planning.wall_probe(space._starts(spark, d), space._columns(spark, d).where("is_building"))


def alley_corridors(spark, d):
    s = space.sites(spark, d)
    a = planning.alley_corridors(occ.site_pairs(s, 10.0, 36.0), s, space._columns(spark, d).where("is_building"), space.GRID)
    return a.select("site_a", "site_b", scaled(F.col("width"), 3).alias("width_e3"), scaled(F.col("score"), 3).alias("score_e3"))


def drone_lift(spark, d):
    p = space.rays(spark, d).select(F.col("ray_id").alias("point_id"), F.col("bx").alias("x"), F.col("by").alias("y"), F.col("bz").alias("z"))
    return planning.lifted(p, space._voxels(spark, d), space.GRID)


def _judged(spark, d):
    v, flags, _ = _world(spark, d)
    return viewpoints.judged(distinct_frames(table(spark, d, "frame_records")), v, flags, space.GRID)


def best_viewpoint(spark, d):
    return viewpoints.best(_judged(spark, d))


def expert_plan(spark, d):
    p = viewpoints.planned(_judged(spark, d))
    return p.groupBy("episode_id", "candidate").agg(F.count(F.lit(1)).alias("frames"))


QUERIES = {q.__name__: q for q in (frame_evaluation, clear_vantage, hide_goal, start_gates, wall_probe, alley_corridors, drone_lift, best_viewpoint, expert_plan)}

e = space.e
_OFF = "coalesce(drone_bearing_to_target_rad, ((atan2(target_y - uav_y, target_x - uav_x) - uav_yaw + pi()) - 2 * pi() * floor((atan2(target_y - uav_y, target_x - uav_x) - uav_yaw + pi()) / (2 * pi())) - pi()))"
_VANTAGE = ", ".join(f"({n}, {f}, {s})" for n, (f, s) in enumerate((f, s) for f in (-16.0, -8.0, 8.0, 16.0) for s in (-18.0, -12.0, -6.0, 0.0, 6.0, 12.0, 18.0)))
_HIT = f"{space._SAMPLES}, vx AS (SELECT DISTINCT ix, iy, iz FROM pt), hit AS (SELECT DISTINCT ray_id FROM sm JOIN vx USING (ix, iy, iz) JOIN fl USING (ix, iy) WHERE blocks)"


_ROAD_HEAD = space.ORACLE["road_score"].rpartition("SELECT start_id, heading, forward")[0]

_SPOTS = ", ".join(f"({i}, {p[0]!r}::DOUBLE, {p[1]!r}::DOUBLE, {p[3]!r}::DOUBLE)" for i, p in enumerate(viewpoints.PLACES[::3].tolist()))
_HEIGHTS = ", ".join(f"({i}, {h!r}::DOUBLE, {viewpoints.EYES[i == 2]!r}::DOUBLE)" for i, h in enumerate(viewpoints.PLACES[:3, 2].tolist()))
_BEST = f"""WITH {space._FLAGS}, {FRAMES}, vx AS (SELECT DISTINCT ix, iy, iz FROM pt), sx AS (SELECT ix, iy, iz FROM vx JOIN fl USING (ix, iy) WHERE blocks), sp(s, dx, dy, r) AS (VALUES {_SPOTS}), hg(h, alt, eye) AS (VALUES {_HEIGHTS}),
f0 AS (SELECT episode_id, frame_idx, target_x AS x, -target_y AS y, greatest(0.5, coalesce(-target_z, 0.5)) AS agl, {space._cell('target_x')} AS cx, {space._cell('(-target_y)')} AS cy FROM fr WHERE abs(target_x) < 1e5 AND abs(target_y) < 1e5),
f1 AS (SELECT episode_id, frame_idx, x, y, greatest(coalesce(ground_z, 0.0) + agl, 0.5) AS z, row_number() OVER (PARTITION BY episode_id ORDER BY frame_idx) AS rn, count(*) OVER (PARTITION BY episode_id) AS n FROM f0 LEFT JOIN co ON co.ix = cx AND co.iy = cy),
f2 AS (SELECT a.episode_id, a.frame_idx, a.x, a.y, b.x AS bx, b.y AS by_, b.z AS bz, k FROM f1 a, (SELECT unnest(range(5)) AS k) JOIN f1 b ON b.episode_id = a.episode_id AND b.rn = least(a.rn + k, a.n)),
r0 AS (SELECT row_number() OVER () AS ray_id, f2.*, s, eye, r, x + dx AS ax, y + dy AS ay, eye AS az FROM f2, sp, (SELECT DISTINCT eye FROM hg)),
r1 AS (SELECT *, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2 + (bz - az) ** 2) AS length, atan2(by_ - ay, bx - ax) - atan2(y - ay, x - ax) AS turn FROM r0),
r2 AS (SELECT *, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) <= 100 AND abs((turn + pi()) - 2 * pi() * floor((turn + pi()) / (2 * pi())) - pi()) <= radians(35.0) AS view FROM r1),
s0 AS (SELECT ray_id, ax, ay, az, bx, by_, bz, greatest(4, CAST(floor(length / 4.0) AS INT)) AS steps FROM r2 WHERE length <= 100 AND length >= 2), s1 AS (SELECT *, unnest(range(1, steps)) AS step FROM s0),
s2 AS (SELECT ray_id, {space._cell('(ax + (bx - ax) * (step / steps))')} AS ix, {space._cell('(ay + (by_ - ay) * (step / steps))')} AS iy, {space._cell('(az + (bz - az) * (step / steps))')} AS iz FROM s1),
ht AS (SELECT DISTINCT ray_id, true AS hit FROM s2 JOIN sx USING (ix, iy, iz)),
vs AS (SELECT episode_id, frame_idx, s, eye, any_value(x) AS x, any_value(y) AS y, any_value(r) AS r, count(*) FILTER (view AND hit IS NULL) AS seen, count(*) FILTER (hit) AS hidden FROM r2 LEFT JOIN ht USING (ray_id) GROUP BY 1, 2, 3, 4),
cd AS (SELECT vs.*, h, alt, s * 3 + h AS n, {space._cell('(x + dx)')} AS cx, {space._cell('(y + dy)')} AS cy, {space._cell('alt')} AS cz FROM vs JOIN hg USING (eye) JOIN sp USING (s)),
cl AS (SELECT cd.*, CASE WHEN vx.ix IS NOT NULL THEN 1.0 WHEN alt < roof_z + 1 THEN 0.7 ELSE 0.0 END AS hit FROM cd LEFT JOIN vx ON vx.ix = cx AND vx.iy = cy AND vx.iz = cz LEFT JOIN co ON co.ix = cx AND co.iy = cy),
sc AS (SELECT episode_id, frame_idx, n, {e('seen / 5.0 - 0.8 * hidden / 5.0 - 0.3 * least(1.0, abs(cl.r - 12.0) / 12.0) - hit', 6)} AS score FROM cl)
SELECT episode_id, frame_idx, n AS candidate, score AS score_e6 FROM sc QUALIFY row_number() OVER (PARTITION BY episode_id, frame_idx ORDER BY score DESC, n) = 1"""

ORACLE = {
    "best_viewpoint": _BEST,
    "frame_evaluation": f"""WITH {FRAMES}, {EPISODES}, c AS (SELECT fr.*, radians(camera_config.hfov_deg) AS hfov, {_OFF} AS off FROM fr JOIN ep USING (episode_id)),
      g AS (SELECT *, abs(off) <= hfov / 2 AND sqrt((target_x - uav_x) ** 2 + (target_y - uav_y) ** 2) <= 100 AS geo FROM c), v AS (SELECT *, coalesce(in_camera_frustum, geo) AS fru FROM g),
      w AS (SELECT *, coalesce(target_visible, fru AND coalesce(line_of_sight_clear, true)) AS vis FROM v)
      SELECT episode_id, frame_idx, vis AS visible, fru AS in_frustum, line_of_sight_clear AS los_clear, concat_ws('+', CASE WHEN target_visible IS NOT NULL THEN 'recorded' ELSE 'derived' END, CASE WHEN in_camera_frustum IS NULL AND geo IS NOT NULL THEN 'geometry' END, CASE WHEN line_of_sight_clear IS NOT NULL THEN 'los' END) AS source,
      {e('CASE WHEN NOT vis THEN 0.0 WHEN vis IS NULL OR off IS NULL THEN 1.0 ELSE 0.1 + 0.9 * greatest(0.0, 1.0 - abs(off) / (hfov / 2)) END')} AS score_e4 FROM w""",
    "clear_vantage": f"""WITH {space._FLAGS}, o(n, f, s) AS (VALUES {_VANTAGE}),
      tg AS (SELECT record_id AS target_id, target_pose_world.x AS x, -target_pose_world.y AS y, -target_pose_world.z AS z, CASE WHEN isfinite(target_pose_world.yaw) THEN -target_pose_world.yaw ELSE -0.0 END AS hd FROM frame_records),
      ry AS (SELECT target_id * 28 + n AS ray_id, target_id, n, f, s, x + cos(hd) * f - sin(hd) * s AS ax, y + sin(hd) * f + cos(hd) * s AS ay, z + 12.0 AS az, x AS bx, y AS by_, z AS bz, true AS near FROM tg, o WHERE {space._real('x', 'y', 'z')}), {_HIT}
      SELECT target_id, n AS candidate, {e('abs(f) + 0.6 * abs(s)', 2)} AS cost_e2 FROM ry WHERE ray_id NOT IN (SELECT ray_id FROM hit) QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY abs(f) + 0.6 * abs(s), n) = 1""",
    "start_gates": _ROAD_HEAD
    + f"""SELECT s.start_id, CASE WHEN coalesce(is_building, false) THEN 'not_drivable' WHEN width < 3 THEN 'too_narrow' WHEN forward < 4 THEN 'short_forward' WHEN coalesce(slope, 0) > 1.5 THEN 'steep_ground' ELSE 'ok' END AS reason,
      CASE WHEN NOT coalesce(is_building, false) AND width >= 3 AND forward >= 4 AND coalesce(slope, 0) <= 1.5 THEN {e('score - 3 * coalesce(slope, 0)', 2)} END AS score_e2
      FROM sc s LEFT JOIN co USING (ix, iy) JOIN (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY start_id ORDER BY score DESC, heading) = 1) USING (start_id)
      LEFT JOIN (SELECT start_id, max(c.ground_z) - min(c.ground_z) AS slope FROM sc JOIN co c ON c.ix BETWEEN sc.ix - 1 AND sc.ix + 1 AND c.iy BETWEEN sc.iy - 1 AND sc.iy + 1 WHERE c.ground_z IS NOT NULL GROUP BY 1) USING (start_id)""",
    "wall_probe": space._FREE + " SELECT start_id, CAST(sum(CASE WHEN free < 2 THEN 1 << heading ELSE 0 END) AS INT) AS walls, bool_or(free < 2) AS adjacent FROM fr GROUP BY 1",
    "alley_corridors": f"""WITH {space._BLD}, {space._SITES}, p AS (SELECT a.site_id AS site_a, b.site_id AS site_b, (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 AS my, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS gap FROM st a JOIN st b ON a.site_id < b.site_id)
      SELECT site_a, site_b, {e('gap', 3)} AS width_e3, {e('4.0 * greatest(0.0, 36.0 - gap)', 3)} AS score_e3 FROM p WHERE gap BETWEEN 10 AND 36 AND NOT EXISTS (SELECT 1 FROM bl WHERE bl.ix = {space._cell('mx')} AND bl.iy = {space._cell('my')})""",
    "drone_lift": f"""WITH {space._POINTS}, {space._RAYS}, vx AS (SELECT DISTINCT ix, iy, iz FROM pt), l(k, n) AS (VALUES (0, 0), (1, 1), (2, 2), (3, 3), (4, 5)), o(i, j) AS (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)),
      t AS (SELECT DISTINCT ray_id, k FROM ry, l, o JOIN vx ON vx.ix = {space._cell('bx')} + i AND vx.iy = {space._cell('by_')} + j AND vx.iz = {space._cell('bz')} + n),
      f AS (SELECT ray_id, min(k) AS k FROM (SELECT ray_id, k FROM ry, l WHERE {space._cell('bx')} IS NOT NULL AND {space._cell('by_')} IS NOT NULL AND {space._cell('bz')} IS NOT NULL EXCEPT SELECT ray_id, k FROM t) GROUP BY 1)
      SELECT ray_id AS point_id, n AS lift FROM ry LEFT JOIN f USING (ray_id) LEFT JOIN l USING (k)""",
}
