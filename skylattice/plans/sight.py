"""Queries over lines of sight, hiding, gates and height fields, and SQL for them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skylattice.operators import occupancy as occ
from skylattice.operators import sight
from skylattice.operators.metrics import readable, scaled
from skylattice.operators.sequence import annotate
from skylattice.plans import space
from skylattice.plans.space import GRID, RANGE, e
from skylattice.session import table


def _world(spark, d):
    columns = space._columns(spark, d)
    return space._voxels(spark, d), occ.building_flags(columns, GRID), columns


def raised_los(spark, d):
    v, flags, columns = _world(spark, d)
    return sight.sight(space.rays(spark, d), v, flags, columns, GRID, reach=RANGE).select("ray_id", "blocked")


def occluder_between(spark, d):
    v, flags, columns = _world(spark, d)
    return sight.between(sight.sight(space.rays(spark, d), v, flags, columns, GRID, largest=True, reach=RANGE))


def _buildings(spark, d):
    """Where episodes begin stand buildings of 8 to 24 metres."""
    return space.sites(spark, d).select(F.col("site_id").alias("building_id"), "x", "y", (8.0 + F.pmod("site_id", F.lit(17))).alias("height"))


def annotated_los(spark, d):
    return sight.annotated_sight(space.rays(spark, d), _buildings(spark, d), reach=RANGE)


def hidden_from_all(spark, d):
    """Every record with both poses: hidden from its drone and from a nominal chaser."""
    v, flags, columns = _world(spark, d)
    u, t = F.col("drone_pose_world"), F.col("target_pose_world")
    place = lambda p: (p["x"], -p["y"], -p["z"], -readable(p["yaw"]))
    f = table(spark, d, "frame_records").where(occ.real(*[p[c] for p in (u, t) for c in "xyz"]))
    tx, ty, tz, heading = place(t)
    ux, uy, uz, yaw = place(u)
    cx, cy, cz = sight.chase_pose(tx, ty, tz, F.coalesce(heading, F.lit(0.0)))
    named = lambda n, x, y, z, a: F.struct(F.lit(n).alias("drone_no"), x.alias("x"), y.alias("y"), z.alias("z"), a.alias("yaw"))
    drones = f.select(F.col("record_id").alias("case_id"), F.explode(F.array(named(0, ux, uy, uz, yaw), named(1, cx, cy, cz, F.atan2(ty - cy, tx - cx)))).alias("p")).select("case_id", "p.*")
    cases = f.select(F.col("record_id").alias("case_id"), tx.alias("x"), ty.alias("y"), tz.alias("z"))
    return sight.hidden_from_all(cases, drones, v, flags, columns, GRID, reach=RANGE)


def _points(spark, d):
    r = space.rays(spark, d)
    return r.select(F.col("ray_id").alias("point_id"), F.col("bx").alias("x"), F.col("by").alias("y"))


def sideways_room(spark, d):
    r = sight.sideways_room(_points(spark, d), space._columns(spark, d).where("is_building"), GRID)
    return r.select("point_id", scaled(F.col("room"), 1).alias("room_e1"), scaled(F.col("bonus"), 1).alias("bonus_e1"))


def edge_penalty(spark, d):
    return sight.edge_penalty(_points(spark, d), space._columns(spark, d).where("is_building"), GRID)


def _first_records(spark, d):
    """One record of each frame, the smallest, with readable drone and target places on the map."""
    f = table(spark, d, "frame_records").where("episode_id is not null and frame_idx is not null")
    near = lambda c: F.when(F.abs(c) < occ.REAL, c)
    one = f.groupBy("episode_id", "frame_idx").agg(F.min(F.struct("record_id", F.col("drone_pose_world").alias("u"), F.col("target_pose_world").alias("t"))).alias("r"))
    return one.select("episode_id", "frame_idx", "r.record_id", *[near(s * F.col(f"r.{p}.{c}")).alias(f"{p}{c}") for p in "ut" for c, s in (("x", 1), ("y", -1), ("z", -1))])


def lateral_penalty(spark, d):
    """The way from each target place to the next."""
    f = _first_records(spark, d).where("tx is not null and ty is not null")
    f = annotate(f.select("episode_id", "frame_idx", "record_id", "tx", "ty"), "episode_id", "frame_idx", lead={"n": F.struct("tx", "ty")}).where("n is not null")
    s = f.select(F.col("record_id").alias("segment_id"), F.col("tx").alias("ax"), F.col("ty").alias("ay"), F.col("n.tx").alias("bx"), F.col("n.ty").alias("by"))
    return sight.lateral_penalty(s, space._columns(spark, d).where("is_building"), GRID)


def route_occlusion(spark, d):
    """Of each episode's last third of target places, seen from where the drone began: the shares hidden by anything and
    by large buildings, and the mean room beside them."""
    v, flags, columns = _world(spark, d)
    f = _first_records(spark, d)
    first = f.where("ux is not null and uy is not null and uz is not null").groupBy("episode_id").agg(F.min_by(F.struct("ux", "uy", "uz"), "frame_idx").alias("u"))
    f = annotate(f.where("tx is not null and ty is not null and tz is not null").select("episode_id", "frame_idx", "record_id", "tx", "ty", "tz"), "episode_id", "frame_idx", running={"n": F.lit(1)})
    size = f.groupBy("episode_id").agg(F.count(F.lit(1)).alias("size")).where("size >= 3")
    leg = f.join(size, "episode_id").where(F.col("n") - 1 >= F.greatest(F.lit(1), F.floor(0.68 * (F.col("size") - 1)))).join(first, "episode_id")
    rays = leg.select(F.col("record_id").alias("ray_id"), F.col("u.ux").alias("ax"), F.col("u.uy").alias("ay"), F.col("u.uz").alias("az"), F.col("tx").alias("bx"), F.col("ty").alias("by"), F.col("tz").alias("bz"))
    any_ = sight.sight(rays, v, flags, columns, GRID, reach=RANGE).select("ray_id", F.col("blocked").alias("hidden"))
    large = sight.sight(rays, v, flags, columns, GRID, largest=True, reach=RANGE).select("ray_id", F.col("blocked").alias("walled"))
    room = sight.sideways_room(rays.select(F.col("ray_id").alias("point_id"), F.col("bx").alias("x"), F.col("by").alias("y")), columns.where("is_building"), GRID).select(F.col("point_id").alias("ray_id"), F.least(F.lit(12.0), F.col("room")).alias("room"))
    joined = leg.select("episode_id", F.col("record_id").alias("ray_id")).join(any_, "ray_id").join(large, "ray_id").join(room, "ray_id")
    share = lambda c: scaled(F.avg(F.col(c).cast("double"))).alias(f"{c}_e4")
    return joined.groupBy("episode_id").agg(F.count(F.lit(1)).alias("places"), share("hidden"), share("walled"), scaled(F.avg("room"), 3).alias("room_e3"))


def _corridors(spark, d):
    free = occ.free_runs(space._starts(spark, d), space._columns(spark, d).where("is_building"), 8, 12)
    return occ.corridor(free, 8)


def anchor_heading(spark, d):
    hints = space.sites(spark, d).select(F.col("site_id").alias("start_id"), (F.pmod("site_id", F.lit(628)) / 100).alias("hint"))
    a = sight.anchor_heading(_corridors(spark, d), hints)
    return a.select("start_id", "heading", scaled(F.col("score"), 3).alias("score_e3"))


def _init(spark, d, relaxed):
    t = F.col("target_pose_world")
    anchors = table(spark, d, "frame_records").select(F.col("record_id").alias("site_id"), t["x"].alias("anchor_x"), (-t["y"]).alias("anchor_y"))
    starts = space.sites(spark, d).join(anchors, "site_id").withColumnRenamed("site_id", "start_id")
    gates = sight.init_gates(starts, _corridors(spark, d).where("place = 1"), space._columns(spark, d), GRID, shift=40.0, relaxed=relaxed)
    return gates.select("start_id", "reason", scaled(F.col("score"), 2).alias("score_e2"))


def init_gates(spark, d):
    return _init(spark, d, False)


def init_gates_relaxed(spark, d):
    return _init(spark, d, True)


def _anchors(spark, d):
    return space.sites(spark, d).withColumnRenamed("site_id", "anchor_id")


def road_seeds(spark, d):
    r = sight.road_seeds(_anchors(spark, d), occ.extents(space.points(spark, d), GRID)[1].where("is_building"), GRID)
    return r.select("anchor_id", "n", "heading", scaled(F.col("score"), 2).alias("score_e2"))


def spiral_starts(spark, d):
    columns = occ.extents(space.points(spark, d), GRID)[1]
    r = sight.spiral_starts(_anchors(spark, d), columns.where("is_building"), columns, GRID)
    return r.select("anchor_id", "n", scaled(F.col("score"), 2).alias("score_e2"))


def street_headings(spark, d):
    free = occ.free_runs(space._starts(spark, d), space._columns(spark, d).where("is_building"), 8, 12)
    hints = space.sites(spark, d).select(F.col("site_id").alias("start_id"), F.pmod("site_id", F.lit(8)).alias("hint"))
    h = sight.street_headings(free, hints, GRID.voxel)
    return h.select("start_id", "heading", scaled(F.col("ahead"), 1).alias("ahead_e1"))


def street_risk(spark, d):
    r = sight.street_risk(space._columns(spark, d).where("is_building"), GRID)
    return r.select("ix", "iy", *[scaled(F.col(c)).alias(f"{c}_e4") for c in ("edge", "alley", "crossing", "risk")])


def ground_field(spark, d):
    g = sight.ground_field(space.points(spark, d), GRID.voxel)
    return g.select("ix", "iy", "points", scaled(F.col("floor"), 3).alias("floor_e3"), scaled(F.col("roof"), 3).alias("roof_e3"), scaled(F.col("open")).alias("open_e4"), "is_road")


def surface_lookup(spark, d):
    s = sight.surface_at(_points(spark, d), sight.ground_field(space.points(spark, d), GRID.voxel), GRID.voxel)
    return s.select("point_id", scaled(F.col("ground"), 2).alias("ground_e2"), scaled(F.col("roof"), 3).alias("roof_e3"))


def car_anchor(spark, d):
    """The base height of the nearest anchor within five metres of each target, null without one."""
    s = space.sites(spark, d)
    near = occ.nearest(_points(spark, d), s, 5.0).join(s.select("site_id", F.pmod("site_id", F.lit(7)).alias("base")), "site_id")
    return _points(spark, d).select("point_id").join(near.select("point_id", "base"), "point_id", "left")


QUERIES = {
    q.__name__: q
    for q in (raised_los, occluder_between, annotated_los, hidden_from_all, sideways_room, edge_penalty, lateral_penalty, route_occlusion, anchor_heading, init_gates, init_gates_relaxed, road_seeds, spiral_starts, street_headings, street_risk, ground_field, surface_lookup, car_anchor)
}

# SQL ----------------------------------------------------------------------------------------------------------------

_NEAR = "coalesce((ax - bx) ** 2 + (ay - by_) ** 2 + (az - bz) ** 2 <= 10000, false) AS near"


def _raised(source: str, agl: str = "1.0", keep: str = "ray_id", near: str = _NEAR) -> str:
    """ry: the rays of `source` with raised ends."""
    return f"""rg AS (SELECT *, {space._cell('bx')} AS tx_, {space._cell('by_')} AS ty_ FROM {source}),
ry AS (SELECT *, {near} FROM (SELECT {keep}, ax, ay, CASE WHEN az IS NOT NULL THEN greatest(az, 12.0) END AS az, bx, by_, greatest(coalesce(ground_z, 0.0) + {agl}, 0.5) AS bz FROM rg LEFT JOIN co ON co.ix = tx_ AND co.iy = ty_))"""


def _hits(which: str, name: str = "hit") -> str:
    return f"{name} AS (SELECT ray_id, min(t) AS t FROM sm JOIN vx USING (ix, iy, iz) JOIN fl USING (ix, iy) WHERE {which} AND length >= 2 GROUP BY 1)"


_R0 = space._RAYS.replace("ry AS", "r0 AS")
_VX = "vx AS (SELECT DISTINCT ix, iy, iz FROM pt)"
_SIGHT = f"WITH {space._FLAGS}, {_R0}, {_raised('r0')}, {space._SAMPLES}, {_VX}"
_FIRST = f"""fo AS (SELECT episode_id, frame_idx, min(struct_pack(record_id := record_id, u := drone_pose_world, t := target_pose_world)) AS r FROM frame_records WHERE episode_id IS NOT NULL AND frame_idx IS NOT NULL GROUP BY 1, 2),
fi AS (SELECT episode_id, frame_idx, r.record_id AS record_id, {', '.join(f"CASE WHEN isfinite({s}r.{p}.{c}) AND abs(r.{p}.{c}) < 1e5 THEN {s}r.{p}.{c} END AS {p}{c}" for p in 'ut' for c, s in (('x', ''), ('y', '-'), ('z', '-')))} FROM fo)"""
_TURN = f"abs(((x + pi()) - 2 * pi() * floor((x + pi()) / (2 * pi())) - pi()))"
_ROAD_HEAD = space.ORACLE["road_score"].rpartition("SELECT start_id, heading, forward")[0]
_BEST = "xb AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY start_id ORDER BY score DESC, heading) = 1)"


def _gates_sql(relaxed: bool) -> str:
    head = _ROAD_HEAD.rstrip() + f""", {_BEST}, an AS (SELECT site_id AS start_id, st.x AS sx, st.y AS sy, target_pose_world.x AS tx, -target_pose_world.y AS ty FROM st JOIN frame_records ON record_id = site_id),
      gr AS (SELECT start_id, max(g) - min(g) AS slope FROM (SELECT sc.start_id, coalesce(co.ground_z, 0.0) AS g FROM sc, (SELECT unnest(range(-1, 2)) AS i), (SELECT unnest(range(-1, 2)) AS j) LEFT JOIN co ON co.ix = sc.ix + i AND co.iy = sc.iy + j) GROUP BY 1),
      ga AS (SELECT sc.start_id, sc.ix, coalesce(is_building, false) AS wall, 4.0 * width AS w, 4.0 * forward AS f, 4.0 * (forward + back) AS o, least(4.0 * forward, 12.0) AS dr, coalesce(slope, 0) AS slope, coalesce(roof_z - coalesce(ground_z, 0.0), 0.0) AS cl, score, sqrt((sx - tx) ** 2 + (sy - ty) ** 2) AS moved
        FROM sc LEFT JOIN co USING (ix, iy) LEFT JOIN xb USING (start_id) LEFT JOIN gr USING (start_id) LEFT JOIN an USING (start_id)),"""
    if relaxed:
        return head + f"""go AS (SELECT *, CASE WHEN ix IS NULL THEN 'nan_pose' WHEN wall THEN 'not_drivable' WHEN w < 6 THEN 'too_narrow' WHEN o < 24 THEN 'closed_island' WHEN dr < 6 THEN 'not_drivable_forward' WHEN cl > 0.5 AND cl < 3 THEN 'on_rail_or_curb' WHEN score < 14 THEN 'low_road_score' ELSE 'road_seed_ok' END AS reason FROM ga)
      SELECT start_id, reason, CASE WHEN reason = 'road_seed_ok' THEN {e('score', 2)} END AS score_e2 FROM go"""
    return head + f"""go AS (SELECT *, CASE WHEN ix IS NULL THEN 'nan_pose' WHEN moved > 40 THEN 'shift_too_far' WHEN wall THEN 'not_drivable' WHEN w < 10 THEN 'too_narrow' WHEN f < 18 THEN 'short_forward' WHEN o < 30 THEN 'closed_island' WHEN dr < 8 THEN 'not_drivable_forward' WHEN slope > 1.2 THEN 'steep_ground' WHEN cl > 0.5 AND cl < 5.5 THEN 'on_rail_or_curb' ELSE 'ok' END AS reason FROM ga)
      SELECT start_id, reason, CASE WHEN reason = 'ok' THEN {e('score + 0.4 * w + 0.15 * least(f, 60.0) + 0.05 * dr - 3.0 * slope - 0.04 * greatest(0.0, coalesce(moved, 0.0) - 80.0)', 2)} END AS score_e2 FROM go"""


def _spread(sql: str, places: list[tuple[int, float, float]]) -> str:
    """SQL over sites, asked of the places around each site instead: site_id is 1000 times the site's plus the number."""
    values = ", ".join(f"({n}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for n, x, y in places)
    return sql.replace(space._SITES, space._SITES.replace("st AS (", "s9 AS (") + f", st AS (SELECT s9.site_id * 1000 + n AS site_id, s9.x + dx AS x, s9.y + dy AS y FROM s9, (VALUES {values}) AS o9(n, dx, dy))")


_SEEDS = _spread(_ROAD_HEAD.rstrip(), sight.rings(180.0, 12.0, 12)) + f""", {_BEST}, q AS (SELECT start_id // 1000 AS anchor_id, CAST(start_id % 1000 AS INT) AS n, heading, round(score - 0.03 * sqrt((st.x - s9.x) ** 2 + (st.y - s9.y) ** 2), 6) AS s
  FROM xb JOIN st ON st.site_id = start_id JOIN s9 ON s9.site_id = start_id // 1000 JOIN sc USING (start_id) ANTI JOIN bl ON bl.ix = sc.ix AND bl.iy = sc.iy)
SELECT anchor_id, n, heading, {e('s', 2)} AS score_e2 FROM q QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, n, heading) = 1"""
_SPIRAL = _spread(_gates_sql(False).replace("JOIN frame_records ON record_id = site_id", "JOIN frame_records ON record_id = site_id // 1000").replace("WHEN moved > 40 THEN 'shift_too_far' ", "").replace("SELECT site_id AS start_id, st.x AS sx, st.y AS sy, target_pose_world.x AS tx, -target_pose_world.y AS ty FROM st JOIN frame_records ON record_id = site_id // 1000", "SELECT st.site_id AS start_id, st.x AS sx, st.y AS sy, s9.x AS tx, s9.y AS ty FROM st JOIN s9 ON s9.site_id = st.site_id // 1000"), sight.rings(32.0, 4.0, 8))
_SPIRAL = f"WITH al AS ({_SPIRAL}), fg AS (SELECT start_id // 1000 AS anchor_id, min(struct_pack(n := CAST(start_id % 1000 AS INT), s := score_e2)) AS f FROM al WHERE reason = 'ok' GROUP BY 1), {space._SITES} SELECT site_id AS anchor_id, coalesce(f.n, 0) AS n, f.s AS score_e2 FROM st LEFT JOIN fg ON anchor_id = site_id"

_FIELD = f"""g0 AS (SELECT ix, iy, CAST(floor(z * 1000 + 0.5) AS BIGINT) AS mm FROM pt WHERE {space._real('x', 'y', 'z')}),
g1 AS (SELECT ix, iy, count(*) AS total, quantile_cont(mm, 0.01) AS p01, quantile_cont(mm, 0.99) AS p99, quantile_cont(mm, 0.5) AS med, min(mm) AS lo, max(mm) AS hi FROM g0 GROUP BY 1, 2 HAVING count(*) >= 4),
g2 AS (SELECT *, greatest(4, CAST(floor((p99 - p01) / 1000) AS INT)) AS bins FROM g1),
g3 AS (SELECT ix, iy, least(bins - 1, CAST(floor((mm - lo) * bins / CASE WHEN hi > lo THEN hi - lo END) AS INT)) AS bin, count(*) AS m FROM g0 JOIN g2 USING (ix, iy) GROUP BY 1, 2, 3),
g4 AS (SELECT ix, iy, min(bin) AS edge FROM (SELECT *, max(m) OVER (PARTITION BY ix, iy) AS peak FROM g3) WHERE m >= 0.2 * peak GROUP BY 1, 2),
g5 AS (SELECT ix, iy, total, hi / 1000 AS roof, CASE WHEN p99 - p01 < 1 THEN med ELSE lo + (hi - lo) * edge / bins END AS floor_mm FROM g2 JOIN g4 USING (ix, iy)),
gf AS (SELECT ix, iy, any_value(total) AS points, any_value(floor_mm) / 1000 AS floor, any_value(roof) AS roof, count(*) FILTER (mm <= floor_mm + 1000) / any_value(total) AS open FROM g0 JOIN g5 USING (ix, iy) GROUP BY 1, 2)"""

ORACLE = {
    "raised_los": _SIGHT + f", {_hits('blocks')} SELECT ray_id, CASE WHEN near THEN t IS NOT NULL END AS blocked FROM ry LEFT JOIN hit USING (ray_id)",
    "occluder_between": _SIGHT + f", {_hits('is_large')} SELECT ray_id, CASE WHEN near THEN coalesce(t BETWEEN 0.08 AND 0.92 AND (1 - t) * sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) <= 12, false) END AS between FROM ry LEFT JOIN hit USING (ray_id)",
    "annotated_los": f"""WITH {_R0}, {space._SITES}, bd AS (SELECT site_id, x AS px, y AS py, 8.0 + ((site_id % 17) + 17) % 17 AS height FROM st),
      ry AS (SELECT *, {_NEAR} FROM (SELECT ray_id, ax, ay, CASE WHEN az IS NOT NULL THEN greatest(az, 12.0) END AS az, bx, by_, greatest(bz, 1.0) AS bz FROM r0)), rl AS (SELECT *, sqrt((ax - bx) ** 2 + (ay - by_) ** 2 + (az - bz) ** 2) AS length FROM ry WHERE near),
      ru AS (SELECT *, greatest(6, TRY_CAST(floor(length / 1.5) AS INT)) AS steps FROM rl WHERE length >= 0.5), rv AS (SELECT *, unnest(range(1, steps)) AS step FROM ru),
      rw AS (SELECT ray_id, ax + (bx - ax) * (step / steps) AS x, ay + (by_ - ay) * (step / steps) AS y, az + (bz - az) * (step / steps) AS z FROM rv),
      hit AS (SELECT DISTINCT ray_id, true AS h FROM rw JOIN bd ON px BETWEEN x - 10 AND x + 10 AND py BETWEEN y - 10 AND y + 10 WHERE z >= 0.5 AND z <= greatest(8.0, height) AND sqrt((x - px) ** 2 + (y - py) ** 2) <= 10),
      bs AS (SELECT DISTINCT ray_id, true AS b FROM r0 JOIN bd ON px BETWEEN bx - 24 AND bx + 24 AND py BETWEEN by_ - 24 AND by_ + 24 WHERE sqrt((bx - px) ** 2 + (by_ - py) ** 2) <= 24)
      SELECT ray_id, CASE WHEN near THEN coalesce(h, false) END AS blocked, CASE WHEN near THEN coalesce(h, false) END AND coalesce(b, false) AS between FROM ry LEFT JOIN hit USING (ray_id) LEFT JOIN bs USING (ray_id)""",
    "hidden_from_all": f"""WITH {space._FLAGS}, f0 AS (SELECT record_id, drone_pose_world AS u, target_pose_world AS t FROM frame_records), f1 AS (SELECT record_id, u.x AS ux, -u.y AS uy, -u.z AS uz, CASE WHEN isfinite(u.yaw) THEN -u.yaw END AS uyaw, t.x AS tx, -t.y AS ty, -t.z AS tz, CASE WHEN isfinite(t.yaw) THEN -t.yaw ELSE 0.0 END AS th FROM f0 WHERE {space._real('u.x', 'u.y', 'u.z', 't.x', 't.y', 't.z')}),
      dr AS (SELECT record_id AS case_id, 0 AS k, ux AS ax, uy AS ay, uz AS az, uyaw AS yaw, tx AS bx, ty AS by_, tz AS bz FROM f1 UNION ALL SELECT record_id, 1, tx - 12 * cos(th), ty - 12 * sin(th), tz + 12, atan2(ty - (ty - 12 * sin(th)), tx - (tx - 12 * cos(th))), tx, ty, tz FROM f1),
      dv AS (SELECT *, case_id * 2 + k AS ray_id, atan2(by_ - ay, bx - ax) - yaw AS x, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS far FROM dr), dw AS (SELECT *, coalesce(far <= 100 AND {_TURN} <= radians(50), false) AS seen FROM dv), ds AS (SELECT * FROM dw WHERE seen),
      {_raised('ds', 'greatest(0.5, bz)', 'ray_id, case_id', 'true AS near')}, {space._SAMPLES}, {_VX}, {_hits('blocks')}, bh AS (SELECT case_id, count(*) AS b FROM ds JOIN hit USING (ray_id) GROUP BY 1)
      SELECT case_id, count(*) FILTER (NOT seen) + coalesce(any_value(b), 0) AS hidden, count(*) AS drones FROM dw LEFT JOIN bh USING (case_id) GROUP BY 1""",
    "sideways_room": f"""WITH {space._BLD}, {space._RAYS}, o(s, k) AS (SELECT s, k FROM (VALUES (-1), (1)) AS a(s), (SELECT unnest(range(1, 9)) AS k)), w AS (SELECT ray_id, s, min(k) AS k FROM ry, o JOIN bl ON bl.ix = {space._cell('(bx + s * k * 2.0)')} AND bl.iy = {space._cell('by_')} GROUP BY 1, 2),
      l AS (SELECT ray_id, sum(9 - k) AS lost FROM w GROUP BY 1), r AS (SELECT ray_id AS point_id, (16 - coalesce(lost, 0)) * 2.0 AS room FROM ry LEFT JOIN l USING (ray_id)) SELECT point_id, {e('room', 1)} AS room_e1, {e('1.5 * greatest(0.0, 12.0 - room)', 1)} AS bonus_e1 FROM r""",
    "edge_penalty": f"""WITH {space._BLD}, {space._RAYS}, o(dx, dy) AS (VALUES (1.0, 0.0), (-1.0, 0.0), (0.0, 1.0), (0.0, -1.0)), h AS (SELECT ray_id, count(*) AS n FROM ry, o JOIN bl ON bl.ix = {space._cell('(bx + dx)')} AND bl.iy = {space._cell('(by_ + dy)')} GROUP BY 1)
      SELECT ray_id AS point_id, coalesce(n, 0) AS penalty FROM ry LEFT JOIN h USING (ray_id)""",
    "lateral_penalty": f"""WITH {space._BLD}, {_FIRST}, s0 AS (SELECT record_id AS segment_id, tx AS ax, ty AS ay, lead(tx) OVER w AS bx, lead(ty) OVER w AS by_, lead(record_id) OVER w AS nx FROM fi WHERE tx IS NOT NULL AND ty IS NOT NULL WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx)),
      s1 AS (SELECT *, sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) AS far FROM s0 WHERE nx IS NOT NULL), s2 AS (SELECT *, greatest(2, CAST(ceil(far) AS INT)) AS n FROM s1 WHERE far >= 1e-6 AND far <= 100), s3 AS (SELECT *, unnest(range(1, n + 1)) AS i FROM s2),
      s4 AS (SELECT segment_id, ax + (bx - ax) * (i / n) - (by_ - ay) / far * h AS x, ay + (by_ - ay) * (i / n) + (bx - ax) / far * h AS y FROM s3, (VALUES (0.9), (-0.9)) AS hh(h)), s5 AS (SELECT segment_id, count(*) AS c FROM s4 JOIN bl ON bl.ix = {space._cell('x')} AND bl.iy = {space._cell('y')} GROUP BY 1)
      SELECT segment_id, CASE WHEN far <= 100 THEN coalesce(c, 0) END AS penalty FROM s1 LEFT JOIN s5 USING (segment_id)""",
    "route_occlusion": f"""WITH {space._FLAGS}, {_FIRST}, u0 AS (SELECT episode_id, min_by(struct_pack(x := ux, y := uy, z := uz), frame_idx) AS u FROM fi WHERE ux IS NOT NULL AND uy IS NOT NULL AND uz IS NOT NULL GROUP BY 1),
      n0 AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY frame_idx) AS n, count(*) OVER (PARTITION BY episode_id) AS size FROM fi WHERE tx IS NOT NULL AND ty IS NOT NULL AND tz IS NOT NULL),
      lg AS (SELECT episode_id, record_id AS ray_id, u.x AS ax, u.y AS ay, u.z AS az, tx AS bx, ty AS by_, tz AS bz FROM n0 JOIN u0 USING (episode_id) WHERE size >= 3 AND n - 1 >= greatest(1, floor(0.68 * (size - 1)))),
      {_raised('lg', keep='ray_id, episode_id')}, {space._SAMPLES}, {_VX}, {_hits('blocks')}, {_hits('is_large', 'hl')},
      o(s, k) AS (SELECT s, k FROM (VALUES (-1), (1)) AS a(s), (SELECT unnest(range(1, 9)) AS k)), w AS (SELECT ray_id, s, min(k) AS k FROM ry, o JOIN bl ON bl.ix = {space._cell('(bx + s * k * 2.0)')} AND bl.iy = {space._cell('by_')} GROUP BY 1, 2), l AS (SELECT ray_id, sum(9 - k) AS lost FROM w GROUP BY 1),
      z AS (SELECT episode_id, CASE WHEN near THEN CAST(hit.t IS NOT NULL AS INT) END AS h, CASE WHEN near THEN CAST(hl.t IS NOT NULL AS INT) END AS g, least(12.0, (16 - coalesce(lost, 0)) * 2.0) AS room FROM ry LEFT JOIN hit USING (ray_id) LEFT JOIN hl USING (ray_id) LEFT JOIN l USING (ray_id))
      SELECT episode_id, count(*) AS places, {e('avg(h)')} AS hidden_e4, {e('avg(g)')} AS walled_e4, {e('avg(room)', 3)} AS room_e3 FROM z GROUP BY 1""",
    "anchor_heading": _ROAD_HEAD.rstrip() + f""", h AS (SELECT start_id, heading, score, heading * (2 * pi() / 8) - (((start_id % 628) + 628) % 628) / 100 AS x FROM x), i AS (SELECT start_id, heading, round(score - 1.5 * {_TURN}, 6) AS s FROM h)
      SELECT start_id, heading, {e('s', 3)} AS score_e3 FROM i QUALIFY row_number() OVER (PARTITION BY start_id ORDER BY s DESC, heading) = 1""",
    "init_gates": _gates_sql(False),
    "init_gates_relaxed": _gates_sql(True),
    "street_headings": f"""{space._FREE}, b AS (SELECT * FROM fr QUALIFY row_number() OVER (PARTITION BY start_id ORDER BY free DESC, heading) = 1)
      SELECT start_id, CAST(CASE WHEN free * 4.0 < 3 THEN ((start_id % 8) + 8) % 8 ELSE heading END AS INT) AS heading, {e('free * 4.0', 1)} AS ahead_e1 FROM b""",
    "street_risk": f"""WITH {space._BLD}, ce AS (SELECT DISTINCT ix + i AS ix, iy + j AS iy FROM bl, (SELECT unnest(range(-6, 7)) AS i), (SELECT unnest(range(-6, 7)) AS j)), c0 AS (SELECT * FROM ce ANTI JOIN bl USING (ix, iy)),
      ed AS (SELECT c0.ix, c0.iy, min(sqrt((bl.ix - c0.ix) ** 2 + (bl.iy - c0.iy) ** 2) * 4.0) AS d FROM c0 JOIN bl ON bl.ix BETWEEN c0.ix - 2 AND c0.ix + 2 AND bl.iy BETWEEN c0.iy - 2 AND c0.iy + 2 WHERE (bl.ix - c0.ix) ** 2 + (bl.iy - c0.iy) ** 2 <= 81.0 / 16 GROUP BY 1, 2),
      ax(k, dx, dy) AS (VALUES (0, 2, 0), (1, 0, 2), (2, 2, 2), (3, 2, -2)), fl AS (SELECT c0.ix, c0.iy, count(*) AS n FROM c0, ax JOIN bl p ON p.ix = c0.ix + dx AND p.iy = c0.iy + dy JOIN bl m ON m.ix = c0.ix - dx AND m.iy = c0.iy - dy GROUP BY 1, 2),
      rg AS (SELECT c0.ix, c0.iy, count(*) AS n FROM c0, (SELECT unnest([-3, 0, 3]) AS i), (SELECT unnest([-3, 0, 3]) AS j) JOIN bl ON bl.ix = c0.ix + i AND bl.iy = c0.iy + j WHERE i <> 0 OR j <> 0 GROUP BY 1, 2),
      t AS (SELECT c0.ix, c0.iy, coalesce(greatest(0.0, 1.0 - d / 9.0), 0.0) AS edge, least(1.0, coalesce(fl.n, 0) / 2.0) AS alley, greatest(0.0, least(1.0, (8 - coalesce(rg.n, 0) - 3.0) / 4.0)) AS crossing FROM c0 LEFT JOIN ed USING (ix, iy) LEFT JOIN fl USING (ix, iy) LEFT JOIN rg USING (ix, iy))
      SELECT ix, iy, {e('edge')} AS edge_e4, {e('alley')} AS alley_e4, {e('crossing')} AS crossing_e4, {e('least(1.0, greatest(0.70 * alley, 0.78 * edge) + 0.58 * crossing)')} AS risk_e4 FROM t""",
    "road_seeds": _SEEDS,
    "spiral_starts": _SPIRAL,
    "ground_field": f"WITH {space._POINTS}, {_FIELD} SELECT ix, iy, points, {e('floor', 3)} AS floor_e3, {e('roof', 3)} AS roof_e3, {e('open')} AS open_e4, open >= 0.6 AND floor <= 1e9 AS is_road FROM gf",
    "surface_lookup": f"""WITH {space._POINTS}, {_FIELD}, {space._RAYS}, q AS (SELECT ray_id AS point_id, {space._cell('bx')} AS px, {space._cell('by_')} AS py FROM ry), m AS (SELECT point_id, greatest(abs(ix - px), abs(iy - py)) AS ring, floor, roof FROM q JOIN gf ON ix BETWEEN px - 2 AND px + 2 AND iy BETWEEN py - 2 AND py + 2),
      n AS (SELECT point_id, min(ring) AS least FROM m GROUP BY 1), r AS (SELECT point_id, median(floor) AS ground, max(roof) AS roof FROM m JOIN n USING (point_id) WHERE ring <= least GROUP BY 1) SELECT point_id, {e('ground', 2)} AS ground_e2, {e('roof', 3)} AS roof_e3 FROM q LEFT JOIN r USING (point_id)""",
    "car_anchor": f"""WITH {space._RAYS}, {space._SITES}, p AS (SELECT ray_id AS point_id, site_id, sqrt((bx - x) ** 2 + (by_ - y) ** 2) AS dist FROM ry JOIN st ON abs(bx - x) <= 5 AND abs(by_ - y) <= 5), b AS (SELECT point_id, ((site_id % 7) + 7) % 7 AS base FROM p WHERE dist <= 5 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY dist, site_id) = 1)
      SELECT ray_id AS point_id, base FROM ry LEFT JOIN b ON b.point_id = ry.ray_id""",
}
