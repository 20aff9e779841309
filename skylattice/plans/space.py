"""Queries over point clouds, grids and rays, and SQL for them. Points are the recorded drone and target positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators import kinematics
from skylattice.operators import occupancy as occ
from skylattice.operators.metrics import scaled
from skylattice.session import table

GRID = occ.Grid(voxel=4.0, building=17.0, ground_below=2.0, large=17.5, large_cells=4, road_extent=5.0)
#: Metres within which lines of sight are asked; beyond, the answer is null.
RANGE = 100.0


def points(spark: SparkSession, d: str) -> DataFrame:
    """Map coordinates (z up) of both poses of every record."""
    f = table(spark, d, "frame_records")
    both = F.explode(F.array(F.struct(F.col("target_pose_world").alias("p"), F.lit(0).alias("k")), F.struct(F.col("drone_pose_world").alias("p"), F.lit(1).alias("k")))).alias("q")
    return f.select("record_id", both).where("q.p is not null").select((F.col("record_id") * 2 + F.col("q.k")).alias("point_id"), F.col("q.p.x").alias("x"), (-F.col("q.p.y")).alias("y"), (-F.col("q.p.z")).alias("z"))


def rays(spark: SparkSession, d: str) -> DataFrame:
    """From drone to target, for every record that has both."""
    f = table(spark, d, "frame_records").where("drone_pose_world is not null and target_pose_world is not null")
    u, t = F.col("drone_pose_world"), F.col("target_pose_world")
    return f.select(F.col("record_id").alias("ray_id"), u["x"].alias("ax"), (-u["y"]).alias("ay"), (-u["z"]).alias("az"), t["x"].alias("bx"), (-t["y"]).alias("by"), (-t["z"]).alias("bz"))


def sites(spark: SparkSession, d: str) -> DataFrame:
    """Where episodes begin (the first frame with a drone pose), as site_id (its smallest record id), x, y."""
    f = table(spark, d, "frame_records").where("frame_idx is not null and drone_pose_world is not null")
    return f.groupBy("episode_id").agg(F.min(F.struct("frame_idx", "record_id", F.col("drone_pose_world.x").alias("x"), F.col("drone_pose_world.y").alias("y"))).alias("s")).select(F.col("s.record_id").alias("site_id"), "s.x", (-F.col("s.y")).alias("y"))


def _columns(spark, d):
    return occ.columns2d(points(spark, d), GRID)


def _voxels(spark, d):
    return occ.voxels(points(spark, d), GRID)


def voxelize(spark, d):
    return _voxels(spark, d)


def column_heights(spark, d):
    c = _columns(spark, d)
    return c.select("ix", "iy", *[scaled(F.col(x), 3).alias(f"{x}_e3") for x in ("roof_z", "low_z", "ground_z")], "points", "support", "obstacles", "is_building", "is_obstacle")


def building_footprint(spark, d):
    return occ.building_flags(_columns(spark, d), GRID).select("ix", "iy", "footprint", "blocks", "is_large")


def dilate_2d(spark, d):
    return occ.dilated2d(_columns(spark, d).where("is_building"), 2)


def dilate_3d(spark, d):
    return occ.dilated3d(_voxels(spark, d), 1)


def blocked_union(spark, d):
    c = _columns(spark, d)
    return c.where("is_building").select("ix", "iy").unionByName(c.where("is_obstacle").select("ix", "iy")).distinct()


def occupied_lookup(spark, d):
    """Whether the point halfway between drone and target lies in an occupied voxel."""
    mid = rays(spark, d).select("ray_id", *[((F.col(f"a{c}") + F.col(f"b{c}")) / 2).alias(c) for c in "xyz"])
    return occ.occupied(mid, _voxels(spark, d), GRID).select("ray_id", "occupied")


def los_raymarch(spark, d):
    r = occ.line_of_sight(rays(spark, d), _voxels(spark, d), occ.building_flags(_columns(spark, d), GRID), GRID, reach=RANGE)
    return r.select("ray_id", "blocked")


def first_hit(spark, d):
    r = occ.line_of_sight(rays(spark, d), _voxels(spark, d), occ.building_flags(_columns(spark, d), GRID), GRID, reach=RANGE)
    return r.where("blocked").select("ray_id", scaled(F.col("first_t")).alias("first_t_e4"))


def building_los(spark, d):
    return occ.line_of_sight(rays(spark, d), _voxels(spark, d), occ.building_flags(_columns(spark, d), GRID), GRID, largest=True, reach=RANGE).select("ray_id", "blocked")


def roof_los(spark, d):
    return occ.roof_los(rays(spark, d), _columns(spark, d), GRID, reach=RANGE)


def nearest_site(spark, d):
    p = rays(spark, d).select(F.col("ray_id").alias("point_id"), F.col("bx").alias("x"), F.col("by").alias("y"))
    return occ.nearest(p, sites(spark, d), 30.0).select("point_id", "site_id", scaled(F.col("distance"), 3).alias("distance_e3"))


def site_pairs(spark, d):
    return occ.site_pairs(sites(spark, d), 10.0, 36.0).select("site_a", "site_b", scaled(F.col("gap"), 3).alias("gap_e3"))


def _starts(spark, d):
    return sites(spark, d).select(F.col("site_id").alias("start_id"), occ.cell(F.col("x"), GRID.voxel).alias("ix"), occ.cell(F.col("y"), GRID.voxel).alias("iy"))


def free_run_length(spark, d):
    return occ.free_runs(_starts(spark, d), _columns(spark, d).where("is_building"), 8, 12)


def road_score(spark, d):
    free = occ.free_runs(_starts(spark, d), _columns(spark, d).where("is_building"), 8, 12)
    return occ.corridor(free, 8).where("place = 1").select("start_id", "heading", "forward", "back", "width", scaled(F.col("score"), 2).alias("score_e2"))


def move_resolution(spark, d):
    moves = rays(spark, d).select(F.col("ray_id").alias("move_id"), "ax", "ay", "bx", "by")
    return occ.resolved_moves(moves, _columns(spark, d).where("is_building"), GRID).select("move_id", scaled(F.col("share"), 2).alias("share_e2"))


def connected_components(spark, d):
    return occ.components(_columns(spark, d).where("is_building"))


def histogram_floor(spark, d):
    p = points(spark, d)
    return occ.column_floor(p, GRID.voxel).select("ix", "iy", scaled(F.col("floor"), 1).alias("floor_e1"))


def openness(spark, d):
    p = points(spark, d)
    return occ.openness(p, occ.column_floor(p, GRID.voxel), GRID.voxel).select("ix", "iy", scaled(F.col("open")).alias("open_e4"))


def parked_cars(spark, d):
    """Groups of points of a car's height and size under open sky, with the detector's own limits."""
    p = points(spark, d)
    c = occ.parked_cars(p, occ.column_floor(p, GRID.voxel), GRID.voxel)
    return c.select("label", "points", scaled(F.col("width_x"), 2).alias("width_x_e2"), scaled(F.col("width_y"), 2).alias("width_y_e2"))


def risk_field(spark, d):
    r = occ.risk_field(_columns(spark, d).where("is_building"), GRID)
    return r.select("ix", "iy", *[scaled(F.col(c)).alias(f"{c}_e4") for c in ("edge", "alley", "risk")])


def risk_peaks(spark, d):
    """The riskiest free cells, none within twelve metres of a riskier one."""
    r = occ.risk_field(_columns(spark, d).where("is_building"), GRID)
    p = r.select((F.col("ix").cast("bigint") * (1 << 31) + F.col("iy")).alias("point_id"), "ix", "iy", (F.col("ix") * GRID.voxel).alias("x"), (F.col("iy") * GRID.voxel).alias("y"), scaled(F.col("risk")).alias("score"))
    return kinematics.thinned(p, 12.0).select("ix", "iy", F.col("score").alias("risk_e4"))


def height_lookup(spark, d):
    p = rays(spark, d).select(F.col("ray_id").alias("point_id"), F.col("bx").alias("x"), F.col("by").alias("y"))
    h = occ.lookup_heights(p, _columns(spark, d), GRID)
    return h.select("point_id", *[scaled(F.col(c), 3).alias(f"{c}_e3") for c in ("roof", "ground", "safe", "car")])


QUERIES = {
    q.__name__: q
    for q in (
        voxelize, column_heights, building_footprint, dilate_2d, dilate_3d, blocked_union, occupied_lookup, los_raymarch, first_hit, building_los, roof_los,
        nearest_site, site_pairs, free_run_length, road_score, move_resolution, connected_components, histogram_floor, openness, parked_cars, risk_field, risk_peaks, height_lookup,
    )
}

# SQL ----------------------------------------------------------------------------------------------------------------


def e(x: str, k: int = 4) -> str:
    return f"CAST(floor(({x}) * 1e{k} + 0.5) AS BIGINT)"


def _cell(x: str, s: float = 4.0) -> str:
    return f"CASE WHEN isfinite({x}) AND abs({x}) < {s * occ.CELLS} THEN CAST(floor(({x}) / {s}) AS INT) END"


def _real(*columns: str) -> str:
    return " AND ".join(f"coalesce(isfinite({c}) AND abs({c}) < {occ.REAL}, false)" for c in columns)


_POINTS = f"""pt0 AS (SELECT target_pose_world AS p FROM frame_records UNION ALL SELECT drone_pose_world FROM frame_records),
pt AS (SELECT * FROM (SELECT x, y, z, {_cell('x')} AS ix, {_cell('y')} AS iy, {_cell('z')} AS iz FROM (SELECT p.x AS x, -p.y AS y, -p.z AS z FROM pt0 WHERE p IS NOT NULL)) WHERE ix IS NOT NULL AND iy IS NOT NULL AND iz IS NOT NULL)"""
_COLUMNS = f"""{_POINTS},
c1 AS (SELECT ix, iy, max(z) AS roof_z, min(z) AS low_z, min(z) FILTER (z >= -2 AND z < 17) AS ground_z, count(*) AS points FROM pt GROUP BY 1, 2),
c2 AS (SELECT ix, iy, count(*) FILTER (z - ground_z <= 0.8) AS support, count(*) FILTER (z - ground_z >= 0.6) AS obstacles FROM pt JOIN c1 USING (ix, iy) WHERE z >= -2 AND z < 17 GROUP BY 1, 2),
co AS (SELECT ix, iy, roof_z, low_z, ground_z, points, coalesce(support, 0) AS support, coalesce(obstacles, 0) AS obstacles, roof_z >= 17 AS is_building, coalesce(obstacles, 0) >= 2 AS is_obstacle FROM c1 LEFT JOIN c2 USING (ix, iy))"""
_BLD = f"{_COLUMNS}, bl AS (SELECT ix, iy FROM co WHERE is_building)"
_FLAGS = f"""{_BLD}, fp AS (SELECT b.ix, b.iy, count(*) AS footprint FROM bl b JOIN bl o ON o.ix BETWEEN b.ix - 2 AND b.ix + 2 AND o.iy BETWEEN b.iy - 2 AND b.iy + 2 GROUP BY 1, 2),
fl AS (SELECT ix, iy, coalesce(footprint, 0) AS footprint, roof_z - low_z > 5 AS blocks, roof_z - low_z > 5 AND is_building AND roof_z >= 17.5 AND coalesce(footprint, 0) >= 4 AS is_large FROM co LEFT JOIN fp USING (ix, iy))"""
_RAYS = """ry AS (SELECT *, coalesce((ax - bx) ** 2 + (ay - by_) ** 2 + (az - bz) ** 2 <= 10000, false) AS near FROM (
  SELECT record_id AS ray_id, drone_pose_world.x AS ax, -drone_pose_world.y AS ay, -drone_pose_world.z AS az, target_pose_world.x AS bx, -target_pose_world.y AS by_, -target_pose_world.z AS bz
  FROM frame_records WHERE drone_pose_world IS NOT NULL AND target_pose_world IS NOT NULL))"""
_SAMPLES = f"""rl AS (SELECT *, sqrt((ax - bx) ** 2 + (ay - by_) ** 2 + (az - bz) ** 2) AS length FROM ry WHERE near), rs AS (SELECT *, greatest(4, TRY_CAST(floor(length / 4.0) AS INT)) AS steps FROM rl),
ru AS (SELECT *, unnest(range(1, steps)) AS step FROM rs), rt AS (SELECT ray_id, length, step / steps AS t, ax + (bx - ax) * (step / steps) AS x, ay + (by_ - ay) * (step / steps) AS y, az + (bz - az) * (step / steps) AS z FROM ru),
sm AS (SELECT *, {_cell('x')} AS ix, {_cell('y')} AS iy, {_cell('z')} AS iz FROM rt)"""
_HITS = f"WITH {_FLAGS}, {_RAYS}, {_SAMPLES}, vx AS (SELECT DISTINCT ix, iy, iz FROM pt), hit AS (SELECT ray_id, min(t) AS t FROM sm JOIN vx USING (ix, iy, iz) JOIN fl USING (ix, iy) WHERE {{}} GROUP BY 1) "
_SITES = "st AS (SELECT s.record_id AS site_id, s.x AS x, -s.y AS y FROM (SELECT min(struct_pack(frame_idx := frame_idx, record_id := record_id, x := drone_pose_world.x, y := drone_pose_world.y)) AS s FROM frame_records WHERE drone_pose_world IS NOT NULL AND frame_idx IS NOT NULL GROUP BY episode_id))"


def _directions() -> str:
    import math

    return ", ".join(f"({h}, {s}, {round(s * math.cos(2 * math.pi * h / 8))}, {round(s * math.sin(2 * math.pi * h / 8))})" for h in range(8) for s in range(1, 13))


_FREE = f"""WITH {_BLD}, {_SITES}, o(h, s, dx, dy) AS (VALUES {_directions()}), sc AS (SELECT site_id AS start_id, {_cell('x')} AS ix, {_cell('y')} AS iy FROM st),
ht AS (SELECT start_id, h, min(s) AS hit FROM sc, o JOIN bl ON bl.ix = sc.ix + dx AND bl.iy = sc.iy + dy GROUP BY 1, 2),
fr AS (SELECT start_id, hh.h AS heading, coalesce(hit, 13) - 1 AS free FROM sc CROSS JOIN (SELECT DISTINCT h FROM o) hh LEFT JOIN ht USING (start_id, h))"""
_FLOOR = f"""{_POINTS}, b0 AS (SELECT ix, iy, CAST(floor(z / 0.5) AS INT) AS b, count(*) AS n FROM pt GROUP BY 1, 2, 3),
b1 AS (SELECT *, sum(n) OVER (PARTITION BY ix, iy) AS total, sum(n) OVER (PARTITION BY ix, iy ORDER BY b) AS upto FROM b0),
b2 AS (SELECT *, max(n) OVER (PARTITION BY ix, iy) AS peak FROM b1 WHERE total >= 5 AND upto > 0.01 * total AND upto - n < 0.99 * total),
fo AS (SELECT ix, iy, min(b) * 0.5 AS floor FROM b2 WHERE n >= 0.2 * peak GROUP BY 1, 2)"""

ORACLE = {
    "voxelize": f"WITH {_POINTS} SELECT DISTINCT ix, iy, iz FROM pt",
    "column_heights": f"WITH {_COLUMNS} SELECT ix, iy, {e('roof_z', 3)} AS roof_z_e3, {e('low_z', 3)} AS low_z_e3, {e('ground_z', 3)} AS ground_z_e3, points, support, obstacles, is_building, is_obstacle FROM co",
    "building_footprint": f"WITH {_FLAGS} SELECT * FROM fl",
    "dilate_2d": f"WITH {_BLD} SELECT DISTINCT ix + i AS ix, iy + j AS iy FROM bl, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j) WHERE i * i + j * j <= 4",
    "dilate_3d": f"WITH {_POINTS}, v AS (SELECT DISTINCT ix, iy, iz FROM pt) SELECT DISTINCT ix + i AS ix, iy + j AS iy, iz + k AS iz FROM v, (SELECT unnest(range(-1, 2)) AS i), (SELECT unnest(range(-1, 2)) AS j), (SELECT unnest(range(-1, 2)) AS k) WHERE i * i + j * j + k * k <= 1",
    "blocked_union": f"WITH {_COLUMNS} SELECT ix, iy FROM co WHERE is_building OR is_obstacle",
    "occupied_lookup": f"WITH {_POINTS}, {_RAYS}, vx AS (SELECT DISTINCT ix, iy, iz, true AS o FROM pt), m AS (SELECT ray_id, {_cell('(ax + bx) / 2')} AS ix, {_cell('(ay + by_) / 2')} AS iy, {_cell('(az + bz) / 2')} AS iz FROM ry) SELECT ray_id, CASE WHEN ix IS NOT NULL AND iy IS NOT NULL AND iz IS NOT NULL THEN coalesce(o, false) END AS occupied FROM m LEFT JOIN vx USING (ix, iy, iz)",
    "los_raymarch": _HITS.format("blocks") + "SELECT ray_id, CASE WHEN near THEN t IS NOT NULL END AS blocked FROM ry LEFT JOIN hit USING (ray_id)",
    "first_hit": _HITS.format("blocks") + f"SELECT ray_id, {e('t')} AS first_t_e4 FROM hit",
    "building_los": _HITS.format("is_large") + "SELECT ray_id, CASE WHEN near THEN t IS NOT NULL END AS blocked FROM ry LEFT JOIN hit USING (ray_id)",
    "roof_los": f"WITH {_COLUMNS}, {_RAYS}, {_SAMPLES}, h AS (SELECT ray_id, bool_or(z < roof_z - 1.5) AS b FROM sm JOIN co USING (ix, iy) WHERE t * length >= 2 AND (1 - t) * length >= 2 GROUP BY 1) SELECT ray_id, CASE WHEN near THEN coalesce(b, false) END AS blocked FROM ry LEFT JOIN h USING (ray_id)",
    "nearest_site": f"WITH {_RAYS}, {_SITES}, p AS (SELECT ray_id AS point_id, site_id, sqrt((bx - x) ** 2 + (by_ - y) ** 2) AS dist FROM ry JOIN st ON abs(bx - x) <= 30 AND abs(by_ - y) <= 30) SELECT point_id, site_id, {e('dist', 3)} AS distance_e3 FROM p WHERE dist <= 30 QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY dist, site_id) = 1",
    "site_pairs": f"WITH {_SITES}, p AS (SELECT a.site_id AS site_a, b.site_id AS site_b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS gap FROM st a JOIN st b ON a.site_id < b.site_id) SELECT site_a, site_b, {e('gap', 3)} AS gap_e3 FROM p WHERE gap BETWEEN 10 AND 36",
    "free_run_length": _FREE + " SELECT start_id, heading, free FROM fr",
    "road_score": _FREE
    + f""", w AS (SELECT a.start_id, a.heading, a.free AS forward, b.free AS back, l.free + r.free + 1 AS width FROM fr a JOIN fr b ON b.start_id = a.start_id AND b.heading = (a.heading + 4) % 8 JOIN fr l ON l.start_id = a.start_id AND l.heading = (a.heading + 2) % 8
      JOIN fr r ON r.start_id = a.start_id AND r.heading = (a.heading + 6) % 8), x AS (SELECT *, forward + 0.25 * back + 2.0 * width AS score FROM w)
      SELECT start_id, heading, forward, back, width, {e('score', 2)} AS score_e2 FROM x QUALIFY row_number() OVER (PARTITION BY start_id ORDER BY score DESC, heading) = 1""",
    "move_resolution": f"""WITH {_BLD}, {_RAYS}, n AS (SELECT *, greatest(2, CAST(ceil(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2) / 2.0) AS INT)) AS n FROM ry WHERE {_real('ax', 'ay', 'bx', 'by_')}), k AS (SELECT *, unnest(range(1, n + 1)) AS k FROM n),
      w AS (SELECT ray_id, min(k / n) AS wall FROM k JOIN bl ON bl.ix = {_cell('ax + (bx - ax) * (k / n)')} AND bl.iy = {_cell('ay + (by_ - ay) * (k / n)')} GROUP BY 1)
      SELECT ray_id AS move_id, CASE WHEN NOT ({_real('ax', 'ay', 'bx', 'by_')}) THEN NULL WHEN wall IS NULL OR wall > 1 THEN 100 WHEN wall > 0.75 THEN 75 WHEN wall > 0.5 THEN 50 WHEN wall > 0.25 THEN 25 WHEN wall > 0.1 THEN 10 WHEN wall > 0.05 THEN 5 ELSE 0 END AS share_e2 FROM ry LEFT JOIN w USING (ray_id)""",
    "histogram_floor": f"WITH {_FLOOR} SELECT ix, iy, {e('floor', 1)} AS floor_e1 FROM fo",
    "parked_cars": f"""WITH RECURSIVE {_FLOOR}, hp AS (SELECT pt.*, z - floor AS h FROM pt JOIN fo USING (ix, iy)), op AS (SELECT ix, iy FROM hp GROUP BY 1, 2 HAVING max(h) < 4.0), bo AS (SELECT hp.* FROM hp SEMI JOIN op USING (ix, iy) WHERE h BETWEEN 0.3 AND 2.2), bl AS (SELECT DISTINCT ix, iy FROM bo),
      r(ix, iy, sx, sy) AS (SELECT ix, iy, ix, iy FROM bl UNION SELECT b.ix, b.iy, r.sx, r.sy FROM r JOIN bl b ON b.ix BETWEEN r.ix - 1 AND r.ix + 1 AND b.iy BETWEEN r.iy - 1 AND r.iy + 1),
      lb AS (SELECT ix, iy, min((CAST(sx AS BIGINT) + 1073741824) * 2147483648 + sy + 1073741824) AS label FROM r GROUP BY 1, 2), bx AS (SELECT label, count(*) AS points, max(x) - min(x) AS wx, max(y) - min(y) AS wy FROM bo JOIN lb USING (ix, iy) GROUP BY 1)
      SELECT label, points, {e('wx', 2)} AS width_x_e2, {e('wy', 2)} AS width_y_e2 FROM bx WHERE points >= 25 AND greatest(wx, wy) BETWEEN 1.3 AND 7.0""",
    "openness": f"WITH {_FLOOR} SELECT ix, iy, {e('avg(CAST(z <= floor + 1.0 AS INT))')} AS open_e4 FROM pt JOIN fo USING (ix, iy) GROUP BY 1, 2",
    "risk_field": f"""WITH {_BLD}, o AS (SELECT i, j FROM (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j) WHERE i * i + j * j <= 4),
      s AS (SELECT ix + i AS ix, iy + j AS iy, i, j FROM bl, o), c AS (SELECT ix, iy, min(sqrt(i * i + j * j) * 4.0) AS d, max(CAST(i = 0 AND j BETWEEN 1 AND 3 AS INT)) + max(CAST(i = 0 AND -j BETWEEN 1 AND 3 AS INT)) AS ns, max(CAST(j = 0 AND i BETWEEN 1 AND 3 AS INT)) + max(CAST(j = 0 AND -i BETWEEN 1 AND 3 AS INT)) AS ew FROM s GROUP BY 1, 2),
      f AS (SELECT ix, iy, greatest(0.0, 1.0 - d / 9.0) AS edge, CASE WHEN ns = 2 OR ew = 2 THEN 1.0 ELSE least(1.0, (ns + ew) / 2.0) END AS alley FROM c WHERE (ix, iy) NOT IN (SELECT (ix, iy) FROM bl))
      SELECT ix, iy, {e('edge')} AS edge_e4, {e('alley')} AS alley_e4, {e('least(1.0, greatest(0.70 * alley, 0.78 * edge))')} AS risk_e4 FROM f""",
    "height_lookup": f"WITH {_COLUMNS}, {_RAYS}, p AS (SELECT ray_id AS point_id, {_cell('bx')} AS ix, {_cell('by_')} AS iy FROM ry), h AS (SELECT point_id, CASE WHEN ix IS NOT NULL AND iy IS NOT NULL THEN coalesce(roof_z, 0.0) END AS roof, CASE WHEN ix IS NOT NULL AND iy IS NOT NULL THEN coalesce(ground_z, 0.0) END AS ground FROM p LEFT JOIN co USING (ix, iy)) SELECT point_id, {e('roof', 3)} AS roof_e3, {e('ground', 3)} AS ground_e3, {e('roof + 8.0', 3)} AS safe_e3, {e('ground + 0.35', 3)} AS car_e3 FROM h",
    "connected_components": f"""WITH RECURSIVE {_BLD}, r(ix, iy, sx, sy) AS (SELECT ix, iy, ix, iy FROM bl UNION SELECT b.ix, b.iy, r.sx, r.sy FROM r JOIN bl b ON b.ix BETWEEN r.ix - 1 AND r.ix + 1 AND b.iy BETWEEN r.iy - 1 AND r.iy + 1)
      SELECT ix, iy, min((CAST(sx AS BIGINT) + 1073741824) * 2147483648 + sy + 1073741824) AS label FROM r GROUP BY 1, 2""",
}
