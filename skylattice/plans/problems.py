"""Queries of the data-quality operators in the core, and SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators import nested, spikes
from skylattice.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible_readings(table(spark, d, "frame_records")).select("episode_id", "frame_idx", "field_name").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.export_links(table(spark, d, "frame_exports")).select("raw_id", "node", "parent_key", "child_key")


def p5_tables(spark: SparkSession, d: str) -> DataFrame:
    """All flat tables of the exports, one row per record or array element, with its number of values."""
    rows = nested.flatten(table(spark, d, "frame_exports"), "raw_id", "payload", nested.EXPORT_TEXT, nested.EXPORT_LEVELS)
    return rows.select("record_id", "path", "node_key", "parent_path", "parent_key", "ordinal", F.size("fields").alias("n_fields"))


def p5_schema(spark: SparkSession, d: str) -> DataFrame:
    s = nested.infer_schema(table(spark, d, "frame_exports"), "payload", nested.EXPORT_TEXT)
    return s.select("path", F.array_join("kinds", ",").alias("kinds"))


def _links(spark: SparkSession, d: str, node: str) -> DataFrame:
    return nested.export_links(table(spark, d, "frame_exports")).where(F.col("node") == node)


def p5_poses(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d, "pose").select("raw_id", *[F.col("fields")[c].cast("double").alias(c) for c in "xyz"])


def p5_candidates(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("fields")
    xy = F.from_json(f["xy"], "array<double>")
    at = lambda i: F.try_element_at(xy, F.lit(i))
    return _links(spark, d, "candidate").select("raw_id", F.col("child_key").cast("int").alias("candidate"), at(1).alias("x"), at(2).alias("y"), f["score"].try_cast("double").alias("score"))


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("fields")
    return _links(spark, d, "term").select("raw_id", F.col("parent_key").cast("int").alias("candidate"), F.col("child_key").cast("int").alias("place"), nested.text_of(f["term"]).alias("term"), f["value"].try_cast("double").alias("value"), nested.text_of(f["note.by"]).alias("note_by"))


def p5_images(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d, "image").select("raw_id", F.col("child_key").alias("modality"), F.col("fields")["path"].alias("path"))


QUERIES = {q.__name__: q for q in (p4_found, p5_found, p5_tables, p5_schema, p5_poses, p5_candidates, p5_terms, p5_images)}


def _field_sql(field: str, parts: tuple[str, str, str], bad: str) -> str:
    def lag(i: int, c: str) -> str:
        return c if i == 0 else f"{'lag' if i < 0 else 'lead'}({c}, {abs(i)}) OVER w"

    shifted = ", ".join(f"{lag(i, c)} AS {c}{i + 3}" for i in range(-3, 4) for c in "xyz")

    def far(i: int, j: int) -> str:
        d = f"sqrt((x{i} - x{j}) ** 2 + (y{i} - y{j}) ** 2 + (z{i} - z{j}) ** 2)"
        return f"coalesce(NOT isnan({d}) AND {d} >= 20 * usual, false)"

    spikes_ = []
    for size in (1, 2, 3):
        for ahead in range(size):
            first = 3 - ahead
            last = first + size - 1
            spikes_.append("(" + " AND ".join(f"{far(k, first - 1)} AND {far(k, last + 1)}" for k in range(first, last + 1)) + ")")
    x, y, z = parts
    return f"""
SELECT DISTINCT episode_id, frame_idx, '{field}' AS field_name FROM (
  WITH s AS (SELECT episode_id, frame_idx, {x} AS x, {y} AS y, {z} AS z, vel, pose FROM f WHERE {x} IS NOT NULL),
  l AS (SELECT *, {shifted} FROM s WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx)),
  c AS (SELECT *, sqrt((x - x2) ** 2 + (y - y2) ** 2 + (z - z2) ** 2) AS step FROM l),
  u AS (SELECT episode_id, median(step) AS usual FROM c WHERE step > 0 AND isfinite(step) GROUP BY 1),
  n AS (SELECT *, sum(CASE WHEN x = x2 AND y = y2 AND z = z2 THEN 0 ELSE 1 END) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS run FROM c),
  q AS (SELECT episode_id, run, count(*) AS n, min(frame_idx) AS a, max(frame_idx) AS b FROM n GROUP BY ALL HAVING count(*) >= 12),
  t AS (SELECT q.episode_id, q.run, a, b,
               bool_and(coalesce(f.vel[1] = 0 AND f.vel[2] = 0 AND f.vel[3] = 0, true)) AND count(DISTINCT struct_pack(x := f.pose.x, y := f.pose.y, z := f.pose.z)) FILTER (f.pose IS NOT NULL) <= 1 AS rest
        FROM q JOIN f ON f.episode_id = q.episode_id AND f.frame_idx BETWEEN q.a AND q.b GROUP BY ALL)
  SELECT episode_id, frame_idx FROM n WHERE {bad}
  UNION ALL SELECT n.episode_id, frame_idx FROM n JOIN u USING (episode_id) WHERE {" OR ".join(spikes_)}
  UNION ALL SELECT n.episode_id, frame_idx FROM n JOIN t ON n.episode_id = t.episode_id AND n.run = t.run WHERE NOT rest)"""


def _p4_sql() -> str:
    beyond = lambda m: " OR ".join(f"NOT isfinite({c}) OR abs({c}) > {m}" for c in "xyz")
    fields = [
        _field_sql("drone_distance_m", ("d", "0.0", "0.0"), "NOT isfinite(x) OR x < 0 OR x > 10000"),
        _field_sql("target_velocity", ("vel[1]", "vel[2]", "vel[3]"), beyond(120)),
        _field_sql("target_pose_world", ("pose.x", "pose.y", "pose.z"), beyond(100000)),
    ]
    return """WITH f AS (SELECT episode_id, frame_idx, any_value(drone_distance_m) AS d, any_value(target_velocity) AS vel, any_value(target_pose_world) AS pose
  FROM frame_records WHERE episode_id IS NOT NULL AND frame_idx IS NOT NULL GROUP BY ALL)""" + " UNION ALL ".join(fields)


P5 = """
WITH p AS (SELECT raw_id, CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload) = 'VARCHAR' THEN json_extract_string(payload, '$') ELSE payload END END AS v FROM frame_exports),
o AS (SELECT raw_id, v FROM p WHERE json_valid(v) AND json_type(v) = 'OBJECT'),
g AS (
  SELECT raw_id, v, CASE WHEN json_type(v, '$.adversary_log') = 'VARCHAR' THEN json_extract_string(v, '$.adversary_log') ELSE CAST(json_extract(v, '$.adversary_log') AS VARCHAR) END AS log,
         CAST(json_extract(v, '$.drone_pose_world') AS VARCHAR) AS pose, CAST(json_extract(v, '$.images_saved') AS VARCHAR) AS images FROM o),
x AS (
  SELECT raw_id, CASE json_type(pose) WHEN 'ARRAY' THEN pose WHEN 'OBJECT' THEN
    CASE WHEN json_type(pose, '$.pos') = 'ARRAY' THEN CAST(json_extract(pose, '$.pos') AS VARCHAR)
         ELSE CAST(json_array(json_extract(pose, '$.x'), json_extract(pose, '$.y'), json_extract(pose, '$.z')) AS VARCHAR) END END AS xyz FROM g),
poses AS (SELECT raw_id FROM x WHERE json_type(xyz, '$[0]') IN ('DOUBLE', 'BIGINT', 'UBIGINT') AND json_type(xyz, '$[1]') IN ('DOUBLE', 'BIGINT', 'UBIGINT') AND json_type(xyz, '$[2]') IN ('DOUBLE', 'BIGINT', 'UBIGINT')),
c0 AS (
  SELECT raw_id, json_extract(log, p) AS c FROM g, (VALUES ('$.candidates'), ('$.decision.candidates'), ('$.agent.decision.candidates')) AS places(p)),
c1 AS (SELECT raw_id, CASE json_type(c) WHEN 'ARRAY' THEN CAST(c AS JSON[]) WHEN 'OBJECT' THEN [c] ELSE [] END AS l FROM c0),
c2 AS (SELECT raw_id, unnest(l) AS c, unnest(range(len(l))) AS i FROM c1),
cand AS (SELECT raw_id, i, json_extract(c, '$.terms') AS t FROM c2 WHERE json_type(c) <> 'NULL'),
t1 AS (SELECT raw_id, i, CASE json_type(t) WHEN 'ARRAY' THEN CAST(t AS JSON[]) WHEN 'OBJECT' THEN [t] ELSE [] END AS l FROM cand),
t2 AS (SELECT raw_id, i, unnest(l) AS t, unnest(range(len(l))) AS j FROM t1),
m1 AS (SELECT raw_id, unnest(json_keys(images)) AS k, images FROM g WHERE json_type(images) = 'OBJECT'),
m2 AS (SELECT raw_id, k, json_extract(images, '$."' || k || '"') AS e FROM m1
       UNION ALL SELECT raw_id, json_extract_string(e, '$.modality'), e FROM (SELECT raw_id, unnest(CAST(images AS JSON[])) AS e FROM g WHERE json_type(images) = 'ARRAY')),
m3 AS (SELECT DISTINCT raw_id, k FROM m2 WHERE k IS NOT NULL AND CASE json_type(e) WHEN 'VARCHAR' THEN json_extract_string(e, '$') WHEN 'OBJECT' THEN json_extract_string(e, '$.path') END <> '')
"""
P5_LINKS = """
SELECT raw_id, 'pose' AS node, '' AS parent_key, '' AS child_key FROM poses
UNION ALL SELECT raw_id, 'candidate', '', CAST(i AS VARCHAR) FROM cand
UNION ALL SELECT raw_id, 'term', CAST(i AS VARCHAR), CAST(j AS VARCHAR) FROM t2 WHERE json_type(t) <> 'NULL'
UNION ALL SELECT raw_id, 'image', '', k FROM m3
"""

#: Each value with the path of the row it belongs to: array levels of the exports are named, other arrays are values.
P5_TREE = r"""
WITH p AS (SELECT raw_id, CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload) = 'VARCHAR' THEN json_extract_string(payload, '$') ELSE payload END END AS v FROM frame_exports),
o AS (SELECT raw_id, v, json_type(v, '$.adversary_log') = 'VARCHAR' AND json_valid(json_extract_string(v, '$.adversary_log')) AS packed FROM p WHERE json_valid(v) AND json_type(v) = 'OBJECT'),
t AS (SELECT raw_id, t.fullkey AS k, t.type AS ty FROM o, json_tree(o.v) t WHERE NOT (coalesce(packed, false) AND t.fullkey = '$.adversary_log')
      UNION ALL SELECT raw_id, '$.adversary_log' || substr(t.fullkey, 2), t.type FROM o, json_tree(CASE WHEN packed THEN json_extract_string(o.v, '$.adversary_log') ELSE 'null' END) t WHERE packed),
k AS (SELECT raw_id, ltrim(replace(regexp_replace(substr(k, 2), '\[[0-9]+\]', '[]', 'g'), '"', ''), '.') AS path, CASE ty WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' ELSE 'number' END AS kind FROM t)
"""

#: The rows of the flat tables: the record itself and the elements of the three named levels, a lone object being the first.
P5_ROWS = P5_TREE + r"""
, l0 AS (SELECT raw_id, ty, replace(substr(k, 2), '"', '') AS k FROM t),
l1 AS (SELECT raw_id, ty, regexp_replace(regexp_replace(CASE WHEN ty = 'OBJECT' AND regexp_matches(k, '\.(candidates|terms|images_saved)$') THEN k || '[0]' ELSE k END, '\.(candidates|terms|images_saved)\.', '.\1[0].', 'g'), '\.(candidates|terms|images_saved)\.', '.\1[0].', 'g') AS k FROM l0),
l2 AS (SELECT *, regexp_matches(k, '\.(candidates|terms|images_saved)\[[0-9]+\]$') AS element, contains(regexp_replace(k, '\.(candidates|terms|images_saved)\[[0-9]+\]', '', 'g'), '[') AS inside FROM l1),
n0 AS (SELECT raw_id, '' AS k FROM l1 WHERE k = '' UNION ALL SELECT raw_id, k FROM l2 WHERE element AND NOT inside AND ty <> 'NULL'),
f0 AS (SELECT raw_id, CASE WHEN element THEN k ELSE regexp_extract(k, '^(.*\])', 1) END AS row_k FROM l2 WHERE NOT inside AND ty NOT IN ('OBJECT', 'NULL') AND k <> '' AND NOT (ty = 'ARRAY' AND regexp_matches(k, '\.(candidates|terms|images_saved)$'))),
f1 AS (SELECT raw_id, row_k, count(*) AS n FROM f0 GROUP BY 1, 2),
n1 AS (SELECT n0.*, regexp_extract(k, '^(.*\])[^\]]*\[[0-9]+\]$', 1) AS up, list_transform(regexp_extract_all(k, '\[([0-9]+)\]', 1), lambda x: CAST(x AS INT)) AS idx FROM n0)
SELECT n1.raw_id AS record_id, ltrim(regexp_replace(k, '\[[0-9]+\]', '', 'g'), '.') AS path, array_to_string(idx, '/') AS node_key, ltrim(regexp_replace(up, '\[[0-9]+\]', '', 'g'), '.') AS parent_path,
  array_to_string(idx[:-2], '/') AS parent_key, idx[-1] AS ordinal, CAST(coalesce(f1.n, 0) AS INT) AS n_fields FROM n1 LEFT JOIN f1 ON f1.raw_id = n1.raw_id AND f1.row_k = n1.k
"""
_NUMBER = "CASE WHEN json_type({0}) IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST({0} AS DOUBLE) END"
ORACLE = {
    "p4_found": _p4_sql(),
    "p5_found": P5 + P5_LINKS,
    "p5_tables": P5_ROWS,
    "p5_schema": P5_TREE + "SELECT path, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM k GROUP BY 1",
    "p5_poses": P5 + "SELECT raw_id, CAST(json_extract(xyz, '$[0]') AS DOUBLE) AS x, CAST(json_extract(xyz, '$[1]') AS DOUBLE) AS y, CAST(json_extract(xyz, '$[2]') AS DOUBLE) AS z FROM x JOIN poses USING (raw_id)",
    "p5_candidates": P5 + f"SELECT raw_id, CAST(i AS INT) AS candidate, {_NUMBER.format('json_extract(c, $$$.xy[0]$$)')} AS x, {_NUMBER.format('json_extract(c, $$$.xy[1]$$)')} AS y, {_NUMBER.format('json_extract(c, $$$.score$$)')} AS score FROM c2 WHERE json_type(c) <> 'NULL'",
    "p5_terms": P5 + f"SELECT raw_id, CAST(i AS INT) AS candidate, CAST(j AS INT) AS place, json_extract_string(t, '$.term') AS term, {_NUMBER.format('json_extract(t, $$$.value$$)')} AS value, json_extract_string(t, '$.note.by') AS note_by FROM t2 WHERE json_type(t) <> 'NULL'",
    "p5_images": P5 + "SELECT DISTINCT raw_id, k AS modality, CASE json_type(e) WHEN 'VARCHAR' THEN json_extract_string(e, '$') WHEN 'OBJECT' THEN json_extract_string(e, '$.path') END AS path FROM m2 WHERE k IS NOT NULL AND CASE json_type(e) WHEN 'VARCHAR' THEN json_extract_string(e, '$') WHEN 'OBJECT' THEN json_extract_string(e, '$.path') END <> ''",
}
