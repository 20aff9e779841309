"""Queries of validation, policies, routes and streaming, and SQL where SQL can state them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.functions.poses import parse_pose
from skylattice.operators import episode_files, paths, policies, validation
from skylattice.operators.metrics import distinct_episodes, distinct_frames, episode_metrics, quantile, scaled
from skylattice.operators.text import instruction_stats
from skylattice.plans import texts, tracking
from skylattice.plans.tracking import EPISODES, FRAMES, e
from skylattice.session import scratch_dir, table
from skylattice.streaming import live


def validate_episodes(spark: SparkSession, d: str) -> DataFrame:
    return validation.checked_episodes(table(spark, d, "episodes")).groupBy(F.coalesce("issue", F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def validate_frames(spark, d):
    return validation.checked_frames(table(spark, d, "frame_records")).where("issue is not null").select("record_id", "issue")


def validation_issues(spark, d):
    r = validation.batch_report(table(spark, d, "episodes"), table(spark, d, "frame_records"))
    return r.select("episode_id", "frames", "passed", F.size("issues").alias("issues"))


def batch_manifest(spark, d):
    return validation.batch_manifest(validation.batch_report(table(spark, d, "episodes"), table(spark, d, "frame_records")))


def missing_exports(spark, d):
    """Frames of the metadata that no export mentions, counted by episode: an anti join on (episode, frame)."""
    f = table(spark, d, "frame_records").where("episode_id is not null").select("episode_id", "frame_idx").distinct()
    x = table(spark, d, "frame_exports").select(F.get_json_object("payload", "$.episode_id").alias("episode_id"), F.get_json_object("payload", "$.frame_idx").try_cast("int").alias("frame_idx")).where("episode_id is not null").distinct()
    return f.join(x, ["episode_id", "frame_idx"], "left_anti").groupBy("episode_id").agg(F.count(F.lit(1)).alias("missing"))


def export_types(spark, d):
    """Of each readable export: whether frame_idx is an integer (no truth value) and timestamp_s a number."""
    x = table(spark, d, "frame_exports").select("raw_id", F.try_parse_json("payload").alias("r")).where("r is not null and schema_of_variant(r) like 'OBJECT%'")
    return x.select("raw_id", episode_files.is_whole(F.col("r"), "frame_idx").alias("whole_index"), episode_files.is_number(F.col("r"), "timestamp_s").alias("numeric_time"))


def frame_bundle(spark, d):
    """Frames with their episode, its kept texts and its last report; nulls as a viewer reads them: frustum as visible, line
    of sight clear, distance and risk unknown."""
    ep = distinct_episodes(table(spark, d, "episodes")).select("episode_id", "difficulty_level")
    kept = table(spark, d, "filter_results").where("episode_id is not null").dropDuplicates(["result_id"]).groupBy("episode_id").agg(F.sum(F.greatest(F.size("kept"), F.lit(0))).alias("texts"))
    last = table(spark, d, "demo_reports").where("episode_id is not null and reported_at is not null").groupBy("episode_id").agg(F.max(F.struct("reported_at", "report_id", "success")).alias("r")).select("episode_id", "r.success")
    f = distinct_frames(table(spark, d, "frame_records")).join(ep, "episode_id", "left").join(kept, "episode_id", "left").join(last, "episode_id", "left")
    number = lambda c, k: scaled(F.coalesce(F.col(c), F.lit(-1.0)), k).alias(f"{c}_e{k}")
    return f.select("episode_id", "frame_idx", "difficulty_level", F.coalesce("texts", F.lit(0)).alias("texts"), "success", F.coalesce("in_camera_frustum", "target_visible").alias("in_frustum"), F.coalesce("line_of_sight_clear", F.lit(True)).alias("clear"), number("occlusion_risk", 4), number("drone_distance_m", 3))


def dataset_report(spark, d):
    """One row: episodes, levels, mean visible share, kept and rejected texts."""
    ep = distinct_episodes(table(spark, d, "episodes"))
    m = episode_metrics(distinct_frames(table(spark, d, "frame_records")), ep)
    quality = m.agg(F.count(F.lit(1)).alias("episodes"), F.countDistinct("difficulty_level").alias("levels"), scaled(F.avg("visibility_ratio")).alias("visible_e4"), F.count_if("tracking_success").alias("successes"))
    return quality.join(instruction_stats(table(spark, d, "filter_results").dropDuplicates(["result_id"])).select("results", "instructions", "rejected"))


def tracker_fsm(spark, d):
    return policies.tracker_modes(distinct_frames(table(spark, d, "frame_records")))


def policy_rollout(spark, d):
    e = distinct_episodes(table(spark, d, "episodes")).select("*", parse_pose("uav_initial_pose").alias("u"), parse_pose("target_initial_pose").alias("t"))
    names = F.array(*[F.lit(p) for p in policies.POLICIES])
    specs = e.select("episode_id", F.element_at(names, (F.pmod(F.xxhash64("episode_id"), F.lit(len(policies.POLICIES))) + 1).cast("int")).alias("policy"), F.col("difficulty_level").alias("difficulty"), F.coalesce("random_seed", F.lit(0)).cast("bigint").alias("seed"), F.col("t.x").alias("x"), F.col("t.y").alias("y"), F.coalesce("t.yaw", F.lit(0.0)).alias("heading"), F.col("u.x").alias("drone_x"), F.col("u.y").alias("drone_y"))
    r = policies.rollouts(specs)
    return r.groupBy("episode_id").agg(F.count(F.lit(1)).alias("steps"), F.countDistinct("behavior").alias("behaviors"), scaled(F.max("speed"), 2).alias("top_speed_e2"))


def _paths(spark, d):
    """A path through all frames of each episode that have a target position."""
    f = distinct_frames(table(spark, d, "frame_records")).where("target_x is not null and target_y is not null")
    ok = (F.abs("target_x") < 1e5) & (F.abs("target_y") < 1e5)
    return paths.smooth_routes(f.where(ok).select(F.col("episode_id").alias("route_id"), F.col("frame_idx").alias("ord"), F.col("target_x").alias("x"), F.col("target_y").alias("y")))


def smooth_routes(spark, d):
    """Length and speeds of each episode's path."""
    p = _paths(spark, d)
    return p.groupBy("route_id").agg(F.count(F.lit(1)).alias("samples"), scaled(F.max("s"), 1).alias("length_e1"), scaled(F.max("speed"), 2).alias("top_e2"), scaled(F.min("speed"), 2).alias("least_e2"))


def followed_routes(spark, d):
    """How long a follower takes for each episode's path, and how far it gets."""
    p = paths.followed(_paths(spark, d))
    return p.groupBy("route_id").agg(F.count(F.lit(1)).alias("ticks"), scaled(F.max("s"), 1).alias("length_e1"))


def difficulty_schedule(spark, d):
    """Round-robin order of a batch's episodes over its weighted levels; no weights mean medium throughout."""
    b = table(spark, d, "batch_configs").where("batch_id is not null").dropDuplicates(["batch_id"])
    weights = F.array_sort(F.filter(F.map_entries("difficulty_mix"), lambda e: e["value"] > 0))
    names = F.flatten(F.transform(weights, lambda e: F.array_repeat(e["key"], e["value"])))
    b = b.select("batch_id", "episodes", F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("medium"))).alias("names"))
    i = F.explode(F.when(F.col("episodes") > 0, F.sequence(F.lit(0), F.col("episodes") - 1))).alias("i")
    s = b.select("batch_id", "names", i).select("batch_id", F.element_at("names", F.pmod(F.col("i"), F.size("names")) + 1).alias("difficulty"))
    return s.groupBy("batch_id", "difficulty").agg(F.count(F.lit(1)).alias("episodes"))


def latest_report(spark, d):
    """The newest report of each batch and episode, by a two-step maximum rather than a sort."""
    r = table(spark, d, "demo_reports").where("batch_id is not null")
    best = r.groupBy("batch_id", "episode_id").agg(F.max(F.struct("reported_at", "report_id")).alias("m"))
    return best.select("batch_id", "episode_id", "m.report_id")


def distance_percentiles(spark, d):
    r = table(spark, d, "demo_reports").dropDuplicates(["report_id"])
    spread = r.groupBy("target_name").agg(F.count(F.lit(1)).alias("n"), scaled(F.stddev_pop("duration_s"), 3).alias("spread_e3"))
    middle = quantile(r, "target_name", "final_drone_target_distance_m", 0.5, "median").withColumnRenamed("target_name", "name")
    return spread.join(middle, F.col("target_name").eqNullSafe(F.col("name")), "left").select("target_name", "n", scaled(F.col("median"), 3).alias("median_e3"), "spread_e3")


def _stream(spark, d):
    schema = table(spark, d, "frame_records").schema
    return spark.readStream.schema(schema).parquet(f"{d}/frame_records.parquet*")


def _run(spark, df, mode):
    return live.drained(df, mode, f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/live-{uuid.uuid4().hex}")


def stream_window_counts(spark, d):
    return _run(spark, live.window_counts(_stream(spark, d)), "complete")


def stream_live_metrics(spark, d):
    """The last totals that the stream gave for each episode."""
    out = _run(spark, live.live_metrics(_stream(spark, d)), "update")
    last = out.groupBy("episode_id").agg(F.max_by(F.struct("frames", "visible", "collisions", "last_frame"), "batch").alias("r"))
    return last.select("episode_id", "r.*")


def stream_ticks(spark, d):
    """Ticks that a streaming file sink has taken in, each frame once, counted by episode."""
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/ticks-{uuid.uuid4().hex}"
    ticks = live.append_ticks(_stream(spark, d), path)
    return ticks.groupBy("episode_id").agg(F.count(F.lit(1)).alias("ticks"), F.max("frame_idx").alias("last_frame"))


QUERIES = {
    q.__name__: q
    for q in (export_types, frame_bundle, dataset_report, validate_episodes, validate_frames, validation_issues, batch_manifest, missing_exports, tracker_fsm, policy_rollout, smooth_routes, followed_routes, difficulty_schedule, latest_report, distance_percentiles, stream_window_counts, stream_live_metrics, stream_ticks)
}

_SPATIAL = "json_valid({0}) AND (TRY_CAST(coalesce(json_extract_string({0}, '$[0]'), json_extract_string({0}, '$.pos[0]'), json_extract_string({0}, '$.x')) AS DOUBLE) IS NOT NULL) AND (TRY_CAST(coalesce(json_extract_string({0}, '$[1]'), json_extract_string({0}, '$.pos[1]'), json_extract_string({0}, '$.y')) AS DOUBLE) IS NOT NULL) AND (TRY_CAST(coalesce(json_extract_string({0}, '$[2]'), json_extract_string({0}, '$.pos[2]'), json_extract_string({0}, '$.z')) AS DOUBLE) IS NOT NULL)"


def _case(checks: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN NOT coalesce({ok}, false) THEN '{m}'" for ok, m in checks) + " END"


_EPISODE = _case(
    [(f"{c} IS NOT NULL", f"{c} must not be null") for c in validation.EPISODE_FIELDS]
    + [("trim(episode_id) <> ''", "episode_id must not be empty"), ("max_steps >= 0", "max_steps must be >= 0")]
    + [(_SPATIAL.format(c), f"{c} is not a pose") for c in ("uav_initial_pose", "target_initial_pose")]
)
_FRAME = _case([(f"{c} IS NOT NULL", f"{c} must not be null") for c in validation.FRAME_FIELDS] + [("occlusion_risk IS NULL OR (NOT isnan(occlusion_risk) AND occlusion_risk BETWEEN 0 AND 1)", "occlusion_risk out of [0, 1]"), ("frame_idx >= 0", "frame_idx must be >= 0")])
_REPORT = f"""WITH ev AS (SELECT episode_id, {_EPISODE} AS issue FROM episodes), fv AS (SELECT episode_id, frame_idx, {_FRAME} AS issue FROM frame_records),
fc AS (SELECT episode_id, issue, count(*) AS n, min(frame_idx) AS f FROM fv WHERE issue IS NOT NULL AND episode_id IS NOT NULL GROUP BY 1, 2),
fi AS (SELECT episode_id, least(count(*), 3) + CAST(sum(n) > 3 AS INT) AS k FROM fc GROUP BY 1),
ei AS (SELECT episode_id, count(DISTINCT issue) AS k FROM ev WHERE issue IS NOT NULL AND episode_id IS NOT NULL GROUP BY 1),
p AS (SELECT coalesce(a.episode_id, b.episode_id) AS episode_id, coalesce(n, 0) AS frames, CAST(a.episode_id IS NULL AS INT) + CAST(b.episode_id IS NULL AS INT) AS k0
  FROM (SELECT DISTINCT episode_id FROM episodes WHERE episode_id IS NOT NULL) a FULL JOIN (SELECT episode_id, count(*) AS n FROM frame_records WHERE episode_id IS NOT NULL GROUP BY 1) b USING (episode_id)),
rp AS (SELECT p.episode_id, frames, CAST(k0 + coalesce(ei.k, 0) + coalesce(fi.k, 0) AS INT) AS issues FROM p LEFT JOIN ei USING (episode_id) LEFT JOIN fi USING (episode_id))
"""
_ONE = "r AS (SELECT * FROM demo_reports QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY reported_at) = 1)"

ORACLE_METRICS, ORACLE_STATS = tracking.ORACLE["episode_metrics"], texts.ORACLE["instruction_stats"]

ORACLE = {
    "validate_episodes": f"SELECT coalesce(issue, 'ok') AS outcome, count(*) AS n FROM (SELECT {_EPISODE} AS issue FROM episodes) GROUP BY 1",
    "validate_frames": f"SELECT * FROM (SELECT record_id, {_FRAME} AS issue FROM frame_records) WHERE issue IS NOT NULL",
    "validation_issues": _REPORT + "SELECT episode_id, frames, issues = 0 AS passed, issues FROM rp",
    "batch_manifest": _REPORT + "SELECT count(*) AS episodes, count(*) FILTER (issues = 0) AS passed, CAST(sum(frames) AS BIGINT) AS frames FROM rp",
    "missing_exports": """WITH x AS (SELECT DISTINCT json_extract_string(payload, '$.episode_id') AS episode_id, TRY_CAST(json_extract_string(payload, '$.frame_idx') AS INT) AS frame_idx FROM (SELECT payload FROM frame_exports WHERE json_valid(payload))),
      f AS (SELECT DISTINCT episode_id, frame_idx FROM frame_records WHERE episode_id IS NOT NULL)
      SELECT f.episode_id, count(*) AS missing FROM f LEFT JOIN x ON x.episode_id = f.episode_id AND x.frame_idx = f.frame_idx WHERE x.episode_id IS NULL GROUP BY 1""",
    "tracker_fsm": f"""WITH {FRAMES}, a AS (SELECT episode_id, frame_idx, timestamp_s AS ts, coalesce(target_visible, false) AS seen, coalesce(sqrt(vx * vx + vy * vy), 1.0) < 0.3 AS stopped, NOT coalesce(line_of_sight_clear, true) AS blocked FROM fr WHERE timestamp_s IS NOT NULL),
      b AS (SELECT *, CASE WHEN seen IS DISTINCT FROM lag(seen) OVER w THEN ts END AS s0, CASE WHEN stopped IS DISTINCT FROM lag(stopped) OVER w THEN ts END AS h0 FROM a WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx)),
      c AS (SELECT *, ts - last_value(s0 IGNORE NULLS) OVER w AS lost, ts - last_value(h0 IGNORE NULLS) OVER w AS still FROM b WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx))
      SELECT episode_id, frame_idx, CASE WHEN seen THEN CASE WHEN stopped AND still >= 4.0 THEN 'hold' ELSE 'track' END WHEN lost < 0.4 THEN 'predict' WHEN lost >= 0.8 AND lost < 3.0 AND blocked THEN 'peek' WHEN lost < 3.0 THEN 'reacquire' ELSE 'search' END AS mode FROM c""",
    "difficulty_schedule": """WITH b AS (SELECT batch_id, any_value(episodes) AS n, any_value(difficulty_mix) AS mix FROM batch_configs WHERE batch_id IS NOT NULL GROUP BY 1),
      w AS (SELECT batch_id, n, list_sort(list_filter(map_entries(mix), lambda x: x.value > 0)) AS e FROM b), l AS (SELECT batch_id, n, flatten(list_transform(e, lambda x: list_transform(range(x.value), lambda i: x.key))) AS names FROM w),
      m AS (SELECT batch_id, n, CASE WHEN len(names) > 0 THEN names ELSE ['medium'] END AS names FROM l), s AS (SELECT batch_id, names, unnest(range(n)) AS i FROM m)
      SELECT batch_id, names[i % len(names) + 1] AS difficulty, count(*) AS episodes FROM s GROUP BY 1, 2""",
    "latest_report": "SELECT batch_id, episode_id, report_id FROM (SELECT DISTINCT batch_id, episode_id, report_id, reported_at FROM demo_reports WHERE batch_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY batch_id, episode_id ORDER BY reported_at DESC NULLS LAST, report_id DESC NULLS LAST) = 1",
    "distance_percentiles": f"WITH {_ONE} SELECT target_name, count(*) AS n, CAST(floor(median(final_drone_target_distance_m) * 1e3 + 0.5) AS BIGINT) AS median_e3, CAST(floor(stddev_pop(duration_s) * 1e3 + 0.5) AS BIGINT) AS spread_e3 FROM r GROUP BY 1",
    "stream_window_counts": """SELECT time_bucket(INTERVAL 10 MINUTE, received_at) AS start, regexp_replace(lower(coalesce(tracker_mode, '')), '[^a-z]', '', 'g') AS mode, count(*) AS frames, count(*) FILTER (coalesce(target_visible, false)) AS visible
      FROM frame_records WHERE received_at IS NOT NULL GROUP BY 1, 2""",
    "stream_live_metrics": """SELECT episode_id, count(*) AS frames, count(*) FILTER (coalesce(visible, false)) AS visible, count(*) FILTER (coalesce(hit, false)) AS collisions, CAST(max(frame_idx) AS BIGINT) AS last_frame
      FROM (SELECT episode_id, frame_idx, any_value(target_visible) AS visible, any_value(collision) AS hit FROM frame_records WHERE episode_id IS NOT NULL AND frame_idx IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
    "export_types": """WITH o AS (SELECT raw_id, payload AS v FROM frame_exports WHERE json_valid(payload)) SELECT raw_id, coalesce(json_type(v, '$.frame_idx') IN ('BIGINT', 'UBIGINT'), false) AS whole_index, coalesce(json_type(v, '$.timestamp_s') IN ('BIGINT', 'UBIGINT', 'DOUBLE'), false) AS numeric_time FROM o WHERE json_type(v) = 'OBJECT'""",
    "frame_bundle": f"""WITH {FRAMES}, {EPISODES}, k AS (SELECT episode_id, CAST(sum(n) AS BIGINT) AS texts FROM (SELECT result_id, any_value(episode_id) AS episode_id, any_value(coalesce(len(kept), 0)) AS n FROM filter_results WHERE episode_id IS NOT NULL GROUP BY 1) GROUP BY 1),
      l AS (SELECT episode_id, success FROM demo_reports WHERE episode_id IS NOT NULL AND reported_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY reported_at DESC, report_id DESC, success DESC) = 1)
      SELECT fr.episode_id, frame_idx, difficulty_level, coalesce(texts, 0) AS texts, success, coalesce(in_camera_frustum, target_visible) AS in_frustum, coalesce(line_of_sight_clear, true) AS clear, {e('coalesce(occlusion_risk, -1.0)')} AS occlusion_risk_e4, {e('coalesce(drone_distance_m, -1.0)', 3)} AS drone_distance_m_e3
      FROM fr LEFT JOIN ep USING (episode_id) LEFT JOIN k USING (episode_id) LEFT JOIN l USING (episode_id)""",
    "dataset_report": f"""WITH m AS ({ORACLE_METRICS}), s AS ({ORACLE_STATS}) SELECT (SELECT count(*) FROM m) AS episodes, (SELECT count(DISTINCT difficulty_level) FROM m) AS levels, (SELECT {e('avg(visibility_ratio_e4 / 1e4)')} FROM m) AS visible_e4, (SELECT count(*) FILTER (tracking_success) FROM m) AS successes, results, instructions, rejected FROM s""",
    "stream_ticks": "SELECT episode_id, count(DISTINCT frame_idx) AS ticks, max(frame_idx) AS last_frame FROM frame_records WHERE episode_id IS NOT NULL AND frame_idx IS NOT NULL GROUP BY 1",
}
