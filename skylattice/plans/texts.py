"""Queries over instruction and document texts, and SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators import text
from skylattice.operators.metrics import distinct_episodes, scaled
from skylattice.session import table


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "source", "title").where("text is not null")


def _results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filter_results").dropDuplicates(["result_id"])


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Kept texts in order: group (episode), ord, text."""
    return _results(spark, d).select("episode_id", "result_id", F.posexplode("kept").alias("pos", "text")).where("text is not null")


def blacklist_hits(spark, d):
    """Violations of rejected and kept texts: result_id, kind, pos."""
    each = lambda c, t: _results(spark, d).select("result_id", F.lit(c).alias("kind"), F.posexplode(c).alias("pos", "e")).select("result_id", "kind", "pos", t.alias("text"))
    rows = each("rejected", F.col("e.text")).unionByName(each("kept", F.col("e"))).where("text is not null")
    # the SQL side knows ASCII word boundaries only, so both sides look at a text in which other letters are blanks
    hits = rows.select("result_id", "kind", "pos", text.violations(F.regexp_replace("text", r"[^\x00-\x7F]", "_")).alias("hits"))
    return hits.where(F.size("hits") > 0).select("result_id", "kind", "pos", F.concat_ws("|", "hits").alias("hits"), F.element_at("hits", 1).alias("reason"))


def word_gate(spark, d):
    return _documents(spark, d).select("doc_id", text.word_count(F.col("text")).alias("words"), text.word_count(F.col("text")).between(text.FEWEST, text.MOST).alias("passes"), F.length(text.collapsed("text")).alias("collapsed_length"))


def token_jaccard(spark, d):
    """Similarity of each document to its title."""
    return _documents(spark, d).where("title is not null").select("doc_id", F.size(text.token_set("text")).alias("tokens"), scaled(text.jaccard(text.token_set("text"), text.token_set("title"))).alias("jaccard_e4"))


def ordered_quality_filter(spark, d):
    c = _candidates(spark, d).select("episode_id", F.concat_ws(":", F.lpad(F.col("result_id").cast("string"), 12, "0"), F.lpad(F.col("pos").cast("string"), 4, "0")).alias("ord"), "text")
    return text.ordered_filter(c, "episode_id", "ord", "text")


def filter_against_existing(spark, d):
    """Kept texts of each scene, in order, against the instructions its episodes already have."""
    ep = distinct_episodes(table(spark, d, "episodes")).select("episode_id", F.coalesce("scene_id", F.lit("?")).alias("scene"), "instruction")
    c = _candidates(spark, d).join(ep.select("episode_id", "scene"), "episode_id").select("scene", F.concat_ws(":", F.lpad(F.col("result_id").cast("string"), 12, "0"), F.lpad(F.col("pos").cast("string"), 4, "0")).alias("ord"), "text")
    return text.ordered_filter(c, "scene", "ord", "text", ep.select("scene", F.col("instruction").alias("text")))


def attribute_extract(spark, d):
    a = text.attributes("text")
    return _documents(spark, d).select("doc_id", a["color"].alias("color"), a["size"].alias("size"), a["type"].alias("type"))


def appearance_phrase(spark, d):
    e = distinct_episodes(table(spark, d, "episodes"))
    a = text.attributes(F.coalesce("instruction", F.lit("")))
    return e.select("episode_id", text.appearance_phrase(F.coalesce("target_class", F.lit("")), a).alias("phrase"))


def instruction_stats(spark, d):
    return text.instruction_stats(_results(spark, d))


def generated_instructions(spark, d):
    e = distinct_episodes(table(spark, d, "episodes"))
    a = text.attributes(F.coalesce("instruction", F.lit("")))
    rows = e.select(
        "episode_id", F.col("random_seed").alias("seed"), F.col("target_behavior_type").alias("behavior"),
        text.appearance_phrase(F.coalesce("target_class", F.lit("")), a).alias("appearance"),
        F.get_json_object("environment_summary", "$.location").alias("location"), F.get_json_object("environment_summary", "$.weather").alias("motion"), F.get_json_object("occluder_summary", "$.kinds[0]").alias("occlusion"),
    )
    return text.instruction(rows)


def rejected_reasons(spark, d):
    r = _results(spark, d).select(F.explode("rejected").alias("r")).select(F.split("r.reason", ":")[0].alias("gate"))
    return r.groupBy("gate").agg(F.count(F.lit(1)).alias("n"))


def clean_labels(spark, d):
    """Target names of reports without blank and unknown values, with the noun each would be called by."""
    r = table(spark, d, "demo_reports").dropDuplicates(["report_id"])
    m = text.cleaned(F.create_map(F.lit("name"), F.col("target_name"), F.lit("label"), F.col("target_label")))
    return r.select("report_id", F.try_element_at(m, F.lit("name")).alias("name"), F.try_element_at(m, F.lit("label")).alias("label"))


def report_category(spark, d):
    rules = (("truck", "truck|lorry|tanker"), ("bus", "bus|coach|tram"), ("car", "car|sedan|coupe|hatchback"))
    r = table(spark, d, "demo_reports").dropDuplicates(["report_id"])
    return r.groupBy(text.asset_category("target_name", rules).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def pose_codec(spark, d):
    """Poses written as six fixed decimals and read back: the text and the sum of what is read."""
    f = table(spark, d, "frame_records").where("drone_pose_world is not null and record_id is not null")
    p = F.col("drone_pose_world")
    wire = f.select("record_id", text.encode_pose(p["x"], p["y"], p["z"], F.lit(0.0), F.lit(0.0), F.coalesce(p["yaw"], F.lit(0.0))).alias("wire"))
    total = F.aggregate(text.decode_pose("wire"), F.lit(0.0), lambda a, x: a + x)
    return wire.select("record_id", F.size(text.decode_pose("wire")).alias("n"), scaled(total, 3).alias("total_e3"))


QUERIES = {
    q.__name__: q
    for q in (blacklist_hits, word_gate, token_jaccard, ordered_quality_filter, filter_against_existing, attribute_extract, appearance_phrase, instruction_stats, generated_instructions, rejected_reasons, clean_labels, report_category, pose_codec)
}


_ONE_RESULT = "r AS (SELECT * FROM filter_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY created_at) = 1)"


def _hits_sql() -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches(t, '\\b{p}\\b') THEN '{rule}:{p}' END" for rule, ps in text.RULES for p in ps)
    return f"""WITH {_ONE_RESULT}, x AS (
        SELECT result_id, 'rejected' AS kind, unnest(range(len(rejected))) AS pos, unnest(rejected).text AS text FROM r
        UNION ALL SELECT result_id, 'kept', unnest(range(len(kept))), unnest(kept) FROM r),
      f AS (SELECT result_id, kind, CAST(pos AS INT) AS pos, lower(regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g')) AS t FROM x WHERE text IS NOT NULL),
      h AS (SELECT result_id, kind, pos, list_filter([{cases}], lambda x: x IS NOT NULL) AS hits FROM f)
      SELECT result_id, kind, pos, array_to_string(hits, '|') AS hits, hits[1] AS reason FROM h WHERE len(hits) > 0"""


def _first(words: str, kinds: tuple[str, ...]) -> str:
    return f"list_filter({words}, lambda x: x IN ({', '.join(repr(k) for k in kinds)}))[1]"


def _list(values: tuple[str, ...]) -> str:
    return ", ".join(repr(v) for v in values)


_ONE_REPORT = "r AS (SELECT * FROM demo_reports QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY reported_at) = 1)"
_LAST = "ep AS (SELECT * FROM episodes WHERE episode_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY received_at DESC) = 1)"
_WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
_LOW = "list_transform(regexp_extract_all({}, '[A-Za-z]+'), lambda x: lower(x))"
_TOK = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"



def _filter_sql(group: str, candidates: str, known: str) -> str:
    """The walk itself: each group's texts that pass the gates, one after another, against the list of accepted token sets.
    candidates: c0(g, ord, text); known: k0(g, text), accepted beforehand."""
    cases = ", ".join(f"CASE WHEN regexp_matches(low, '\\b{p}\\b') THEN '{rule}:{p}' END" for rule, ps in text.RULES for p in ps)
    return f"""WITH RECURSIVE {_ONE_RESULT}, {_LAST}, {candidates}, {known},
      c1 AS (SELECT g, ord, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean_text FROM c0 WHERE text IS NOT NULL),
      c2 AS (SELECT *, len(list_filter(regexp_split_to_array(clean_text, '\\s+'), lambda x: x <> '')) AS n, lower(regexp_replace(clean_text, '[^\\x00-\\x7F]', '_', 'g')) AS low, {_TOK.format('clean_text')} AS w FROM c1),
      c3 AS (SELECT *, list_filter([{cases}], lambda x: x IS NOT NULL)[1] AS hit FROM c2), c4 AS (SELECT g, ord, clean_text, w, CASE WHEN n < 5 OR n > 30 THEN 'length:' || n WHEN hit IS NOT NULL THEN 'blacklist:' || hit END AS gate FROM c3),
      p AS (SELECT g, ord, w, row_number() OVER (PARTITION BY g ORDER BY ord) AS rn FROM c4 WHERE gate IS NULL), k1 AS (SELECT g, list({_TOK.format("text")}) AS acc FROM k0 WHERE text IS NOT NULL GROUP BY 1),
      fd AS (SELECT q.g, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS ord, coalesce(acc, CAST([] AS VARCHAR[][])) AS acc, false AS dup FROM (SELECT DISTINCT g FROM p) q LEFT JOIN k1 ON k1.g IS NOT DISTINCT FROM q.g
        UNION ALL SELECT g, rn, ord, CASE WHEN dup OR len(w) = 0 THEN acc ELSE list_append(acc, w) END, dup FROM (
          SELECT p.g, p.rn, p.ord, p.w, r.acc, len(p.w) > 0 AND len(list_filter(r.acc, lambda s: len(s) > 0 AND len(list_intersect(s, p.w)) >= 0.85 * (len(s) + len(p.w) - len(list_intersect(s, p.w))) - 1e-12)) > 0 AS dup FROM fd r JOIN p ON p.g IS NOT DISTINCT FROM r.g AND p.rn = r.rn + 1))
      SELECT c4.g AS {group}, c4.ord, clean_text, coalesce(gate, CASE WHEN dup THEN 'duplicate' END) AS reason FROM c4 LEFT JOIN fd r ON r.g IS NOT DISTINCT FROM c4.g AND r.ord = c4.ord"""


_KEPT = "SELECT episode_id, lpad(CAST(result_id AS VARCHAR), 12, '0') || ':' || lpad(CAST(pos AS VARCHAR), 4, '0') AS ord, text FROM (SELECT episode_id, result_id, unnest(kept) AS text, unnest(range(len(kept))) AS pos FROM r)"

ORACLE = {
    "ordered_quality_filter": _filter_sql("episode_id", f"c0 AS (SELECT episode_id AS g, ord, text FROM ({_KEPT}))", "k0 AS (SELECT '' AS g, '' AS text WHERE false)"),
    "filter_against_existing": _filter_sql("scene", f"c0 AS (SELECT coalesce(scene_id, '?') AS g, ord, text FROM ({_KEPT}) JOIN ep USING (episode_id))", "k0 AS (SELECT coalesce(scene_id, '?') AS g, instruction AS text FROM ep)"),
    "blacklist_hits": _hits_sql(),
    "word_gate": f"SELECT doc_id, len({_WORDS}) AS words, len({_WORDS}) BETWEEN 5 AND 30 AS passes, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS collapsed_length FROM documents WHERE text IS NOT NULL",
    "token_jaccard": f"""WITH t AS (SELECT doc_id, {_TOK.format('text')} AS a, {_TOK.format('title')} AS b FROM documents WHERE text IS NOT NULL AND title IS NOT NULL), j AS (SELECT *, len(list_intersect(a, b)) AS c FROM t)
      SELECT doc_id, len(a) AS tokens, CAST(floor(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE c / (len(a) + len(b) - c) END * 1e4 + 0.5) AS BIGINT) AS jaccard_e4 FROM j""",
    "attribute_extract": f"WITH w AS (SELECT doc_id, {_LOW.format('text')} AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, {_first('w', text.COLORS)} AS color, {_first('w', text.SIZES)} AS size, {_first('w', text.TYPES)} AS type FROM w",
    "appearance_phrase": f"""WITH {_LAST}, w AS (SELECT episode_id, {_LOW.format("coalesce(instruction, '')")} AS w, regexp_extract_all(list_extract(string_split(trim(coalesce(target_class, '')), '.'), -1), '[A-Za-z]+') AS c FROM ep)
      SELECT episode_id, concat_ws(' ', 'the', {_first('w', text.SIZES)}, {_first('w', text.COLORS)}, coalesce({_first('w', text.TYPES)}, lower(c[-1]), 'vehicle')) AS phrase FROM w""",
    "instruction_stats": f"""WITH {_ONE_RESULT} SELECT count(*) AS results, CAST(coalesce(sum(len(kept)), 0) AS BIGINT) AS instructions, CAST(coalesce(sum(len(rejected)), 0) AS BIGINT) AS rejected,
      CAST(coalesce(sum(len(list_filter(rejected, lambda x: starts_with(x.reason, 'blacklist')))), 0) AS BIGINT) AS blacklist_rejected,
      CAST(coalesce(sum(list_sum(list_transform(kept, lambda t: len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> ''))))), 0) AS BIGINT) AS words FROM r""",
    "rejected_reasons": f"WITH {_ONE_RESULT} SELECT string_split(x.reason, ':')[1] AS gate, count(*) AS n FROM (SELECT unnest(rejected) AS x FROM r) GROUP BY 1",
    "clean_labels": f"""WITH {_ONE_REPORT} SELECT report_id, CASE WHEN trim(target_name) <> '' AND lower(trim(target_name)) NOT IN ({_list(text.EMPTY_VALUES)}) THEN trim(target_name) END AS name,
      CASE WHEN trim(target_label) <> '' AND lower(trim(target_label)) NOT IN ({_list(text.EMPTY_VALUES)}) THEN trim(target_label) END AS label FROM r""",
    "report_category": f"WITH {_ONE_REPORT} SELECT CASE WHEN regexp_matches(lower(target_name), 'truck|lorry|tanker') THEN 'truck' WHEN regexp_matches(lower(target_name), 'bus|coach|tram') THEN 'bus' WHEN regexp_matches(lower(target_name), 'car|sedan|coupe|hatchback') THEN 'car' ELSE 'other' END AS category, count(*) AS n FROM r GROUP BY 1",
    "pose_codec": """WITH f AS (SELECT record_id, printf('%.6f %.6f %.6f %.6f %.6f %.6f', drone_pose_world.x, drone_pose_world.y, drone_pose_world.z, 0.0, 0.0, coalesce(drone_pose_world.yaw, 0.0)) AS wire FROM frame_records WHERE drone_pose_world IS NOT NULL AND record_id IS NOT NULL),
      g AS (SELECT record_id, list_transform(string_split(wire, ' '), lambda x: CAST(x AS DOUBLE)) AS v FROM f)
      SELECT record_id, CAST(len(v) AS INT) AS n, CAST(floor((v[1] + v[2] + v[3] + v[4] + v[5] + v[6]) * 1e3 + 0.5) AS BIGINT) AS total_e3 FROM g""",
}
