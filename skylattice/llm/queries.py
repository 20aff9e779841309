"""Queries of the training-data operators, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.llm import encoding, leakage, mixing, neardup, runs, sampling
from skylattice.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = runs.tracker_runs(table(spark, d, "frame_records")).where("frames >= 2")
    return found.select("episode_id", "first_frame_idx", "last_frame_idx")


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every run, single frames too, with its count and duration (rounded to a microsecond)."""
    return runs.tracker_runs(table(spark, d, "frame_records")).withColumn("duration_s", F.expr("cast(floor(duration_s * 1e6 + 0.5) as bigint)").alias("duration_s"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return neardup.instruction_records(table(spark, d, "episodes"), table(spark, d, "filter_results"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(_records(spark, d))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return neardup.record_classes(_records(spark, d))


def _sampled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return sampling.difficulty_sample(table(spark, d, "batch_configs"), table(spark, d, "demo_reports"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[1].where("deficit > 0").select("batch_id", "difficulty")


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[0]


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[1]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_passages(spark, d).select("doc_id", "item_id")


def p6_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    return leakage.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1].where("falls_short").select("source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_restored(spark, d).select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.restored_documents(table(spark, d, "documents"))


def queries() -> dict[str, Query]:
    found = (p1_found, p1_runs, p2_found, p2_classes, p3_found, p3_sample, p3_report, p6_found, p6_passages, p6_clean, p7_found, p7_shares, p7_mix, p8_found, p8_restored)
    return {q.__name__: q for q in found}


RUNS = """
WITH f AS (
  SELECT episode_id, frame_idx, min(regexp_replace(lower(coalesce(tracker_mode, '')), '[^a-z]', '', 'g')) AS mode,
         min(target_visible) AS vis, min(timestamp_s) AS ts
  FROM frame_records WHERE episode_id IS NOT NULL AND frame_idx IS NOT NULL GROUP BY ALL),
g AS (
  SELECT *, CASE WHEN mode = lag(mode) OVER w AND vis IS NOT DISTINCT FROM lag(vis) OVER w AND ts - lag(ts) OVER w <= 1.0 THEN 0 ELSE 1 END AS s
  FROM f WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx)),
h AS (SELECT *, sum(s) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS run FROM g),
r AS (
  SELECT episode_id, min(frame_idx) AS first_frame_idx, max(frame_idx) AS last_frame_idx, count(*) AS frames,
         CAST(floor((arg_max(ts, frame_idx) - arg_min(ts, frame_idx)) * 1e6 + 0.5) AS BIGINT) AS duration_s,
         min(mode) AS tracker_mode, min(vis) AS target_visible
  FROM h GROUP BY episode_id, run)
"""

RECORDS = r"""
WITH k AS (SELECT result_id, any_value(kept) AS kept FROM filter_results WHERE result_id IS NOT NULL GROUP BY 1),
u AS (SELECT result_id, unnest(kept) AS text, unnest(range(len(kept))) AS pos FROM k),
r AS (
  SELECT 'e:' || episode_id AS key, min(instruction) AS text FROM episodes WHERE instruction IS NOT NULL AND episode_id IS NOT NULL GROUP BY 1
  UNION ALL SELECT 'k:' || result_id || ':' || pos, text FROM u WHERE text IS NOT NULL),
s AS (SELECT key, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS words FROM r),
p AS (
  SELECT x.key AS rec_a, y.key AS rec_b, len(list_intersect(x.words, y.words)) AS common, len(x.words) + len(y.words) AS both_
  FROM s x JOIN s y ON x.key < y.key AND len(x.words) > 0 AND 10 * least(len(x.words), len(y.words)) >= 7 * greatest(len(x.words), len(y.words)))
"""

LEVELS = """
WITH b AS (SELECT batch_id, any_value(episodes) AS episodes, any_value(min_per_difficulty) AS least, any_value(difficulty_mix) AS mix FROM batch_configs GROUP BY 1),
e AS (SELECT batch_id, coalesce(episodes, 0) AS episodes, coalesce(least, 0) AS least, unnest(map_entries(mix)) AS e FROM b),
w AS (SELECT batch_id, episodes, least, e.key AS difficulty, greatest(coalesce(e.value, 0), 0) AS w FROM e),
t AS (SELECT *, sum(w) OVER (PARTITION BY batch_id) AS total FROM w),
want AS (SELECT batch_id, difficulty, CAST(greatest(least, (episodes * w) // total) AS BIGINT) AS wanted FROM t WHERE w > 0),
use AS (SELECT batch_id, lower(trim(difficulty, ' ' || chr(9) || chr(10) || chr(13))) AS difficulty, count(DISTINCT report_id) AS n FROM demo_reports WHERE success GROUP BY ALL),
report AS (
  SELECT batch_id, difficulty, wanted, coalesce(n, 0) AS observed, least(wanted, coalesce(n, 0)) AS sampled, wanted - least(wanted, coalesce(n, 0)) AS deficit
  FROM want LEFT JOIN use USING (batch_id, difficulty))
"""

#: Counted in words and single other characters, a tokenizer of its own.
SHARES = r"""
WITH t AS (SELECT lower(trim(source, ' ' || chr(9) || chr(10) || chr(13))) AS s, len(regexp_extract_all(coalesce(text, ''), '[\pL\pN]+|[^\s\pL\pN]')) AS n FROM documents),
o AS (SELECT s, sum(n) AS n FROM t WHERE s <> '' GROUP BY 1)
SELECT source FROM source_targets LEFT JOIN o ON o.s = lower(trim(source, ' ' || chr(9) || chr(10) || chr(13)))
WHERE target_weight * (SELECT sum(n) FROM o) > max_repeats * coalesce(o.n, 0)
"""

GRAMS = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, pos, pos + 11), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS pos FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, pos, pos + 11), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS pos FROM i)),
leak AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))
"""


#: Longest runs of shared windows of twelve words, along which both places grow by one.
PASSAGES = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items),
dg AS (SELECT doc_id, pos - 1 AS a, array_to_string(list_slice(w, pos, pos + 11), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS pos FROM d)),
ig AS (SELECT item_id, pos - 1 AS b, array_to_string(list_slice(w, pos, pos + 11), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS pos FROM i)),
m AS (SELECT doc_id, item_id, a, b FROM dg JOIN ig USING (g)),
n AS (SELECT *, a - row_number() OVER (PARTITION BY doc_id, item_id, a - b ORDER BY a) AS run FROM m),
r AS (SELECT doc_id, item_id, count(*) + 11 AS n, min(a) AS a, min(b) AS b FROM n GROUP BY doc_id, item_id, a - b, run)
SELECT doc_id, item_id, CAST(n AS INT) AS match_words, CAST(a AS INT) AS doc_word, CAST(b AS INT) AS item_word FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, a, b) = 1
"""
CLASSES = r"""
WITH k AS (SELECT result_id, any_value(kept) AS kept FROM filter_results WHERE result_id IS NOT NULL GROUP BY 1),
u AS (SELECT result_id, unnest(kept) AS text, unnest(range(len(kept))) AS pos FROM k),
r AS (
  SELECT 'e:' || episode_id AS key, min(instruction) AS text FROM episodes WHERE instruction IS NOT NULL AND episode_id IS NOT NULL GROUP BY 1
  UNION ALL SELECT 'k:' || result_id || ':' || pos, text FROM u WHERE text IS NOT NULL),
s AS (SELECT key, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS words FROM r),
c AS (SELECT md5(array_to_string(words, ' ')) AS class_id, any_value(words) AS words, count(*) AS copies FROM s WHERE len(words) > 0 GROUP BY 1),
p AS (SELECT x.class_id AS a, count(*) AS links FROM c x JOIN c y ON x.class_id <> y.class_id AND 10 * least(len(x.words), len(y.words)) >= 7 * greatest(len(x.words), len(y.words))
      WHERE 10 * len(list_intersect(x.words, y.words)) >= 7 * (len(x.words) + len(y.words) - len(list_intersect(x.words, y.words))) GROUP BY 1)
SELECT key, class_id, copies, coalesce(links, 0) AS links FROM s JOIN c ON class_id = md5(array_to_string(s.words, ' ')) LEFT JOIN p ON a = class_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_classes": CLASSES,
        "p6_passages": PASSAGES,
        "p1_found": RUNS + "SELECT episode_id, first_frame_idx, last_frame_idx FROM r WHERE frames >= 2",
        "p1_runs": RUNS + "SELECT * FROM r",
        "p2_found": RECORDS + "SELECT rec_a, rec_b FROM p WHERE 10 * common >= 7 * (both_ - common)",
        "p3_found": LEVELS + "SELECT batch_id, difficulty FROM report WHERE deficit > 0",
        "p3_report": LEVELS + "SELECT * FROM report",
        "p7_found": SHARES,
        "p6_found": GRAMS + "SELECT doc_id, item_id FROM leak",
        "p6_clean": GRAMS + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM leak)",
    }
