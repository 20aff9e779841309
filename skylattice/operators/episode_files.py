"""Validation of episode folders on disk: files, metadata, frames, images, trajectories, instruction and metrics.

Every check is a DataFrame of (folder, issue, warning); the report is their union, aggregated by folder. Images are checked
by an anti join of recorded paths against the listing. Files are read in bulk, not folder by folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators.text import violations
from skylattice.operators.validation import EPISODE_FIELDS, LISTED

# Files a folder must and should have, and keys its metrics must have.
REQUIRED = ("metadata.json", "frames.jsonl", "trajectories.json", "instruction.json", "metrics.json")
RECOMMENDED = ("visibility.json", "config.yaml")
METRICS = ("tracking_success", "target_visibility_ratio", "line_of_sight_continuity", "target_lost_ratio", "re_acquisition_time_frames", "collision_rate", "path_length_m")
FRAME_FIELDS = ("frame_id", "image_path", "step_index", "timestamp", "uav_pose", "target_pose", "target_velocity", "target_visible", "distance_to_target", "relative_bearing", "collision")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, folder, name of all files below that hold at least a byte; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))


def kind(record: Column, name: str) -> Column:
    """OBJECT, ARRAY, BIGINT, BOOLEAN ... of a field; null if it is missing or null."""
    k = F.regexp_extract(F.schema_of_variant(F.try_variant_get(record, f"$.{name}", "variant")), "^[A-Z]+", 0)
    return F.when(~k.isin("", "VOID"), k)


def is_number(record: Column, name: str) -> Column:
    """A number and not a truth value."""
    return F.coalesce(kind(record, name).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT"), F.lit(False))


def is_whole(record: Column, name: str) -> Column:
    return F.coalesce(kind(record, name).isin("BIGINT", "INT"), F.lit(False))


def frame_issue(record: Column) -> Column:
    """Why a frame record is invalid, null if it isn't: a field is missing, of a wrong type, or out of range."""
    out = F.lit(None).cast("string")
    checks = [(kind(record, n).isNotNull(), f"{n} is missing") for n in FRAME_FIELDS]
    checks += [(is_whole(record, n), f"{n} must be an integer") for n in ("frame_id", "step_index")]
    checks += [(is_number(record, n), f"{n} must be a number") for n in ("timestamp", "distance_to_target", "relative_bearing")]
    checks += [(F.coalesce(kind(record, n) == "BOOLEAN", F.lit(False)), f"{n} must be true or false") for n in ("target_visible", "collision")]
    checks += [(F.coalesce(F.trim(F.try_variant_get(record, "$.image_path", "string")) != "", F.lit(False)), "image_path is empty")]
    for n in ("visibility_score", "occlusion_risk"):
        v = F.try_variant_get(record, f"$.{n}", "double")
        checks.append((kind(record, n).isNull() | F.coalesce(v.between(0.0, 1.0), F.lit(False)), f"{n} out of [0, 1]"))
    for ok, message in reversed(checks):
        out = F.when(~ok, F.lit(message)).otherwise(out)
    return out


def folder_report(spark: SparkSession, path: str) -> DataFrame:
    """folder, passed, issues, warnings (sorted arrays), frames, images, visibility_ratio, success, difficulty of every
    folder that has any of the required files.

    Broken files are issues of their folder and never stop the report; a file without a byte counts as missing. At most LISTED invalid frames are named, more are
    summed up. A path without files gives no rows."""
    files = listing(spark, path)
    named = files.where(F.col("name").isin(*REQUIRED, *RECOMMENDED)).groupBy("folder").agg(F.collect_set("name").alias("names"))
    folders = named.where(F.arrays_overlap("names", F.array(*[F.lit(n) for n in REQUIRED])))
    missing = lambda names, text: F.filter(F.array(*[F.when(~F.array_contains("names", n), F.lit(f"{text}: {n}")) for n in names]), lambda x: x.isNotNull())
    found = [folders.select("folder", F.explode(missing(REQUIRED, "missing required file")).alias("issue"), F.lit(None).cast("string").alias("warning"))]
    found.append(folders.select("folder", F.lit(None).cast("string").alias("issue"), F.explode(missing(RECOMMENDED, "missing recommended file")).alias("warning")))

    def whole(name: str) -> DataFrame:
        raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).option("wholetext", "true").text(path)
        return raw.select(F.regexp_extract("_metadata.file_path", r"^(?:file:)?/*(.*)/[^/]*$", 1).alias("short"), F.try_parse_json("value").alias("r"))

    short = F.regexp_extract("folder", r"^(?:file:)?/*(.*)$", 1)
    at = lambda df: df.join(folders.select("folder", short.alias("short")), "short").drop("short")
    add = lambda df, issue, warning=None: found.append(df.select("folder", F.explode(F.filter(F.array(issue), lambda x: x.isNotNull())).alias("issue"), F.lit(None).cast("string").alias("warning")) if warning is None else df.select("folder", F.lit(None).cast("string").alias("issue"), warning.alias("warning")).where("warning is not null"))
    get = lambda n, t: F.try_variant_get("r", f"$.{n}", t)
    r = F.col("r")

    meta = at(whole("metadata.json"))
    first = F.lit(None).cast("string")
    for n in reversed(EPISODE_FIELDS):
        first = F.when(kind(r, n).isNull(), F.lit(f"metadata invalid: {n} is missing")).otherwise(first)
    add(meta, F.when(r.isNull(), "metadata unreadable").otherwise(first))

    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "frames.jsonl").text(path).select(F.regexp_extract("_metadata.file_path", r"^(?:file:)?/*(.*)/[^/]*$", 1).alias("short"), F.trim("value").alias("line")).where("line <> ''")
    frames = at(lines.select("short", F.try_parse_json("line").alias("r"))).withColumn("bad", frame_issue(r))
    counts = frames.groupBy("folder").agg(F.count(F.lit(1)).alias("frames"), F.count_if(r.isNull()).alias("broken"), F.count_if(r.isNotNull() & F.col("bad").isNotNull()).alias("invalid"), F.slice(F.array_sort(F.collect_set(F.when(r.isNotNull(), F.col("bad")))), 1, LISTED).alias("first"))
    has_frames = folders.where(F.array_contains("names", "frames.jsonl")).join(counts, "folder", "left")
    add(has_frames, F.when(F.col("frames").isNull(), "frames.jsonl is empty"))
    add(has_frames, F.when(F.col("broken") > 0, F.concat(F.lit("frames.jsonl unreadable: "), F.col("broken").cast("string"), F.lit(" lines"))))
    found.append(has_frames.select("folder", F.explode("first").alias("f")).select("folder", F.concat(F.lit("frame invalid: "), "f").alias("issue"), F.lit(None).cast("string").alias("warning")))
    add(has_frames, F.when(F.col("invalid") > LISTED, F.concat(F.lit("... "), F.col("invalid").cast("string"), F.lit(" frames failed field validation"))))

    images = frames.where(r.isNotNull()).select("folder", F.try_variant_get("r", "$.image_path", "string").alias("image"))
    images = images.withColumn("file", F.when(F.col("image").startswith("/"), F.regexp_extract("image", r"^/*(.*)$", 1)).otherwise(F.concat_ws("/", F.regexp_extract("folder", r"^(?:file:)?/*(.*)$", 1), "image")))
    there = files.select(F.regexp_extract("path", r"^(?:file:)?/*(.*)$", 1).alias("file"))
    gone = images.join(there, "file", "left_anti").groupBy("folder").agg(F.count(F.lit(1)).alias("gone"))
    add(gone.join(counts, "folder"), F.concat(F.col("gone").cast("string"), F.lit("/"), F.col("frames").cast("string"), F.lit(" recorded image paths do not exist")))
    pictures = files.where(F.col("path").rlike(r"/images/[^/]*\.png$")).groupBy(F.regexp_extract("folder", r"^(.*)/images$", 1).alias("folder")).agg(F.count(F.lit(1)).alias("images"))

    empty = lambda n: kind(r, n).isNull() | (F.to_json(F.try_variant_get("r", f"$.{n}", "variant")) == "[]")
    ways = at(whole("trajectories.json"))
    add(ways, F.when(r.isNull(), "trajectories.json unreadable"))
    for n in ("target_trajectory", "uav_trajectory"):
        add(ways, F.when(r.isNotNull() & empty(n), f"trajectories.json: missing/empty {n}"))
    add(ways, None, F.when(r.isNotNull() & empty("expert_viewpoints"), F.lit("trajectories.json: no expert_viewpoints")))

    told = at(whole("instruction.json")).withColumn("t", F.trim(F.coalesce(get("instruction", "string"), F.lit(""))))
    add(told, F.when(r.isNull(), "instruction.json unreadable").when(F.col("t") == "", "instruction.json: empty instruction"))
    add(told, None, F.when(F.size(violations("t")) > 0, F.concat(F.lit("instruction violates a rule: "), F.try_element_at(violations("t"), F.lit(1)))))

    scores = at(whole("metrics.json"))
    add(scores, F.when(r.isNull(), "metrics.json unreadable"))
    for n in METRICS:
        add(scores, F.when(r.isNotNull() & kind(r, n).isNull(), f"metrics.json missing key: {n}"))
    add(scores, F.when(r.isNotNull() & ~F.coalesce(is_number(r, "target_visibility_ratio") & get("target_visibility_ratio", "double").between(0.0, 1.0), F.lit(False)), "target_visibility_ratio out of [0,1]"))

    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    listed = every.groupBy("folder").agg(F.array_sort(F.collect_set("issue")).alias("issues"), F.array_sort(F.collect_set("warning")).alias("warnings"))
    facts = scores.groupBy("folder").agg(F.max(get("target_visibility_ratio", "double")).alias("visibility_ratio"), F.max(get("tracking_success", "boolean")).alias("success"))
    levels = meta.groupBy("folder").agg(F.max(get("difficulty_level", "string")).alias("difficulty"))
    out = folders.select("folder").join(listed, "folder", "left").join(counts.select("folder", "frames"), "folder", "left").join(pictures, "folder", "left").join(facts, "folder", "left").join(levels, "folder", "left")
    none = F.array().cast("array<string>")
    issues = F.coalesce("issues", none)
    return out.select("folder", (F.size(issues) == 0).alias("passed"), issues.alias("issues"), F.coalesce("warnings", none).alias("warnings"), F.coalesce("frames", F.lit(0)).alias("frames"), F.coalesce("images", F.lit(0)).alias("images"), "visibility_ratio", "success", "difficulty")


def seed_logged(spark: SparkSession, path: str) -> DataFrame:
    """folder, seed, logged: whether a folder's configuration names the seed that its metadata has; null without a seed."""
    text = lambda name: spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).option("wholetext", "true").text(path).select(F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]*$", 1).alias("folder"), "value")
    seeds = text("metadata.json").select("folder", F.try_variant_get(F.try_parse_json("value"), "$.random_seed", "bigint").alias("seed"))
    both = seeds.join(text("config.yaml").withColumnRenamed("value", "config"), "folder", "left")
    return both.select("folder", "seed", F.when(F.col("seed").isNotNull(), F.coalesce(F.col("config").contains(F.col("seed").cast("string")), F.lit(False))).alias("logged"))
