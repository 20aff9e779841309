"""File sources and sinks: lenient and strict JSON lines, episode folders, landmarks, scout files, frames and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators.episode_files import listing
from skylattice.operators.text import building_coordinates


def _lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    raw = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line")).where("line <> ''")


def jsonl_lenient(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """file, record (variant) of every line that is JSON; NaN and Infinity count as null, blank and broken lines are
    skipped. A type that doesn't fit a field loses that field only, not the line."""
    tame = F.regexp_replace("line", r"(?<=[:\[,])\s*(NaN|-?Infinity)(?=\s*[,}\]])", "null")
    parsed = _lines(spark, path, glob).select("file", F.try_parse_json(tame).alias("record"))
    return parsed.where("record is not null")


def jsonl_strict(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """file, lines, broken, ok: a file with a broken line is not ok."""
    parsed = _lines(spark, path, glob).select("file", F.try_parse_json("line").isNull().alias("bad"))
    return parsed.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count_if("bad").alias("broken")).withColumn("ok", F.col("broken") == 0)


def json_documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """file, record (variant) of whole-file JSON documents; unreadable ones are empty objects."""
    raw = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("wholetext", "true").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.coalesce(F.try_parse_json("value"), F.parse_json(F.lit("{}"))).alias("record"))


def episode_folders(spark: SparkSession, path: str, required: tuple[str, ...] = ("metadata.json", "frames.jsonl")) -> DataFrame:
    """Folders that hold all required files, the root alone if it does. File contents are not read."""
    parts = listing(spark, path)
    found = parts.where(F.col("name").isin(*required)).groupBy("folder").agg(F.countDistinct("name").alias("n")).where(F.col("n") == len(required)).select("folder")
    shortest = parts.agg(F.min(F.struct(F.length("folder"), "folder")).alias("r")).select(F.col("r.folder").alias("folder"))
    root = found.join(shortest, "folder", "left_semi").where(F.col("folder").endswith(path.rstrip("/")))
    return root if not root.isEmpty() else found


def series_folders(spark: SparkSession, path: str, ending: str = "_meta.jsonl") -> DataFrame:
    """Folders with a file whose name has the given ending (the older layout), the root alone if it has one."""
    found = listing(spark, path).where(F.col("name").endswith(ending)).select("folder").distinct()
    root = found.where(F.col("folder").endswith(path.rstrip("/")))
    return root if not root.isEmpty() else found


def replay_poses(spark: SparkSession, path: str, glob: str = "*pose*.jsonl") -> DataFrame:
    """file, x, y, z (NED) and yaw of the lines that have an action with a place on the map; others are passed over."""
    get = lambda p: F.try_variant_get("record", p, "double")
    r = jsonl_lenient(spark, path, glob).select("file", *[get(f"$.action.pos[{i}]").alias(c) for i, c in enumerate("xyz")], get("$.action.yaw").alias("yaw"))
    return r.where("x is not null and y is not null and z is not null").select("file", "x", (-F.col("y")).alias("y"), (-F.col("z")).alias("z"), "yaw")


def write_records(df: DataFrame, path: str, failure: Column | None = None, fmt: str = "json") -> None:
    """Write records as files, folders made as needed; with a failure expression, the first record that has one stops the
    write with its message."""
    if failure is not None:
        df = df.where(F.when(failure.isNull(), True).otherwise(F.raise_error(failure).cast("boolean")))
    df.write.mode("overwrite").format(fmt).save(path)


def landmarks(spark: SparkSession, path: str, types: tuple[str, ...] = ("building",), glob: str = "*.jsonl") -> DataFrame:
    """file, type, x, y, z, height, feature of landmarks of the given types whose file name has coordinates."""
    r = jsonl_lenient(spark, path, glob)
    get = lambda n, t="string": F.try_variant_get("record", f"$.{n}", t)
    flat = r.select("file", F.lower(get("type")).alias("type"), get("filename").alias("filename"), get("height", "double").alias("height"), get("feature").alias("feature"))
    named = flat.where(F.col("type").isin(*[t.lower() for t in types])).withColumn("p", building_coordinates("filename"))
    return named.where("p is not null").select("file", "type", "p.*", "height", "feature")


def scout_targets(spark: SparkSession, path: str) -> DataFrame:
    """Targets of scout files, which are a list or have one under `targets` or `candidates`: file, at, target (variant)."""
    docs = json_documents(spark, path)
    listed = F.coalesce(F.try_variant_get("record", "$.targets", "array<variant>"), F.try_variant_get("record", "$.candidates", "array<variant>"), F.try_variant_get("record", "$", "array<variant>"))
    return docs.select("file", F.posexplode(listed).alias("at", "target"))


def write_episodes(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Files by episode_id; rows without one are refused rather than written to a nameless folder."""
    checked = df.withColumn("episode_id", F.when(F.col("episode_id").isNull(), F.raise_error(F.lit("episode_id is required"))).otherwise(F.col("episode_id")))
    checked.repartition("episode_id").write.mode("overwrite").partitionBy("episode_id").format(fmt).save(path)


#: Grids written before this version lack a ground layer and are rebuilt.
GRID_VERSION = 3


def write_grid(columns: DataFrame, path: str) -> None:
    columns.withColumn("schema_version", F.lit(GRID_VERSION)).write.mode("overwrite").parquet(path)


def load_grid(spark: SparkSession, path: str) -> DataFrame:
    grid = spark.read.parquet(path)
    version = grid.agg(F.min("schema_version")).first()[0] if "schema_version" in grid.columns else None
    if version is None or version < GRID_VERSION:
        raise ValueError(f"grid at {path} has version {version}; rebuild it for version {GRID_VERSION}")
    return grid.drop("schema_version")
