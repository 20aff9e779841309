"""Sessions, shared scratch storage and table loading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Entity chunks hold this many consecutive frame indices; frame_idx is a 32-bit int, so one episode has at most 2**31 / BLOCK chunks.
BLOCK = 4096
_deleted_on_exit: set[str] = set()


def build_session(app: str = "skylattice", cores: str | None = None, partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster the session comes from the caller."""
    return (
        SparkSession.builder.master(f"local[{cores or '*'}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SKYLATTICE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; only a plain local session may fall back to a temporary folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="skylattice-")
        spark.conf.set("spark.checkpoint.dir", base)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut, and a lost executor costs nothing. The
    application's tables are deleted when its driver ends."""
    sc = df.sparkSession.sparkContext
    folder = f"{scratch_dir(df.sparkSession)}/{sc.applicationId}"
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if folder not in _deleted_on_exit:
        _deleted_on_exit.add(folder)
        place = sc._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
