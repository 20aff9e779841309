"""Live metrics over arriving frames with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType


def timed(frames: DataFrame) -> DataFrame:
    """Parquet times carry no zone; watermarks need one that does."""
    return frames.withColumn("received_at", F.col("received_at").cast("timestamp"))


def window_counts(frames: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Frames and visible frames by scene-time window and tracker mode, with late frames up to the watermark."""
    mode = F.regexp_replace(F.lower(F.coalesce("tracker_mode", F.lit(""))), "[^a-z]", "")
    return timed(frames).withWatermark("received_at", late).groupBy(F.window("received_at", width), mode.alias("mode")).agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.coalesce("target_visible", F.lit(False))).alias("visible")).select(F.col("window.start").alias("start"), "mode", "frames", "visible")


def without_repeats(frames: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each (episode_id, frame_idx) once, as long as its copies arrive within the watermark."""
    return timed(frames).withWatermark("received_at", late).dropDuplicatesWithinWatermark(["episode_id", "frame_idx"])


STATE = "frames long, visible long, collisions long, last_frame long, seen binary"
OUT = "episode_id string, frames long, visible long, collisions long, last_frame long"
#: An episode of which nothing arrives while the watermark moves on by this many milliseconds is over; its state is let go.
SILENCE = 30 * 24 * 3600 * 1000


def live_metrics(frames: DataFrame, late: str = "2 hours") -> DataFrame:
    """Running totals per episode in update mode, each frame counted once. The state is four numbers and one bit per frame
    number; it is let go when the watermark has moved on by SILENCE without a frame. Negative frame numbers are no frames."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, seen, hits, last, bits = state.get if state.exists else (0, 0, 0, -1, b"")
        known = np.frombuffer(bytes(bits), dtype=np.uint8)
        for p in parts:
            p = p.drop_duplicates("frame_idx")
            at = p["frame_idx"].to_numpy(dtype=np.int64)
            if len(at) and at.max() >= 8 * len(known):
                known = np.concatenate([known, np.zeros(int(at.max()) // 8 + 1 - len(known), dtype=np.uint8)])
            new = (known[at // 8] >> (at % 8).astype(np.uint8)) & 1 == 0
            p, at = p[new], at[new]
            known = known.copy()
            np.bitwise_or.at(known, at // 8, (1 << (at % 8)).astype(np.uint8))
            n += len(p)
            seen += int(p["target_visible"].eq(True).sum())
            hits += int(p["collision"].eq(True).sum())
            last = max(last, int(at.max())) if len(at) else last
        state.update((n, seen, hits, last, known.tobytes()))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), 0) + SILENCE)
        yield pd.DataFrame([(key[0], n, seen, hits, last)], columns=["episode_id", "frames", "visible", "collisions", "last_frame"])

    kept = timed(frames).withWatermark("received_at", late).where("episode_id is not null and frame_idx >= 0").select("episode_id", "frame_idx", "target_visible", "collision", "received_at")
    return kept.groupBy("episode_id").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def drained(df: DataFrame, mode: str, path: str) -> DataFrame:
    """Run a streaming DataFrame over what is there now and return what it wrote, with the number of its `batch`. Every
    batch is a folder of Parquet files, written anew if it is repeated; in complete mode the last one is the result."""
    spark = df.sparkSession
    schema = StructType([*df.schema.fields, StructField("batch", LongType())])

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/out/{number:012d}")

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.lastProgress is None and not q.recentProgress:
        return spark.createDataFrame([], schema)
    out = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/out")
    if mode == "complete":
        out = out.join(F.broadcast(out.agg(F.max("batch").alias("batch"))), "batch", "left_semi").drop("batch")
    return out


def append_ticks(frames: DataFrame, path: str, late: str = "2 hours") -> DataFrame:
    """Append arriving ticks, each frame once, to Parquet files by a streaming file sink, and read them back. Frames that
    come again after the watermark has passed them are not recognized, so the reader takes one row per frame."""
    ticks = without_repeats(frames.where("episode_id is not null and frame_idx is not null"), late)
    q = ticks.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return frames.sparkSession.read.schema(ticks.schema).parquet(f"{path}/out").dropDuplicates(["episode_id", "frame_idx"])
