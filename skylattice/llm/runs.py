"""Repeated consecutive events: each maximal run of equal neighbours becomes one event with count and duration.

Boundary interval lookup: events are shuffled by (entity, chunk of BLOCK order keys). In each entity chunk the run
starts are gathered into a sorted array, every event finds its run by binary search, and events are aggregated by run.
Runs that touch an end of their chunk are pieces; the same step joins them per entity. The order key is a 32-bit int,
so one entity has at most 2 * 2**31 / BLOCK pieces, whatever share of the rows it holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.operators.chunks import by_chunk, changes, codes, floats, whole_chunks
from skylattice.session import BLOCK, materialize

PIECES = "entity string, chunk int, state string, first_key int, last_key int, events bigint, first_time double, last_time double, edge boolean"
PIECE_SCHEMA = pa.schema([("entity", pa.string()), ("chunk", pa.int32()), ("state", pa.string()), ("first_key", pa.int32()), ("last_key", pa.int32()), ("events", pa.int64()), ("first_time", pa.float64()), ("last_time", pa.float64()), ("edge", pa.bool_())])


def join_neighbours(batches: Iterable[pa.RecordBatch], keys: list[str], max_gap: float, distinct: bool) -> Iterator[pa.RecordBatch]:
    """Merge neighbours of equal state whose time grows by at most max_gap. Rows come sorted by keys and first_key;
    with distinct, repeated first_key values of a chunk count once."""
    for table in whole_chunks(batches, keys):
        entity = changes([codes(table[k]) for k in keys])
        if distinct:
            keep = np.flatnonzero(entity | changes([codes(table["first_key"])]))
            if len(keep) < table.num_rows:
                table, entity = table.take(pa.array(keep)), entity[keep]
        n = table.num_rows
        first_time, last_time = floats(table["first_time"])[0], floats(table["last_time"])[0]
        start = entity | changes([codes(table["state"])])
        with np.errstate(invalid="ignore"):
            start[1:] |= ~(first_time[1:] - last_time[:-1] <= max_gap)
        if not distinct:  # pieces of one chunk are maximal already, and others may lie between them
            start |= ~changes([codes(table["chunk"])])
        starts = np.flatnonzero(start)
        run = np.searchsorted(starts, np.arange(n), side="right") - 1
        ends = np.searchsorted(run, np.arange(len(starts)), side="right") - 1
        events = np.bincount(run, weights=codes(table["events"]), minlength=len(starts)).astype(np.int64)
        closes = np.append(entity[1:], True)
        edge = entity[starts] | closes[ends]
        at = pa.array(starts)
        yield pa.RecordBatch.from_arrays(
            [
                *(table[c].take(at).combine_chunks() for c in ("entity", "chunk", "state", "first_key")),
                table["last_key"].take(pa.array(ends)).combine_chunks(),
                pa.array(events),
                table["first_time"].take(at).combine_chunks(),
                table["last_time"].take(pa.array(ends)).combine_chunks(),
                pa.array(edge),
            ],
            schema=PIECE_SCHEMA,
        )


def collapse_runs(events: DataFrame, entity: str, order: str, time: str, state: list[Column], max_gap: float = 1.0, block: int = BLOCK) -> DataFrame:
    """One row per maximal run: entity, first_key, last_key, events, first_time, last_time, duration, state.

    Neighbours in order of `order` belong together if all state columns agree (null agrees with null only) and time
    grows by at most max_gap; a null or NaN time belongs to no neighbour. Rows with the same (entity, order) are one
    event; where such rows differ, the one first by time and state stands. Rows without entity or order have no place in
    a sequence and are left out; other columns are ignored. An empty table gives no rows. A run of one event is a run."""
    joined = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), s.cast("string")), F.lit("~")) for s in state])
    flat = events.where(F.col(entity).isNotNull() & F.col(order).isNotNull()).select(
        F.col(entity).cast("string").alias("entity"),
        F.expr(f"cast(floor(`{order}` / {block}) as int)").alias("chunk"),
        F.col(order).cast("int").alias("first_key"),
        F.col(order).cast("int").alias("last_key"),
        joined.alias("state"),
        F.lit(1).cast("bigint").alias("events"),
        F.col(time).cast("double").alias("first_time"),
        F.col(time).cast("double").alias("last_time"),
    )
    keys = ["entity", "chunk"]
    pieces = materialize(by_chunk(flat, keys, ["first_key", "first_time", "state"]).mapInArrow(lambda b: join_neighbours(b, keys, max_gap, True), PIECES), "runs")
    across = by_chunk(pieces.where("edge"), ["entity"], ["first_key"]).mapInArrow(lambda b: join_neighbours(b, ["entity"], max_gap, False), PIECES)
    return pieces.where("not edge").unionByName(across).select(
        "entity", "first_key", "last_key", "events", "first_time", "last_time", (F.col("last_time") - F.col("first_time")).alias("duration"), "state"
    )


def tracker_runs(frames: DataFrame, max_gap: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Runs of frames in which tracker_mode (its letters a-z alone, in lower case) and target_visible stay the same."""
    mode = F.regexp_replace(F.lower(F.coalesce("tracker_mode", F.lit(""))), "[^a-z]", "")
    runs = collapse_runs(frames, "episode_id", "frame_idx", "timestamp_s", [mode, F.col("target_visible")], max_gap, block)
    parts = F.split("state", "\x1f")
    return runs.select(
        F.col("entity").alias("episode_id"),
        F.col("first_key").alias("first_frame_idx"),
        F.col("last_key").alias("last_frame_idx"),
        F.col("events").alias("frames"),
        F.col("duration").alias("duration_s"),
        F.substring(parts[0], 2, 1 << 20).alias("tracker_mode"),
        F.when(parts[1] != "~", F.substring(parts[1], 2, 8).cast("boolean")).alias("target_visible"),
    )
