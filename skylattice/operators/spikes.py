"""Implausible readings per episode: out of range, spikes and stuck runs.

Spikes are searched by robust principal components. The readings of an entity chunk are laid out as a profile
matrix (rows are successive stretches of WIDTH ticks, vector components stacked), which is split into a low-rank
part, the normal motion, and a sparse part. Readings with a sparse part beyond CANDIDATE usual changes leave the normal
motion, as spikes do and jumps to another level; an exact check against their neighbours tells the two apart. Readings
out of range are masked beforehand, so those beside them are checked too. Range and constant runs are tested on their own.

Plan: one shuffle by (episode, chunk) for the summaries (usual change, chunk ends, constant runs), a small merge per
episode for sequences of more than one chunk, one more shuffle by (episode, chunk) with the merged context added as
rows. Episodes of any size are spread over all tasks; the merge handles at most 2**31 / BLOCK summaries of an episode.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.operators.chunks import by_chunk, changes, codes, floats, whole_chunks
from skylattice.session import BLOCK, materialize

FIELDS = ("drone_distance_m", "target_velocity", "target_pose_world")
COMPONENTS = (("d",), ("vx", "vy", "vz"), ("px", "py", "pz"))
WIDTH = 8
#: Readings whose sparse part is beyond this many usual changes are spikes or jumps; the rule's limit is 20.
CANDIDATE = 12.0
ITERATIONS = 18
#: Weight of the sparse part against the usual 1 / sqrt(rows): below 1, so that a stretch of three spikes in all
#: components of a short series still is cheaper as sparse than as a low-rank part.
WEIGHT = 0.6
#: The usual change is the median of a histogram whose bins are 2**-12 of the value wide.
BIN_BITS = 40


@dataclass(frozen=True)
class SpikeLimits:
    """Thresholds of the rules; the defaults are those of the test data."""

    distance: tuple[float, float] = (0.0, 10_000.0)
    velocity: float = 120.0
    position: float = 100_000.0
    off: float = 20.0
    longest: int = 3
    stuck: int = 12


def frame_columns(frames: DataFrame, block: int) -> DataFrame:
    """The columns the operator needs. A frame is (episode_id, frame_idx); rows without either have no place in a sequence.
    A vector without three non-null components counts as a null reading."""
    v, p = F.col("target_velocity"), F.col("target_pose_world")
    vec = [F.try_element_at(v, F.lit(i)).cast("double") for i in (1, 2, 3)]
    pos = [p[c].cast("double") for c in "xyz"]

    def whole(parts, x):
        ok = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
        return F.when(ok, x)

    return frames.where(F.col("episode_id").isNotNull() & F.col("frame_idx").isNotNull()).select(
        "episode_id",
        F.expr(f"cast(floor(frame_idx / {block}) as int)").alias("chunk"),
        F.col("frame_idx").cast("int").alias("frame_idx"),
        F.col("drone_distance_m").cast("double").alias("d"),
        *[whole(vec, x).alias(n) for x, n in zip(vec, COMPONENTS[1])],
        *[whole(pos, x).alias(n) for x, n in zip(pos, COMPONENTS[2])],
    )


class Frames:
    """Distinct frames of whole chunks; of repeated frames the first in sort order stays."""

    def __init__(self, table: pa.Table):
        ep, chunk, idx = codes(table["episode_id"]), codes(table["chunk"]), codes(table["frame_idx"])
        keep = np.flatnonzero(changes([ep, chunk, idx]))
        if len(keep) < table.num_rows:
            table = table.take(pa.array(keep))
            ep, chunk, idx = ep[keep], chunk[keep], idx[keep]
        self.idx = idx
        self.starts = np.flatnonzero(changes([ep, chunk]))
        self.of = np.searchsorted(self.starts, np.arange(len(idx)), side="right") - 1
        self.episode = table["episode_id"].take(pa.array(self.starts)).to_pylist()
        self.chunk = chunk[self.starts]
        self.values = []
        for names in COMPONENTS:
            columns = [floats(table[n]) for n in names]
            self.values.append((np.stack([c[0] for c in columns], axis=1), columns[0][1]))

    def readings(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the frames with a reading of field f, and the readings."""
        values, valid = self.values[f]
        at = np.flatnonzero(valid)
        return at, values[at]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        if a.shape[1] == 1:
            return np.abs(a[:, 0] - b[:, 0])
        return np.sqrt(((a - b) ** 2).sum(axis=1))


def histogram(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins and counts of the finite changes above zero."""
    change = change[(change > 0) & np.isfinite(change)]
    return np.unique(change.view(np.int64) >> BIN_BITS, return_counts=True)


def median_of(bins: np.ndarray, counts: np.ndarray) -> float:
    """Median of a histogram (mean of the two middle bins' centres), NaN when empty."""
    if not len(bins):
        return float("nan")
    ends = np.cumsum(counts)
    n = ends[-1]
    middle = bins[np.searchsorted(ends, [(n - 1) // 2, n // 2], side="right")]
    return float((((middle << BIN_BITS) + (1 << (BIN_BITS - 1))).view(np.float64)).mean())


def usual_changes(bins: np.ndarray, of: np.ndarray, groups: int) -> np.ndarray:
    """median_of for many groups at once, from one bin per change."""
    order = np.lexsort((bins, of))
    bins, of = bins[order], of[order]
    n = np.bincount(of, minlength=groups)
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    out = np.full(groups, np.nan)
    some = np.flatnonzero(n)
    centre = lambda i: ((bins[i] << BIN_BITS) + (1 << (BIN_BITS - 1))).view(np.float64)
    out[some] = (centre(start[some] + (n[some] - 1) // 2) + centre(start[some] + n[some] // 2)) / 2
    return out


SUMMARY = (
    "kind int, episode_id string, chunk int, field int, bins array<long>, counts array<long>, head array<double>, tail array<double>, "
    "first_frame int, last_frame int, n int, value array<double>, pose array<double>, rest boolean, edge boolean, frames array<int>"
)
ENDS = 4  # readings kept of either end of a chunk: a spike's length and the reading beyond it


def summaries(batches: Iterable[pa.RecordBatch], stuck: int) -> Iterator[pa.RecordBatch]:
    """Per chunk and field: kind 0 has the histogram of changes and both ends; kind 1 is a run of equal readings that
    is long enough or touches an end of the chunk."""
    schema = summary_schema()
    for table in whole_chunks(batches, ["episode_id", "chunk"]):
        fr = Frames(table)
        rows: list[tuple] = []
        velocity, has_velocity = fr.values[1]
        pose, has_pose = fr.values[2]
        moving = has_velocity & (velocity != 0).any(axis=1)
        moves = np.concatenate([[0], np.cumsum(moving)])
        # the last pose seen at or before each frame, to tell whether it changes within a run
        at_pose = np.flatnonzero(has_pose)
        change_pose = np.zeros(len(at_pose), dtype=bool)
        if len(at_pose):
            change_pose[1:] = (pose[at_pose[1:]] != pose[at_pose[:-1]]).any(axis=1)
        turns = np.concatenate([[0], np.cumsum(change_pose)])
        for f in range(len(FIELDS)):
            at, x = fr.readings(f)
            if not len(at):
                continue
            of = fr.of[at]
            start = np.searchsorted(of, np.arange(len(fr.starts)))
            end = np.searchsorted(of, np.arange(len(fr.starts)), side="right")
            step = distance(x[1:], x[:-1])
            step[of[1:] != of[:-1]] = 0
            good = np.flatnonzero((step > 0) & np.isfinite(step))
            good_bins, good_of = step[good].view(np.int64) >> BIN_BITS, of[good]
            order = np.lexsort((good_bins, good_of))
            good_bins, good_of = good_bins[order], good_of[order]
            b0 = np.searchsorted(good_of, np.arange(len(fr.starts)))
            b1 = np.searchsorted(good_of, np.arange(len(fr.starts)), side="right")
            same = np.ones(len(at), dtype=bool)
            same[1:] = (x[1:] == x[:-1]).all(axis=1) & (of[1:] == of[:-1])
            same[0] = False
            runs = np.flatnonzero(~same)
            lengths = np.diff(np.append(runs, len(at)))
            for c in range(len(fr.starts)):
                if start[c] == end[c]:
                    continue
                bins, counts = np.unique(good_bins[b0[c] : b1[c]], return_counts=True)
                rows.append((0, fr.episode[c], int(fr.chunk[c]), f, bins.tolist(), counts.tolist(), x[start[c] : min(end[c], start[c] + ENDS)].ravel().tolist(), x[max(start[c], end[c] - ENDS) : end[c]].ravel().tolist(), None, None, None, None, None, None, None, None))
            first, last = runs, runs + lengths - 1
            edge = (of[np.maximum(first - 1, 0)] != of[first]) | (first == 0) | (last == len(at) - 1) | (of[np.minimum(last + 1, len(at) - 1)] != of[last])
            for i in np.flatnonzero(edge | (lengths >= stuck)):
                a, b = at[first[i]], at[last[i]]
                lo, hi = np.searchsorted(at_pose, [a, b + 1])
                rest = bool(moves[b + 1] == moves[a] and (hi - lo < 2 or turns[hi] == turns[lo + 1]))
                rows.append((1, fr.episode[of[first[i]]], int(fr.chunk[of[first[i]]]), f, None, None, None, None, int(fr.idx[a]), int(fr.idx[b]), int(lengths[i]), x[first[i]].tolist(), pose[at_pose[lo]].tolist() if hi > lo else None, rest, bool(edge[i]), fr.idx[at[first[i] : last[i] + 1]].tolist()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def summary_schema() -> pa.Schema:
    doubles, longs = pa.list_(pa.float64()), pa.list_(pa.int64())
    return pa.schema(
        [("kind", pa.int32()), ("episode_id", pa.string()), ("chunk", pa.int32()), ("field", pa.int32()), ("bins", longs), ("counts", longs), ("head", doubles), ("tail", doubles), ("first_frame", pa.int32()), ("last_frame", pa.int32()), ("n", pa.int32()), ("value", doubles), ("pose", doubles), ("rest", pa.bool_()), ("edge", pa.bool_()), ("frames", pa.list_(pa.int32()))]
    )


def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For sequences of several chunks, per chunk and field: the usual change of the whole sequence and the readings
    just before and after the chunk. Rows come sorted by (episode, field, chunk)."""
    schema = pa.schema([("episode_id", pa.string()), ("chunk", pa.int32()), ("field", pa.int32()), ("usual", pa.float64()), ("before", pa.list_(pa.float64())), ("after", pa.list_(pa.float64()))])
    for table in whole_chunks(batches, ["episode_id", "field"]):
        ep, field = codes(table["episode_id"]), codes(table["field"])
        bounds = np.append(np.flatnonzero(changes([ep, field])), table.num_rows)
        out = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a < 2:
                continue
            part = table.slice(a, b - a).to_pydict()
            dim = len(COMPONENTS[part["field"][0]])
            bins, counts = (np.concatenate([np.array(x, dtype=np.int64) for x in part[k]]) for k in ("bins", "counts"))
            tails = [np.array(x).reshape(-1, dim) for x in part["tail"]]
            heads = [np.array(x).reshape(-1, dim) for x in part["head"]]
            between = histogram(np.concatenate([distance(h[:1], t[-1:]) for t, h in zip(tails[:-1], heads[1:])]))
            bins, which = np.unique(np.concatenate([bins, between[0]]), return_inverse=True)
            usual = median_of(bins, np.bincount(which, weights=np.concatenate([counts, between[1]])).astype(np.int64))
            before, after = [np.empty((0, dim))], [np.empty((0, dim))]
            for t in tails[:-1]:
                before.append(np.concatenate([before[-1], t])[-ENDS:])
            for h in heads[:0:-1]:
                after.append(np.concatenate([h, after[-1]])[:ENDS])
            for i, (x, y) in enumerate(zip(before, after[::-1])):
                out.append((part["episode_id"][0], part["chunk"][i], part["field"][0], usual, x.ravel().tolist(), y.ravel().tolist()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t.type) for c, t in zip(zip(*out), schema)], schema=schema)


def stuck_pieces(batches: Iterable[pa.RecordBatch], stuck: int) -> Iterator[pa.RecordBatch]:
    """Join runs of equal readings across chunk ends; rows come sorted by (episode, field, first_frame)."""
    schema = pa.schema([("episode_id", pa.string()), ("field", pa.int32()), ("frames", pa.list_(pa.int32()))])
    for table in whole_chunks(batches, ["episode_id", "field"]):
        out: list[tuple] = []
        open_: list[dict] = []

        def close() -> None:
            if open_ and sum(p["n"] for p in open_) >= stuck:
                poses = [p["pose"] for p in open_ if p["pose"] is not None]
                if not (all(p["rest"] for p in open_) and all(p == poses[0] for p in poses)):
                    out.extend((p["episode_id"], p["field"], p["frames"]) for p in open_)  # noqa: B023
            open_.clear()  # noqa: B023

        for p in table.to_pylist():
            if open_ and not (p["chunk"] != (q := open_[-1])["chunk"] and (p["episode_id"], p["field"], p["value"]) == (q["episode_id"], q["field"], q["value"])):
                close()
            open_.append(p)
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t.type) for c, t in zip(zip(*out), schema)], schema=schema)


def sparse_part(matrices: np.ndarray) -> np.ndarray:
    """Principal component pursuit by the inexact augmented Lagrangian, for a stack of matrices [n, rows, WIDTH].
    Singular values are shrunk through the small Gram matrices. Returns the sparse parts."""
    m = matrices
    _, rows, width = m.shape
    lam = WEIGHT / np.sqrt(max(rows, width))
    norm = np.sqrt(np.maximum(np.linalg.eigvalsh(np.swapaxes(m, 1, 2) @ m)[:, -1], 1e-300))[:, None, None]
    y = m / np.maximum(norm, np.abs(m).max(axis=(1, 2), keepdims=True) / lam)
    mu = 1.25 / norm
    s = np.zeros_like(m)
    for _ in range(ITERATIONS):
        a = m - s + y / mu
        w, v = np.linalg.eigh(np.swapaxes(a, 1, 2) @ a)
        sigma = np.sqrt(np.maximum(w, 0))
        shrink = np.where(sigma > 1 / mu[:, :, 0], 1 - 1 / (mu[:, :, 0] * np.maximum(sigma, 1e-300)), 0)
        low = a @ ((v * shrink[:, None, :]) @ np.swapaxes(v, 1, 2))
        a = m - low + y / mu
        s = np.sign(a) * np.maximum(np.abs(a) - lam / mu, 0)
        y = y + mu * (m - low - s)
        mu = mu * 1.5
    return s


def candidates(x: np.ndarray, plausible: np.ndarray, starts: np.ndarray, ends: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """Positions whose sparse part exceeds CANDIDATE usual changes. x: readings of many series, cut by starts and ends."""
    dim = x.shape[1]
    marked = np.zeros(len(x), dtype=bool)
    # readings out of range would bend the low-rank part: the last plausible one stands in for them
    filled = x
    if not plausible.all():
        back = np.maximum.accumulate(np.where(plausible, np.arange(len(x)), -1))
        ahead = np.minimum.accumulate(np.where(plausible, np.arange(len(x)), len(x))[::-1])[::-1]
        of = np.searchsorted(starts, np.arange(len(x)), side="right") - 1
        source = np.where(back >= starts[of], back, np.where(ahead < ends[of], ahead, np.arange(len(x))))
        filled = np.where(np.isfinite(x[source]), x[source], 0.0)
    sizes = ends - starts
    worth = np.flatnonzero((sizes >= 3) & (usual > 0))
    rows = -(-sizes // WIDTH)
    for r in np.unique(1 << np.ceil(np.log2(rows[worth])).astype(int)) if len(worth) else []:
        group = worth[(rows[worth] <= r) & (rows[worth] > r // 2)]
        most = max(1, 400_000 // (int(r) * WIDTH * dim))
        for part in (group[i : i + most] for i in range(0, len(group), most)):
            at = starts[part][:, None] + np.arange(r * WIDTH)[None, :]
            inside = at < ends[part][:, None]
            at = np.minimum(at, ends[part][:, None] - 1)
            m = filled[at]
            # each stretch is centred on its median, which three spikes in eight can't move: a long way travelled would
            # dwarf them otherwise
            m = m.reshape(len(part), r, WIDTH, dim)
            m = ((m - np.median(m, axis=2, keepdims=True)) / usual[part][:, None, None, None]).reshape(len(part), r * WIDTH, dim)
            padded = -(-sizes[part] // WIDTH) * WIDTH
            m[np.arange(r * WIDTH)[None, :] >= padded[:, None]] = 0
            stacked = np.concatenate([m[:, :, k].reshape(len(part), r, WIDTH) for k in range(dim)], axis=1)
            s = sparse_part(stacked).reshape(len(part), dim, r * WIDTH)
            hit = (np.sqrt((s**2).sum(axis=1)) >= CANDIDATE) & inside
            marked[at[hit]] = True
    # where spikes crowd, the stretch's median may lie on one, and readings out of range are masked above: what is near
    # a candidate or such a reading is one too
    marked |= ~plausible
    near = marked.copy()
    for k in range(1, 4):
        near[k:] |= marked[:-k]
        near[:-k] |= marked[k:]
    return np.flatnonzero(near)


def confirmed(x: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: np.ndarray, longest: int) -> np.ndarray:
    """The exact check: which of the positions belong to a stretch of up to `longest` readings that all lie at least
    `limit` off the reading before the stretch and the one after it."""
    good = np.zeros(len(at), dtype=bool)
    for size in range(1, longest + 1):
        for ahead in range(size):
            first = at - ahead
            last = first + size - 1
            ok = (first - 1 >= starts) & (last + 1 < ends)
            lo, hi = np.where(ok, first - 1, at), np.where(ok, last + 1, at)
            for k in range(size):
                mid = np.where(ok, first + k, at)
                ok &= (distance(x[mid], x[lo]) >= limit) & (distance(x[mid], x[hi]) >= limit)
            good |= ok
    return good


def impossible(f: int, x: np.ndarray, limits: SpikeLimits) -> np.ndarray:
    with np.errstate(all="ignore"):
        if f == 0:
            return ~np.isfinite(x[:, 0]) | (x[:, 0] < limits.distance[0]) | (x[:, 0] > limits.distance[1])
        return (~np.isfinite(x) | (np.abs(x) > (limits.velocity if f == 1 else limits.position))).any(axis=1)


def spike_rows(batches: Iterable[pa.RecordBatch], limits: SpikeLimits) -> Iterator[pa.RecordBatch]:
    """Impossible readings and spikes of whole chunks. Rows with is_frame = 0 carry a chunk's context."""
    schema = pa.schema([("episode_id", pa.string()), ("frame_idx", pa.int32()), ("field", pa.int32()), ("reason", pa.string())])
    for table in whole_chunks(batches, ["episode_id", "chunk"]):
        is_frame = codes(table["is_frame"]) == 1
        known: dict[tuple, tuple] = {}
        for row in table.filter(pa.array(~is_frame)).select(["episode_id", "chunk", "frame_idx", "usual", "before", "after"]).to_pylist():
            known[row["episode_id"], row["chunk"], row["frame_idx"]] = (row["usual"], row["before"], row["after"])
        fr = Frames(table.filter(pa.array(is_frame)).select(["episode_id", "chunk", "frame_idx", *sum(COMPONENTS, ())]))
        groups = len(fr.starts)
        if not groups:
            continue
        for f in range(len(FIELDS)):
            at, x = fr.readings(f)
            if not len(at):
                continue
            dim, of = x.shape[1], fr.of[at]
            bad = impossible(f, x, limits)
            step = distance(x[1:], x[:-1])
            good = np.flatnonzero((step > 0) & np.isfinite(step) & (of[1:] == of[:-1]))
            usual = usual_changes(step[good].view(np.int64) >> BIN_BITS, of[good], groups)
            own = np.ones(len(x), dtype=bool)
            ctx = [(c, known[k]) for c in range(groups) if (k := (fr.episode[c], int(fr.chunk[c]), f)) in known] if known else []
            if ctx:  # put the neighbours' readings around those of the chunk
                extra, where = [], []
                for c, (u, before, after) in ctx:
                    usual[c] = u
                    for values, side in ((before, "left"), (after, "right")):
                        v = np.array(values, dtype=np.float64).reshape(-1, dim)
                        extra.append(v)
                        where.append(np.full(len(v), np.searchsorted(of, c, side=side)))
                extra, where = np.concatenate(extra), np.concatenate(where)
                owner = np.concatenate([np.repeat(c, (len(b) + len(a)) // dim) for c, (_, b, a) in ctx]).astype(of.dtype)
                x = np.insert(x, where, extra, axis=0)
                own = np.insert(own, where, False)
                at = np.insert(at, where, -1)
                of = np.insert(of, where, owner)
                bad = impossible(f, x, limits)
            starts = np.searchsorted(of, np.arange(groups))
            ends = np.searchsorted(of, np.arange(groups), side="right")
            hit = candidates(x, ~bad, starts, ends, usual)
            hit = hit[confirmed(x, hit, starts[of[hit]], ends[of[hit]], limits.off * usual[of[hit]], limits.longest)]
            for which, reason in ((np.flatnonzero(bad & own), "impossible"), (hit[own[hit]], "spike")):
                if len(which):
                    frames = at[which]
                    yield pa.RecordBatch.from_arrays([pa.array([fr.episode[c] for c in of[which]], pa.string()), pa.array(fr.idx[frames], pa.int32()), pa.array(np.full(len(which), f, dtype=np.int32)), pa.array([reason] * len(which), pa.string())], schema=schema)


def implausible_readings(frames: DataFrame, limits: SpikeLimits = SpikeLimits(), block: int = BLOCK) -> DataFrame:
    """Rows (episode_id, frame_idx, field_name, reason) with reason in impossible, spike, stuck; a reading may have several.

    Repeated frames count once; null readings are skipped; frames without episode_id or frame_idx give no rows; other
    columns are ignored. An empty table gives no rows. A sequence without any change has no usual change and no spikes."""
    columns = frame_columns(frames, block)
    keys, stuck = ["episode_id", "chunk"], limits.stuck
    order = ["frame_idx", "d", "vx", "vy", "vz", "px", "py", "pz"]
    found = materialize(by_chunk(columns, keys, order).mapInArrow(lambda b: summaries(b, stuck), SUMMARY), "p4-summaries")
    per_field = ["episode_id", "field"]
    several = found.where("kind = 0").select(*per_field, "chunk", "bins", "counts", "head", "tail")
    context = by_chunk(several, per_field, ["chunk"]).mapInArrow(contexts, "episode_id string, chunk int, field int, usual double, before array<double>, after array<double>")
    runs = found.where("kind = 1 and edge").select(*per_field, "chunk", "first_frame", "n", "value", "pose", "rest", "frames")
    joined = by_chunk(runs, per_field, ["first_frame"]).mapInArrow(lambda b: stuck_pieces(b, stuck), "episode_id string, field int, frames array<int>")
    closed = found.where(f"kind = 1 and not edge and n >= {stuck} and not rest").select("episode_id", "field", "frames")
    still = closed.unionByName(joined).select("episode_id", F.explode("frames").alias("frame_idx"), "field", F.lit("stuck").alias("reason"))
    blank = [F.lit(None).cast("double").alias(c) for c in sum(COMPONENTS, ())]
    marks = context.select(*keys, F.col("field").alias("frame_idx"), *blank, F.lit(0).alias("is_frame"), "usual", "before", "after")
    body = columns.select("*", F.lit(1).alias("is_frame"), F.lit(None).cast("double").alias("usual"), *[F.lit(None).cast("array<double>").alias(c) for c in ("before", "after")])
    out = by_chunk(body.unionByName(marks), keys, ["is_frame", *order]).mapInArrow(lambda b: spike_rows(b, limits), "episode_id string, frame_idx int, field int, reason string")
    names = F.element_at(F.array(*[F.lit(n) for n in FIELDS]), F.col("field") + 1)
    return out.unionByName(still).select("episode_id", "frame_idx", names.alias("field_name"), "reason")
