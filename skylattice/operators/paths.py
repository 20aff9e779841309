"""Routes: natural cubic splines through waypoints, even resampling, curvature and speed profiles.

One route is one group, however many waypoints it has; routes spread over all tasks, but a single route is held whole by
one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Metres, metres per second, and their rates. Fixed values.
STEP, TOP, LATERAL, GAIN, BRAKE, LEAST, TIGHTEST = 0.5, 8.0, 2.5, 1.5, 2.5, 0.6, 1 / 6


def natural_spline(t: np.ndarray, y: np.ndarray):
    """A function of (at, derivative 0..2) for the natural cubic spline through (t, y). The second derivatives solve one
    tridiagonal system, here by elimination."""
    n, h = len(t), np.diff(t)
    m = np.zeros((n, y.shape[1]))
    if n > 2:
        slope = np.diff(y, axis=0) / h[:, None]
        diagonal, right = 2 * (h[:-1] + h[1:]), 6 * np.diff(slope, axis=0)
        for i in range(1, n - 2):
            w = h[i] / diagonal[i - 1]
            diagonal[i] -= w * h[i]
            right[i] -= w * right[i - 1]
        for i in range(n - 3, -1, -1):
            m[i + 1] = (right[i] - (h[i + 1] * m[i + 2] if i + 2 < n - 1 else 0)) / diagonal[i]

    def at(x: np.ndarray, derivative: int = 0) -> np.ndarray:
        i = np.clip(np.searchsorted(t, x, side="right") - 1, 0, n - 2)
        w, a, b = h[i][:, None], (t[i + 1] - x)[:, None], (x - t[i])[:, None]
        if derivative == 0:
            return (m[i] * a**3 + m[i + 1] * b**3) / (6 * w) + (y[i] / w - m[i] * w / 6) * a + (y[i + 1] / w - m[i + 1] * w / 6) * b
        if derivative == 1:
            return (m[i + 1] * b**2 - m[i] * a**2) / (2 * w) + (y[i + 1] - y[i]) / w - (m[i + 1] - m[i]) * w / 6
        return (m[i] * a + m[i + 1] * b) / w

    return at


def speed_profile(s: np.ndarray, curvature: np.ndarray) -> np.ndarray:
    """Highest speed at each place that respects cornering, then what can be gained from the start and lost to the end."""
    v = np.minimum(TOP, np.sqrt(LATERAL / np.maximum(np.abs(curvature), LATERAL / TOP**2)))
    # in squared speeds both passes are running minima: v2[i] <= min over j of v2[j] + 2 a |s[i] - s[j]|
    v2 = v * v
    v2[0] = v2[-1] = LEAST**2
    v2 = np.minimum.accumulate(v2 - 2 * GAIN * s) + 2 * GAIN * s
    v2 = (np.minimum.accumulate((v2 + 2 * BRAKE * s)[::-1])[::-1]) - 2 * BRAKE * s
    return np.maximum(np.sqrt(np.maximum(v2, 0)), LEAST)


def smooth_path(points: np.ndarray, step: float = STEP) -> dict[str, np.ndarray]:
    """s, x, y, heading, curvature, speed along a path through the points (repeated neighbours are dropped)."""
    points = np.asarray(points, dtype=np.float64)
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = (np.diff(points, axis=0) ** 2).sum(axis=1) > 1e-18
    points = points[keep]
    if len(points) < 2:
        raise ValueError("a path needs two different points")
    chord = np.concatenate([[0.0], np.cumsum(np.sqrt((np.diff(points, axis=0) ** 2).sum(axis=1)))])
    spline = natural_spline(chord, points)
    fine = np.linspace(0, chord[-1], max(64, int(4 * chord[-1])))
    length = np.concatenate([[0.0], np.cumsum(np.sqrt((np.diff(spline(fine), axis=0) ** 2).sum(axis=1)))])
    s = np.linspace(0, length[-1], max(8, int(np.ceil(length[-1] / step)) + 1))
    t = np.interp(s, length, fine)
    xy, d1, d2 = spline(t), spline(t, 1), spline(t, 2)
    bend = (d1[:, 0] * d2[:, 1] - d1[:, 1] * d2[:, 0]) / np.maximum((d1**2).sum(axis=1) ** 1.5, 1e-9)
    bend = np.clip(bend, -TIGHTEST, TIGHTEST)
    for _ in range(2):
        bend[1:-1] = np.convolve(bend, [0.25, 0.5, 0.25], mode="valid")
    return {"s": s, "x": xy[:, 0], "y": xy[:, 1], "heading": np.arctan2(d1[:, 1], d1[:, 0]), "curvature": bend, "speed": speed_profile(s, bend)}


def smooth_routes(waypoints: DataFrame) -> DataFrame:
    """Paths of waypoints (route_id, ord, x, y): route_id, k, s, x, y, heading, curvature, speed. Routes of fewer than
    two different points give no rows."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ord", kind="stable")
        try:
            path = smooth_path(part[["x", "y"]].to_numpy())
        except ValueError:
            path = {k: np.empty(0) for k in ("s", "x", "y", "heading", "curvature", "speed")}
        out = pd.DataFrame(path)
        out.insert(0, "k", np.arange(len(out), dtype=np.int32))
        out.insert(0, "route_id", part["route_id"].iloc[0])
        return out

    kept = waypoints.where("route_id is not null and ord is not null and x is not null and y is not null").select("route_id", "ord", "x", "y")
    return kept.groupBy("route_id").applyInPandas(run, f"route_id {dict(kept.dtypes)['route_id']}, k int, s double, x double, y double, heading double, curvature double, speed double")


#: Degrees a second by which a follower can turn. Fixed value.
TURN_RATE = 60.0


def followed(routes: DataFrame, dt: float = 0.2, turn_rate: float = TURN_RATE) -> DataFrame:
    """route_id, tick, s, x, y, heading of a follower of each path (the result of smooth_routes): every tick it goes on by the
    path's speed where it is, stands on the path, and turns towards the path's direction no faster than turn_rate. It
    ends at the path's end. A path is held by one task, and its ticks are bounded by its length over the least speed."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k", kind="stable")
        s, speed = part["s"].to_numpy(), part["speed"].to_numpy()
        places = [0.0]
        while places[-1] < s[-1]:
            places.append(min(s[-1], places[-1] + float(np.interp(places[-1], s, speed)) * dt))
        at = np.array(places)
        wish = np.interp(at, s, np.unwrap(part["heading"].to_numpy()))
        heading, limit = wish.copy(), np.radians(turn_rate) * dt
        for i in range(1, len(at)):
            heading[i] = heading[i - 1] + np.clip(wish[i] - heading[i - 1], -limit, limit)
        out = pd.DataFrame({"tick": np.arange(len(at), dtype=np.int32), "s": at, "x": np.interp(at, s, part["x"]), "y": np.interp(at, s, part["y"]), "heading": (heading + np.pi) % (2 * np.pi) - np.pi})
        out.insert(0, "route_id", part["route_id"].iloc[0])
        return out

    return routes.groupBy("route_id").applyInPandas(run, f"route_id {dict(routes.dtypes)['route_id']}, tick int, s double, x double, y double, heading double")
