"""Rollouts of target policies and tracker state over time.

A rollout is sequential by nature, but its length is bounded by its specification (steps), so each specification is one
group and groups spread over all tasks. Random draws come from NumPy's generator seeded by the specification.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.operators.sequence import annotate

#: Speed, turn and timing by difficulty. Fixed values.
PRESETS = {
    "easy": {"speed": 2.0, "turn": 45.0, "every": 14.0, "sharp": 40.0, "detour": 7.0, "offset": 50.0, "gain": 1.15, "engage": 18.0},
    "medium": {"speed": 3.0, "turn": 90.0, "every": 9.0, "sharp": 75.0, "detour": 5.0, "offset": 65.0, "gain": 1.3, "engage": 30.0},
    "hard": {"speed": 4.0, "turn": 120.0, "every": 5.0, "sharp": 110.0, "detour": 4.0, "offset": 80.0, "gain": 1.5, "engage": 45.0},
}
TOP_SPEED = 1.6
POLICIES = ("direct_escape", "sharp_turn", "detour_feint", "occlusion_seeking", "random_walk", "s_curve")
#: Tracker thresholds in seconds and metres per second. Fixed values.
PREDICT, PEEK, SEARCH, STOPPED, HOLD = 0.4, 0.8, 3.0, 0.3, 4.0


def wrapped(a: float) -> float:
    return (a + math.pi) % (2 * math.pi) - math.pi


def chooser(policy: str, p: dict, rng: np.random.Generator):
    """A function of (t, heading, bearing away from the drone, range) that gives (wished heading, speed, label)."""
    memory = {"next": p["every"] * rng.uniform(0.8, 1.2), "side": 1.0 if rng.random() < 0.5 else -1.0, "mode": "", "since": 0.0, "cruise": None, "chosen": 0.0, "anchor": None}

    def direct(t, heading, away, reach):
        return away, min(p["speed"] * TOP_SPEED, p["speed"] * p["gain"]) if reach < p["engage"] else p["speed"], "direct_escape"

    def sharp(t, heading, away, reach):
        if memory["cruise"] is None:
            memory["cruise"] = heading
        label = "cruise"
        if t >= memory["next"]:
            turn = math.radians(p["sharp"]) * (1.0 if rng.random() < 0.5 else -1.0)
            memory["cruise"] = wrapped(memory["cruise"] + turn)
            memory["next"] = t + p["every"] * rng.uniform(0.8, 1.2)
            label = "sharp_turn"
        return memory["cruise"], p["speed"], label

    def feint(t, heading, away, reach):
        even = int(t / p["detour"]) % 2 == 0
        offset = math.radians(p["offset"]) * memory["side"]
        return (away + offset, p["speed"], "detour_feint") if even else (away - 0.6 * offset, p["speed"], "detour_commit")

    def hiding(t, heading, away, reach):
        return away, 0.9 * p["speed"], "occlusion_seeking"

    def walk(t, heading, away, reach, dt=0.2):
        if memory["anchor"] is None:
            memory["anchor"] = memory["cruise"] = heading
        pull = -0.1 * wrapped(memory["cruise"] - memory["anchor"]) * dt
        memory["cruise"] = wrapped(memory["cruise"] + pull + 0.4 * math.sqrt(dt) * rng.standard_normal())
        return memory["cruise"], 1.5, "cruise"

    def s_curve(t, heading, away, reach):
        mode = "panic" if reach < 5 else "cruise" if reach > 40 else "evade"
        if mode != memory["mode"]:
            memory["mode"], memory["since"] = mode, t
        if mode == "panic":
            return away, 4.0, mode
        if mode == "evade":
            return away + math.radians(35) * math.sin(math.pi * (t - memory["since"])), 3.0, mode
        if memory["cruise"] is None or t - memory["chosen"] >= 4.0:
            memory["cruise"] = wrapped((heading if memory["cruise"] is None else memory["cruise"]) + rng.uniform(-0.25, 0.25))
            memory["chosen"] = t
        return memory["cruise"], 2.0, mode

    return dict(zip(POLICIES, (direct, sharp, feint, hiding, walk, s_curve)))[policy]


TRACK = "episode_id string, step int, x double, y double, heading double, speed double, behavior string"


def rollouts(specs: DataFrame, steps: int = 60, dt: float = 0.2) -> DataFrame:
    """Target tracks of specs (episode_id, policy, difficulty, seed, x, y, heading, drone_x, drone_y): steps rows each.
    The drone follows at a third of the distance. Turns are limited to the difficulty's rate, speed to 1.6 times its own.
    Unknown policies and difficulties count as direct_escape and medium; repeated episode ids count once."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        s = part.iloc[0]
        p = PRESETS.get(s["difficulty"], PRESETS["medium"])
        rng = np.random.default_rng(abs(int(s["seed"])))
        choose = chooser(s["policy"] if s["policy"] in POLICIES else POLICIES[0], p, rng)
        x, y, heading, dx, dy = (float(s[c]) for c in ("x", "y", "heading", "drone_x", "drone_y"))
        out = []
        for i in range(steps):
            wish, speed, label = choose(i * dt, heading, math.atan2(y - dy, x - dx), math.hypot(x - dx, y - dy))
            speed = min(speed, p["speed"] * TOP_SPEED)
            x, y = x + speed * math.cos(wish) * dt, y + speed * math.sin(wish) * dt
            limit = math.radians(p["turn"]) * dt
            heading = wrapped(heading + min(limit, max(-limit, wrapped(wish - heading))))
            dx, dy = dx + (x - dx) * dt / 3, dy + (y - dy) * dt / 3
            out.append((s["episode_id"], i, x, y, heading, speed, label))
        return pd.DataFrame(out, columns=["episode_id", "step", "x", "y", "heading", "speed", "behavior"])

    whole = specs.na.drop(subset=["episode_id", "x", "y", "heading", "drone_x", "drone_y"]).dropDuplicates(["episode_id"]).fillna({"seed": 0, "policy": "", "difficulty": ""})
    return whole.groupBy("episode_id").applyInPandas(run, TRACK)


def tracker_modes(frames: DataFrame) -> DataFrame:
    """The mode a tracker is in at each frame: track or hold while the target is seen, otherwise by the time since it was
    lost. The mode depends only on when the current seen, lost and stopped stretches began, so it is no fold: the starts
    are carried along the sequence."""
    f = frames.where("timestamp_s is not null").select(
        "episode_id", "frame_idx", "timestamp_s", F.coalesce("target_visible", F.lit(False)).alias("seen"),
        (F.coalesce(F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")), F.lit(1.0)) < STOPPED).alias("stopped"),
        (~F.coalesce("line_of_sight_clear", F.lit(True))).alias("blocked"),
    )
    f = annotate(f, "episode_id", "frame_idx", lag={"b": F.struct("seen", "stopped")})
    new_seen = F.col("b").isNull() | (F.col("b")["seen"] != F.col("seen"))
    new_stop = F.col("b").isNull() | (F.col("b")["stopped"] != F.col("stopped"))
    f = f.withColumn("s0", F.when(new_seen, F.col("timestamp_s"))).withColumn("h0", F.when(new_stop, F.col("timestamp_s"))).drop("b")
    f = annotate(f, "episode_id", "frame_idx", carry={"s1": F.col("s0"), "h1": F.col("h0")})
    lost = F.col("timestamp_s") - F.coalesce("s0", "s1")
    still = F.col("timestamp_s") - F.coalesce("h0", "h1")
    mode = (
        F.when(F.col("seen"), F.when(F.col("stopped") & (still >= HOLD), "hold").otherwise("track"))
        .when(lost < PREDICT, "predict")
        .when((lost >= PEEK) & (lost < SEARCH) & F.col("blocked"), "peek")
        .when(lost < SEARCH, "reacquire")
        .otherwise("search")
    )
    return f.select("episode_id", "frame_idx", mode.alias("mode"))


#: The older tracker's patience in seconds. Fixed values.
OLD_PREDICT, OLD_SEARCH = 0.25, 0.6


def old_tracker_modes(frames: DataFrame) -> DataFrame:
    """The mode of the older tracker: track while the target is seen and shortly after, then predict, then search, by the
    time since the current lost stretch began. A found target is tracked at once."""
    f = frames.where("timestamp_s is not null").select("episode_id", "frame_idx", "timestamp_s", F.coalesce("target_visible", F.lit(False)).alias("seen"))
    f = annotate(f, "episode_id", "frame_idx", lag={"b": F.struct("seen")})
    began = F.when(~F.col("seen") & (F.col("b").isNull() | F.col("b")["seen"]), F.col("timestamp_s"))
    f = annotate(f.withColumn("t0", began).drop("b"), "episode_id", "frame_idx", carry={"t1": F.col("t0")})
    lost = F.col("timestamp_s") - F.coalesce("t0", "t1")
    mode = F.when(F.col("seen") | (lost < OLD_PREDICT), "track").when(lost < OLD_SEARCH, "predict").otherwise("search")
    return f.select("episode_id", "frame_idx", mode.alias("mode"))


def next_altitude(z: float, filtered: float, wished: float, dt: float, tau: float = 4.0, climb: float = 1.5, drop: float = 2.0) -> tuple[float, float]:
    """One step of the altitude controller (z down): the filtered wish, and z moved towards it within the rates."""
    filtered += (1 - math.exp(-dt / tau)) * (wished - filtered)
    return z + min(drop * dt, max(-climb * dt, filtered - z)), filtered
