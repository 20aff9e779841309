"""Instruction text: safety phrases, gates, similarity, attributes, templates and statistics."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.operators.greedy import taken
from skylattice.session import materialize

# Phrases that an instruction must not have, by rule, in the order in which they are reported.
NAVIGATION = (
    "take off", "takeoff", "land", "fly forward", "fly toward", "fly to", "fly straight", "fly up", "fly down", "fly left", "fly right",
    "turn left", "turn right", "turn around", "ascend", "descend", "hover", "go straight", "go forward", "go up", "go down",
    "move forward", "move backward", "climb", "bank left", "bank right", "yaw left", "yaw right", "rotate", "strafe",
)
GAZE = (
    "look at", "look toward", "look towards", "look down", "look up", "face toward", "face towards", "point camera", "point the camera",
    "aim the camera", "aim camera", "focus on the right", "focus on the left", "center the camera", "keep your eyes", "gaze at",
)
FUTURE = (
    "will be at", "will end up", "will arrive", "will reach", "headed to", "heading to", "destination is", "destination of", "reach point",
    "go to point", "ends up at", "will stop at", "final position", "will go to", "will move to", "will head", "is going to reach",
)
RULES = (("nav_verb", NAVIGATION), ("look_at", GAZE), ("future_position", FUTURE))
# Words that name an attribute.
COLORS = ("red", "blue", "green", "yellow", "white", "black", "silver", "grey", "gray", "orange", "brown", "dark", "light")
SIZES = ("small", "large", "compact", "big", "mini", "tiny")
TYPES = ("car", "sedan", "suv", "truck", "van", "taxi", "hatchback", "cart", "bus", "jeep", "pickup")
EMPTY_VALUES = ("unknown", "none", "n/a")
# Which template family a behaviour prefers, and the templates.
PREFERENCES = {
    "occlusion_seeking": ("occlusion", "motion", "location", "appearance"),
    "direct_escape": ("location", "motion", "appearance"),
    "sharp_turn": ("motion", "location", "appearance"),
    "detour_feint": ("motion", "location", "appearance"),
}
OTHERWISE = ("location", "motion", "appearance")
TEMPLATES = {
    "appearance": ("Track {appearance}.", "Keep tracking {appearance}.", "Keep observing {appearance}.", "Maintain visual contact with {appearance}."),
    "location": ("Track {appearance} near {location}.", "Follow {appearance} starting near {location}.", "Keep observing {appearance} around {location}."),
    "motion": ("Keep observing {appearance} moving along {motion}.", "Track {appearance} as it travels along {motion}.", "Follow {appearance} moving through {motion}."),
    "occlusion": (
        "Maintain visual contact with {appearance} as it moves toward {occlusion}.",
        "Keep tracking {appearance} as it approaches {occlusion}.",
        "Track {appearance} while it moves into {occlusion}.",
    ),
}
OCCLUSION_PHRASE = "an occluded street"
# Tiers of difficulties and their templates; phrases that stand in where no image is described.
TIERS = {"easy": "easy", "medium": "medium", "hide_seek": "hard", "hard": "hard"}
TIER_TEMPLATES = {
    "easy": ("Track {appearance}.", "Follow {appearance}.", "Keep tracking {appearance}.", "Stay with {appearance}.", "Maintain tracking of {appearance}."),
    "medium": (
        "Track {appearance} that is {behavior}.",
        "Follow {appearance} while it is {behavior}.",
        "Keep tracking {appearance} as it keeps {behavior}.",
        "Stay with {appearance}, which is {behavior}.",
        "Maintain tracking of {appearance} that is {behavior}.",
    ),
    "hard": (
        "Track {appearance} that is {behavior} near {cover}.",
        "Follow {appearance} as it is {behavior} around {cover}.",
        "Keep tracking {appearance}, which is {behavior} while using {cover}.",
        "Stay with {appearance} that is {behavior} amid {cover}.",
        "Maintain tracking of {appearance} that is {behavior} close to {cover}.",
    ),
}
STAND_INS = {
    "car": ("the small car", "the compact sedan", "the dark-colored car", "the little hatchback"),
    "vehicle": ("the small vehicle", "the moving vehicle"),
    "default": ("the small motorized car", "the tracked vehicle"),
}
CAR_WORDS = ("car", "sedan", "taxi", "hatchback")
COVER_PHRASE = "the nearby buildings"
FEWEST, MOST, SAME = 5, 30, 0.85


def lit_array(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def violations(text: str | Column) -> Column:
    """array of 'rule:phrase' for every phrase that stands in the text on word boundaries, in order. One regular
    expression decides whether the phrases need to be tried one by one."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    word = r"(?U)\b(?:{})\b"
    every = word.format("|".join(p for _, ps in RULES for p in ps))
    each = F.array(*[F.when(low.rlike(word.format(p)), F.lit(f"{rule}:{p}")) for rule, ps in RULES for p in ps])
    return F.when(low.rlike(every), F.array_compact(each)).otherwise(F.array().cast("array<string>"))


def collapsed(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"\s+", " "))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def token_set(text: str | Column) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def gate_reason(text: Column) -> Column:
    """The first two gates: 'length:n' or 'blacklist:rule:phrase', null if the text passes."""
    n = word_count(text)
    hits = violations(text)
    return F.when((n < FEWEST) | (n > MOST), F.concat(F.lit("length:"), n.cast("string"))).when(F.size(hits) > 0, F.concat(F.lit("blacklist:"), F.try_element_at(hits, F.lit(1))))


def ordered_filter(candidates: DataFrame, group: str, order: str, text: str, existing: DataFrame | None = None) -> DataFrame:
    """Per group and in order: length, safety phrases, then similarity to what was accepted before. Adds clean_text and
    reason (null: kept; 'duplicate' for the third gate). existing: texts (group, text) that were accepted earlier.

    The first two gates are expressions. Of the texts that pass them, those of one token set share their fate but for the
    first; different sets that are similar share one of each other's longest words (by a prefix that no pair at SAME can
    evade), meet there and form conflicts, and conflicts are settled in rounds. So no task walks through a group, and an
    episode with a third of all texts is spread over all tasks. Null groups are a group; null texts give no row."""
    key = lambda df: df.withColumn("set_id", F.md5(F.concat_ws(" ", F.coalesce(F.col("g").cast("string"), F.lit("\x00")), "tokens")))
    gated = candidates.select(F.col(group).alias("g"), F.col(order).alias("o"), collapsed(text).alias("clean_text")).where("clean_text is not null")
    gated = key(gated.withColumn("reason", gate_reason(F.col("clean_text"))).withColumn("tokens", F.array_sort(token_set("clean_text"))))
    gated = materialize(gated, "filter-gated")
    passed = gated.where("reason is null and size(tokens) > 0").select("set_id", "g", "tokens", F.lit(1).alias("rank"), "o")
    if existing is not None:
        known = key(existing.select(F.col(group).alias("g"), F.array_sort(token_set(collapsed(text))).alias("tokens")).where("size(tokens) > 0"))
        passed = passed.unionByName(known.select("set_id", "g", "tokens", F.lit(0).alias("rank"), F.lit(None).cast(dict(passed.dtypes)["o"]).alias("o")))
    sets = materialize(passed.groupBy("set_id").agg(F.first("g").alias("g"), F.first("tokens").alias("tokens"), F.min(F.struct("rank", "o")).alias("at")), "filter-sets")
    n = F.size("tokens")
    longest = F.array_sort(F.transform("tokens", lambda w: F.struct(-F.length(w), w)))
    reach = n - F.ceil(n * SAME - 1e-9).cast("int") + 1
    posted = sets.select("set_id", "g", "tokens", "at", F.explode(F.slice(longest, F.lit(1), reach)).alias("w"))
    side = lambda c: posted.select(F.col("set_id").alias(c), "g", "w", F.col("tokens").alias(f"t_{c}"), F.col("at").alias(f"at_{c}"))
    a, b = side("before").alias("x"), side("after").alias("y")
    met = a.join(b, F.col("x.g").eqNullSafe(F.col("y.g")) & (F.col("x.w") == F.col("y.w"))).where((F.col("at_before") < F.col("at_after")) & (F.size("t_before") >= SAME * F.size("t_after") - 1e-9) & (F.size("t_after") >= SAME * F.size("t_before") - 1e-9))
    conflicts = met.where(jaccard(F.col("t_before"), F.col("t_after")) >= SAME - 1e-12).select("before", "after").distinct()
    kept = taken(sets.select(F.col("set_id").alias("node"), (F.col("at.rank") == 0).alias("given")), conflicts)
    first = sets.where("at.rank = 1").join(kept.select(F.col("node").alias("set_id")), "set_id", "left_semi").select("set_id", F.col("at.o").alias("first"))
    judged = gated.join(first, "set_id", "left")
    again = F.when(F.col("reason").isNull() & (F.size("tokens") > 0) & ~F.coalesce(F.col("first") == F.col("o"), F.lit(False)), "duplicate")
    return judged.select(F.col("g").alias(group), F.col("o").alias(order), "clean_text", F.coalesce("reason", again).alias("reason"))


def attributes(label: str | Column) -> Column:
    """struct<color, size, type>: the first word of each kind that the label literally has."""
    words = F.transform(F.regexp_extract_all(label if isinstance(label, Column) else F.col(label), F.lit("[A-Za-z]+"), F.lit(0)), F.lower)
    first = lambda kinds: F.try_element_at(F.filter(words, lambda w: w.isin(*kinds)), F.lit(1))
    return F.struct(first(COLORS).alias("color"), first(SIZES).alias("size"), first(TYPES).alias("type"))


def cleaned(attrs: Column) -> Column:
    """A map without null, blank and unknown values, trimmed."""
    kept = F.map_filter(attrs, lambda k, v: v.isNotNull() & (F.trim(v) != "") & ~F.lower(F.trim(v)).isin(*EMPTY_VALUES))
    return F.transform_values(kept, lambda k, v: F.trim(v))


def noun(target_class: Column, type_: Column) -> Column:
    """The type if known, else the last word after the last dot, else 'vehicle'."""
    words = F.regexp_extract_all(F.element_at(F.split(F.trim(target_class), r"\."), -1), F.lit("[A-Za-z]+"), F.lit(0))
    return F.coalesce(type_, F.lower(F.try_element_at(words, F.lit(-1))), F.lit("vehicle"))


def appearance_phrase(target_class: Column, attrs: Column) -> Column:
    return F.concat_ws(" ", F.lit("the"), attrs["size"], attrs["color"], noun(target_class, attrs["type"]))


def family(behavior: Column, location: Column, motion: Column, occlusion: Column) -> Column:
    """The preferred template family of those that can be filled."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    open_ = F.array_compact(F.array(F.lit("appearance"), F.when(has(location), "location"), F.when(has(motion), "motion"), F.when(has(occlusion) | (behavior == "occlusion_seeking"), "occlusion")))
    pick = lambda order: F.try_element_at(F.array_intersect(lit_array(order), open_), F.lit(1))
    out = F.lit(None).cast("string")
    for name, order in PREFERENCES.items():
        out = F.when(behavior == name, pick(order)).otherwise(out)
    return F.coalesce(out, pick(OTHERWISE))


def instruction(rows: DataFrame) -> DataFrame:
    """episode_id, family, template_no, instruction of rows (episode_id, seed, behavior, appearance, location, motion,
    occlusion). The template is the first draw of NumPy's default generator for the seed (the episode's hash without
    one); a text with a safety phrase falls back to the family's first template of 'appearance'."""
    picked = rows.withColumn("family", family(F.col("behavior"), F.col("location"), F.col("motion"), F.col("occlusion")))
    sizes = {k: len(v) for k, v in TEMPLATES.items()}

    @F.pandas_udf("int")
    def draw(seed: pd.Series, fam: pd.Series) -> pd.Series:
        return pd.Series([int(np.random.default_rng(abs(int(s))).integers(sizes[f])) for s, f in zip(seed, fam)], dtype="int32")

    picked = picked.withColumn("template_no", draw(F.coalesce(F.col("seed").cast("bigint"), F.xxhash64("episode_id")), "family"))
    table = F.create_map(*[x for k, v in TEMPLATES.items() for x in (F.lit(k), lit_array(v))])
    text = F.element_at(F.element_at(table, F.col("family")), F.col("template_no") + 1)
    for slot in ("appearance", "location", "motion"):
        text = F.replace(text, F.lit("{" + slot + "}"), F.coalesce(F.col(slot), F.lit("")))
    text = F.replace(text, F.lit("{occlusion}"), F.when(F.coalesce("occlusion", F.lit("")) != "", F.col("occlusion")).otherwise(OCCLUSION_PHRASE))
    safe = F.concat(F.lit("Track "), F.col("appearance"), F.lit("."))
    out = picked.withColumn("instruction", text)
    return out.select("episode_id", "family", "template_no", F.when(F.size(violations("instruction")) > 0, safe).otherwise(F.col("instruction")).alias("instruction"))


def tier(difficulty: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv]), difficulty), F.lit("medium"))


def seeded(key: Column, at: Column) -> Column:
    """A number that puts choices in a pseudorandom order by key, the same on every engine."""
    return F.md5(F.concat_ws("|", key, at.cast("string")))


def tier_fills(key: Column, difficulty: Column, appearance: Column, behavior: Column, cover: Column, n: int = 3) -> Column:
    """array<string>: up to n different filled templates of the difficulty's tier, in an order drawn by key; white space
    collapsed. Null slots are filled with nothing."""
    fill = lambda t: collapsed(F.replace(F.replace(F.replace(t, F.lit("{appearance}"), F.coalesce(appearance, F.lit(""))), F.lit("{behavior}"), F.coalesce(behavior, F.lit(""))), F.lit("{cover}"), F.coalesce(cover, F.lit(""))))
    table = F.create_map(*[x for k, v in TIER_TEMPLATES.items() for x in (F.lit(k), lit_array(v))])
    pool = F.element_at(table, tier(difficulty))
    drawn = F.array_sort(F.transform(pool, lambda t, i: F.struct(seeded(key, i).alias("o"), fill(t).alias("t"))))
    return F.slice(F.array_distinct(F.transform(drawn, lambda d: d["t"])), 1, n)


def stand_in_appearance(key: Column, label: Column) -> Column:
    """A phrase for a target that wasn't described, drawn by key from the label's kind."""
    low = F.lower(F.coalesce(label, F.lit("")))
    car = F.lit(False)
    for w in CAR_WORDS:
        car = car | low.contains(w)
    kind = F.when(car, "car").when(low.contains("vehicle"), "vehicle").otherwise("default")
    phrases = F.element_at(F.create_map(*[x for k, v in STAND_INS.items() for x in (F.lit(k), lit_array(v))]), kind)
    place = F.conv(F.substring(seeded(key, kind), 1, 6), 16, 10).cast("bigint") % F.size(phrases)
    return F.element_at(phrases, place.cast("int") + 1)


def last_known(rows: DataFrame, group: str, order: str, value: Column, otherwise: str = "vehicle") -> DataFrame:
    """Per group the last value, by order, that is neither null nor empty; `otherwise` for groups without one."""
    kept = F.when(value != "", value)
    return rows.groupBy(group).agg(F.coalesce(F.max_by(kept, F.when(kept.isNotNull(), F.col(order))), F.lit(otherwise)).alias("label"))


def first_known(rows: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """Per group the first value, by order, of each column that isn't null."""
    return rows.groupBy(group).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def first_category(names: DataFrame, priority: dict[str, int]) -> DataFrame:
    """category, name: each name once, in the first category (by priority) that lists it."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv]), F.col("category"))
    best = names.where("name is not null and category is not null").withColumn("r", rank).where("r is not null").groupBy("name").agg(F.min_by("category", "r").alias("category"))
    return best.select("category", "name")


def instruction_stats(results: DataFrame) -> DataFrame:
    """One row: episodes, instructions, rejected, blacklist_rejected, words. results: kept, rejected, one row each."""
    per = results.select(
        F.size(F.coalesce("kept", F.array().cast("array<string>"))).alias("kept"),
        F.coalesce(F.aggregate(F.transform("kept", lambda t: F.coalesce(word_count(t), F.lit(0))), F.lit(0), lambda a, x: a + F.greatest(x, F.lit(0))), F.lit(0)).alias("words"),
        F.coalesce(F.size("rejected"), F.lit(0)).alias("rejected"),
        F.coalesce(F.size(F.filter("rejected", lambda r: r["reason"].startswith("blacklist"))), F.lit(0)).alias("blacklisted"),
    )
    none = F.lit(0).cast("bigint")
    total = lambda c: F.coalesce(F.sum(F.greatest(F.col(c), F.lit(0))), none)
    return per.agg(F.count(F.lit(1)).alias("results"), total("kept").alias("instructions"), total("rejected").alias("rejected"), total("blacklisted").alias("blacklist_rejected"), total("words").alias("words"))


def building_coordinates(filename: str) -> Column:
    """struct<x, y, z> of a file name like X=281.78Y=-816.76Z=31.15.png; null if it isn't one."""
    part = lambda i: F.regexp_extract(filename, r"(?i)X=([^Y]+)Y=([^Z]+)Z=(.+?)\.png", i).try_cast("double")
    xyz = [part(i) for i in (1, 2, 3)]
    return F.when(xyz[0].isNotNull() & xyz[1].isNotNull() & xyz[2].isNotNull(), F.struct(*[c.alias(n) for c, n in zip(xyz, "xyz")]))


def float_tokens(text: str) -> Column:
    """The parts of a text, split at white space and commas, that are numbers."""
    return F.array_compact(F.transform(F.split(F.trim(F.col(text)), r"[\s,]+"), lambda t: t.try_cast("double")))


def asset_category(name: str, rules: tuple[tuple[str, str], ...]) -> Column:
    """The first rule whose pattern the name has; rules: (category, pattern)."""
    out = F.when(F.lower(F.col(name)).rlike(rules[0][1]), rules[0][0])
    for category, pattern in rules[1:]:
        out = out.when(F.lower(F.col(name)).rlike(pattern), category)
    return out.otherwise("other")


def encode_pose(*columns: Column) -> Column:
    """Six numbers with six decimals each, blank-separated."""
    return F.format_string(" ".join(["%.6f"] * len(columns)), *columns)


def decode_pose(text: str | Column) -> Column:
    """array<double> of exactly six numbers; null for anything else."""
    parts = F.transform(F.split(F.trim(text if isinstance(text, Column) else F.col(text)), r"\s+"), lambda t: t.try_cast("double"))
    return F.when((F.size(parts) == 6) & ~F.exists(parts, lambda v: v.isNull()), parts)

