"""Samples that match target category proportions, per group.

Every row gets a pseudorandom number in [0, 1) from the seed and its key. A category's acceptance probability is its
target over its observed count, slightly raised; rows are accepted independently, in one pass and without a shuffle of
the rows that are turned away. Counts are then corrected exactly: accepted rows are counted in BUCKETS slices of the
unit interval per category, whole slices below the cut stay, and only the slice at the cut is ranked. Where chance
accepted too few, the category is drawn again with probability 1. No task holds more than one slice of a category, so
a group with a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
#: Slight oversampling: the expected surplus is 5 % plus three standard deviations plus one.
SURPLUS = 0.05


def unit(seed: int, *columns: str):
    """A number in [0, 1) that depends on the seed and the columns alone."""
    return (F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).cast("double")


def proportional_sample(rows: DataFrame, targets: DataFrame, group: str, category: str, key: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sample, report). rows: group, category, key, one row per key. targets: group, category, wanted (one row each).

    The sample has exactly min(wanted, observed) rows of each (group, category). The report has every target with
    wanted, observed, sampled (counted from the sample itself) and deficit = wanted - sampled. Rows whose group, category or key is null, or whose category has no target,
    can't be drawn. Targets of zero draw nothing. Empty inputs give an empty sample."""
    rows = rows.select(F.col(group).alias("g"), F.col(category).alias("c"), F.col(key).alias("k")).where("g is not null and c is not null and k is not null")
    wanted = targets.select(F.col(group).alias("g"), F.col(category).alias("c"), F.col("wanted").cast("bigint").alias("wanted"))
    observed = rows.groupBy("g", "c").agg(F.count(F.lit(1)).alias("observed"))
    plan = wanted.join(observed, ["g", "c"], "left").select("g", "c", "wanted", F.coalesce("observed", F.lit(0)).alias("observed"))
    raised = F.col("wanted") * (1 + SURPLUS) + 3 * F.sqrt("wanted") + 1
    plan = plan.withColumn("p", F.when(F.col("observed") > 0, F.least(F.lit(1.0), raised / F.col("observed"))).otherwise(F.lit(0.0)))
    drawn = rows.join(plan.where("wanted > 0"), ["g", "c"]).withColumn("u", unit(seed, "g", "c", "k"))
    accepted = drawn.where("u < p")
    # all rows are counted by slice, so that a category that fell short can be drawn again
    slices = drawn.groupBy("g", "c", "wanted", F.floor(F.col("u") * BUCKETS).cast("int").alias("slice")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("u") < F.col("p")).alias("n_accepted"))
    of = Window.partitionBy("g", "c")
    total = slices.withColumn("enough", F.sum("n_accepted").over(of) >= F.least("wanted", F.sum("n").over(of)))
    total = total.withColumn("m", F.when(F.col("enough"), F.col("n_accepted")).otherwise(F.col("n")))
    upto = total.withColumn("before", F.sum("m").over(of.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("m"))
    cuts = upto.where("before < wanted").select("g", "c", "slice", "enough", (F.col("wanted") - F.col("before")).alias("room"), "m")
    again = drawn.join(total.where("not enough").select("g", "c").distinct(), ["g", "c"], "left_semi").where("u >= p")
    pool = accepted.unionByName(again).withColumn("slice", F.floor(F.col("u") * BUCKETS).cast("int")).select("g", "c", "k", "u", "slice")
    placed = pool.join(cuts, ["g", "c", "slice"])
    whole = placed.where("m <= room").select("g", "c", "k")
    rank = F.row_number().over(Window.partitionBy("g", "c", "slice").orderBy("u", "k"))
    part = placed.where("m > room").withColumn("rank", rank).where("rank <= room").select("g", "c", "k")
    sample = whole.unionByName(part).select(F.col("g").alias(group), F.col("c").alias(category), F.col("k").alias(key))
    counted = sample.groupBy(group, category).agg(F.count(F.lit(1)).alias("sampled")).select(F.col(group).alias("g"), F.col(category).alias("c"), "sampled")
    sampled = F.coalesce("sampled", F.lit(0))
    report = plan.join(counted, ["g", "c"], "left").select(F.col("g").alias(group), F.col("c").alias(category), "wanted", "observed", sampled.alias("sampled"), (F.col("wanted") - sampled).alias("deficit"))
    return sample, report


def level_targets(batches: DataFrame) -> DataFrame:
    """batch_id, difficulty, wanted: for a level of weight w > 0, the larger of min_per_difficulty and
    floor(episodes * w / sum of weights). Null or negative weights count as absent, a null number as 0."""
    mix = F.explode(F.map_entries("difficulty_mix")).alias("e")
    levels = batches.where("batch_id is not null").dropDuplicates(["batch_id"]).select("batch_id", F.coalesce("episodes", F.lit(0)).alias("episodes"), F.coalesce("min_per_difficulty", F.lit(0)).alias("least"), "difficulty_mix", mix)
    levels = levels.select("batch_id", "episodes", "least", F.col("e.key").alias("difficulty"), F.col("e.value").cast("bigint").alias("w"), F.aggregate(F.map_values("difficulty_mix"), F.lit(0).cast("bigint"), lambda a, x: a + F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)).cast("bigint")).alias("total"))
    share = F.expr("episodes * w div total")
    return levels.where("w > 0").select("batch_id", "difficulty", F.greatest(F.col("least").cast("bigint"), share).alias("wanted"))


def usable_reports(reports: DataFrame) -> DataFrame:
    """Distinct successful reports, difficulty trimmed and in lower case."""
    level = F.lower(F.regexp_replace("difficulty", r"^\s+|\s+$", ""))
    return reports.where(F.col("success") & F.col("batch_id").isNotNull() & F.col("report_id").isNotNull() & F.col("difficulty").isNotNull()).select("batch_id", level.alias("difficulty"), "report_id").distinct()


def difficulty_sample(batches: DataFrame, reports: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    return proportional_sample(usable_reports(reports), level_targets(batches), "batch_id", "difficulty", "report_id", seed)
