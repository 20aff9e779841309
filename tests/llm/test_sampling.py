import pytest
from pyspark.sql import functions as F

from skylattice.llm import sampling


def counts(df):
    return {(r.batch_id, r.difficulty): r["count"] for r in df.groupBy("batch_id", "difficulty").count().collect()}


def test_levels(spark):
    b = spark.createDataFrame([(1, 10, {"easy": 3, "hard": 1, "medium": 0}, 2), (2, 7, {}, 3), (3, None, {"easy": 1}, None), (4, 5, None, 1), (5, 9, {"a": None, "b": 2, "c": -1}, 0), (None, 9, {"b": 2}, 0)], "batch_id long, episodes int, difficulty_mix map<string,int>, min_per_difficulty int")
    got = {(r.batch_id, r.difficulty): r.wanted for r in sampling.level_targets(b.union(b)).collect()}
    assert got == {(1, "easy"): 7, (1, "hard"): 2, (3, "easy"): 0, (5, "b"): 9}


def test_usable(spark):
    r = spark.createDataFrame([(1, 1, " Easy\t", True), (1, 1, " Easy\t", True), (1, 2, "easy", False), (1, 3, None, True), (1, None, "easy", True), (None, 4, "easy", True), (1, 5, "easy", None)], "batch_id long, report_id long, difficulty string, success boolean")
    assert [tuple(x) for x in sampling.usable_reports(r).collect()] == [(1, "easy", 1)]


@pytest.mark.parametrize("seed", range(4))
def test_exact_counts_and_deficits(spark, seed):
    rows = spark.range(20_000).selectExpr("if(id < 14000, 1, cast(id % 40 as int)) as batch_id", "if(id % 3 = 0, 'easy', 'hard') as difficulty", "id as report_id", "'x' as k", "1 as g")
    wanted = [(b, d, w) for b in range(42) for d, w in (("easy", 30), ("hard", 9000))] + [(1, "none", 4)]
    wanted = [(b, d, 3000 if (b, d) == (1, "easy") else w) for b, d, w in wanted]
    targets = spark.createDataFrame(wanted, "batch_id int, difficulty string, wanted int")
    sample, report = sampling.proportional_sample(rows, targets, "batch_id", "difficulty", "report_id", seed)
    sample = sample.cache()
    have, got = counts(rows), counts(sample)
    for b, d, w in wanted:
        n = have.get((b, d), 0)
        assert got.get((b, d), 0) == min(n, w)
    assert sample.distinct().count() == sample.count()
    assert {(r.batch_id, r.difficulty): r.deficit for r in report.collect()} == {(b, d): max(0, w - have.get((b, d), 0)) for b, d, w in wanted}
    again = sampling.proportional_sample(rows.repartition(7), targets, "batch_id", "difficulty", "report_id", seed)[0]
    assert again.exceptAll(sample).count() == 0
    sample.unpersist()


def test_short_draws_are_drawn_again(spark, monkeypatch):
    """With far too small acceptance the counts still come out exact."""
    monkeypatch.setattr(sampling, "SURPLUS", -0.9)
    rows = spark.range(5000).selectExpr("1 as batch_id", "'easy' as difficulty", "id as report_id")
    targets = spark.createDataFrame([(1, "easy", 4000)], "batch_id int, difficulty string, wanted int")
    assert sampling.proportional_sample(rows, targets, "batch_id", "difficulty", "report_id")[0].count() == 4000


def test_the_sample_is_even(spark):
    rows = spark.range(10_000).select(F.lit(1).alias("b"), F.lit("x").alias("c"), "id")
    targets = spark.createDataFrame([(1, "x", 5000)], "b int, c string, wanted int")
    low = sampling.proportional_sample(rows, targets, "b", "c", "id")[0].where("id < 5000").count()
    assert 2300 < low < 2700


def test_empty(spark):
    rows, targets = spark.createDataFrame([], "b int, c string, id long"), spark.createDataFrame([(1, "x", 2)], "b int, c string, wanted int")
    sample, report = sampling.proportional_sample(rows, targets, "b", "c", "id")
    assert sample.count() == 0 and report.first().deficit == 2
    assert sampling.proportional_sample(rows, targets.limit(0), "b", "c", "id")[1].count() == 0
