import pytest
from pyspark.sql import functions as F

from skylattice.operators import text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("r")).first().r


@pytest.mark.parametrize("phrase", ["Fly forward now.", "please turn left", "Ascend"])
def test_navigation_is_found(spark, phrase):
    assert one(spark, phrase, text.violations("t"))[0].startswith("nav_verb:")


def test_words_that_only_contain_a_phrase(spark):
    assert one(spark, "Wait near the famous landmark.", text.violations("t")) == []
    assert one(spark, "la façade élan", text.violations("t")) == []


def test_ordered_filter(spark):
    data = [("g", 1, "Keep tracking the red taxi near the bridge"), ("g", 2, "Fly to the red taxi near the bridge"), ("g", 3, "too short"), ("g", 4, "keep tracking  the red taxi near the bridge!"), ("h", 1, "Keep tracking the red taxi near the bridge"), ("h", 2, None)]
    got = {(r.g, r.o): r.reason for r in text.ordered_filter(spark.createDataFrame(data, "g string, o int, t string"), "g", "o", "t").collect()}
    assert got == {("g", 1): None, ("g", 2): "blacklist:nav_verb:fly to", ("g", 3): "length:2", ("g", 4): "duplicate", ("h", 1): None}


def test_attributes_and_phrase(spark):
    a = one(spark, "a small red taxi, not blue", text.attributes("t"))
    assert (a.color, a.size, a.type) == ("red", "small", "taxi")
    assert one(spark, "BP.Vehicle_Sedan01", text.appearance_phrase(F.col("t"), text.attributes(F.lit("big")))) == "the big sedan"
    assert one(spark, "", text.appearance_phrase(F.col("t"), text.attributes(F.lit("")))) == "the vehicle"


def test_codec_round_trip(spark):
    assert one(spark, "1.000000 2.000000 3.000000 0.000000 0.000000 -1.500000", text.decode_pose("t")) == [1, 2, 3, 0, 0, -1.5]
    assert one(spark, "1 2 3", text.decode_pose("t")) is None


def test_building_coordinates(spark):
    r = one(spark, "x=281.78Y=-816.76z=31.15.PNG", text.building_coordinates("t"))
    assert (r.x, r.y, r.z) == (281.78, -816.76, 31.15)
    assert one(spark, "house.png", text.building_coordinates("t")) is None


@pytest.mark.parametrize("seed", range(2))
def test_ordered_filter_equals_the_walk(spark, seed):
    import random
    import re

    rng = random.Random(seed)
    vocab = ["keep", "tracking", "the", "red", "blue", "taxi", "van", "near", "bridge", "slowly", "moving", "along", "a", "narrow", "street", "with", "trees"]
    base = [rng.sample(vocab, rng.randint(6, 14)) for _ in range(12)]
    rows, known = [], [(f"g{k}", " ".join(base[k])) for k in range(2)] + [("g0", None)]
    for i in range(240):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rng.shuffle(w)
        rows.append((f"g{rng.randrange(3)}", i, " ".join(w) + rng.choice(["", "!", " "]), None))
    want = {}
    for g in ("g0", "g1", "g2"):
        kept = [set(t.split()) for h, t in known if h == g and t]
        for _, o, t, _ in sorted(r for r in rows if r[0] == g):
            s = set(re.findall("[a-z0-9]+", t.lower()))
            if any(len(s & k) >= 0.85 * len(s | k) - 1e-12 for k in kept):
                want[g, o] = "duplicate"
            else:
                want[g, o] = None
                kept.append(s)
    df = spark.createDataFrame(rows, "g string, o int, t string, tokens string")
    got = {(r.g, r.o): r.reason for r in text.ordered_filter(df, "g", "o", "t", spark.createDataFrame(known, "g string, t string")).collect()}
    assert got == want
    assert text.ordered_filter(df.limit(0), "g", "o", "t").count() == 0
