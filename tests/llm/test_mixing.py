import numpy as np
import pytest

from skylattice.llm import mixing

DOCS = "doc_id long, text string, source string, tokens string, block int"
TARGETS = "source string, target_weight double, max_repeats int"


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in (0, 5):
            assert sorted(mixing.permuted(np.arange(n), n, key).tolist()) == list(range(n))
    assert mixing.permuted(np.arange(50), 50, 1).tolist() != mixing.permuted(np.arange(50), 50, 2).tolist()


def test_blocks_hold_all_tokens_in_order(spark):
    docs = [(i, f"word{i} " * (i % 17), " A" if i % 2 else "b", None, 1) for i in range(60)]
    tokens = mixing.tokenized(spark.createDataFrame(docs, DOCS).repartition(4), f"{mixing.TOKENIZERS}/{mixing.VOCABULARY}").cache()
    blocks = mixing.packed(tokens, 16).collect()
    for s in ("a", "b"):
        own = {r.block: r.tokens for r in blocks if r.source == s}
        assert set(own) == set(range(len(own))) and all(len(own[b]) == 16 for b in range(len(own) - 1))
        stream = [t for b in range(len(own)) for t in own[b]]
        texts, at = [], 0
        while at < len(stream):
            end = stream.index(mixing.END_OF_TEXT, at)
            texts.append(tuple(stream[at:end]))
            at = end + 1
        assert sorted(texts) == sorted(tuple(r.tokens) for r in tokens.collect() if r.source == s)
    tokens.unpersist()


def test_shares_repeats_and_shortfalls(spark):
    docs = [(i, "some ordinary words about a drone " * 20, "big" if i % 10 else " Small ", None, 1) for i in range(400)] + [(900, "x", None, None, 1), (901, "y", "  ", None, 1), (902, None, "big", None, 1), (903, "not a target " * 500, "other", None, 1)]
    targets = [("big", 0.5, 1), ("small", 0.5, 2), ("absent", 0.0, 3)]
    mixed, report = mixing.mix(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(targets, TARGETS), block_tokens=64, shards=8)
    r = {x.source: x for x in report.collect()}
    assert r["small"].falls_short and not r["big"].falls_short and not r["absent"].falls_short
    used = {}
    for x in mixed.collect():
        used.setdefault((x.source, x.block), []).append(x.repetition)
    assert all(len(v) == len(set(v)) and max(v) < (1 if s == "big" else 2) for (s, _), v in used.items())
    assert r["small"].mix_tokens == 2 * r["small"].own_tokens  # taken twice, as often as allowed
    assert r["small"].mix_blocks < r["small"].wanted_blocks
    assert r["big"].mix_blocks > r["big"].wanted_blocks  # what the small source can't give is drawn from the large one
    assert abs(sum(x.actual_share for x in r.values()) - 1) < 1e-9


def test_empty(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    mixed, report = mixing.mix(docs, targets)
    assert mixed.count() == 0 and report.first().own_tokens == 0 and not report.first().falls_short
    mixed, report = mixing.mix(spark.createDataFrame([(1, "a b", "a", None, 1)], DOCS), targets.limit(0))
    assert mixed.count() == 0 and report.count() == 0


@pytest.mark.parametrize("n", [10, 250_000])
def test_long_texts_are_tokenized_whole(n):
    text = "ab cd " * n
    assert "".join(mixing.pieces(text)) == text


def test_plan_is_exact_at_the_cap():
    """A source falls short if, and only if, its target exceeds its repeated tokens; the rest goes to those with room."""
    for own in (1, 900, 1024, 5000, 123_457):
        for repeats in (1, 3):
            for target, short in ((repeats * own, False), (repeats * own + 1, True), (repeats * own - 1, False)):
                a = mixing.Source("a", target / 1_000_000, repeats, own, -(-own // 1024))
                b = mixing.Source("b", 1 - target / 1_000_000, 1, 3_000_000, 2930)
                mixing.plan_slots([a, b], 1_000_000)
                assert (a.wanted > a.drawn) == short
                assert abs(a.drawn * own / a.blocks + b.drawn * 1024 - 1_000_000) < 3 * 1024 + own


def test_shard_counts_add_up():
    counts = np.array([5, 0, 1000, 123])
    parts = [mixing.shard_counts(counts, 13, i, 7) for i in range(13)]
    assert (sum(p[0] for p in parts) == counts).all()
    assert all((parts[i][1] == sum((p[0] for p in parts[:i]), np.zeros(4, dtype=int))).all() for i in range(13))
    assert all(abs(p[0].sum() - 1128 / 13) <= 1 for p in parts)
    big = np.array([3_000_000_000, 5, 2_000_000_001])
    left = mixing.split(big, 2_500_000_003, 2_500_000_003, np.random.default_rng(1))
    assert left.sum() == 2_500_000_003 and (left <= big).all()


def test_equal_targets_are_drawn_once(spark):
    docs = [(i, "some ordinary words " * 20, "a", None, 1) for i in range(50)]
    targets = [("A", 0.25, 1), (" a", 0.25, 1), (" a", 0.25, 1)]
    mixed, report = mixing.mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), block_tokens=64)
    assert mixed.groupBy("source", "block").count().where("count > 1").isEmpty()
    assert sorted((r.source, r.target_weight, r.falls_short) for r in report.collect()) == [(" a", 0.5, False), ("A", 0.5, False)]
