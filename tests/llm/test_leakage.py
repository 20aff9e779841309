import random
import re

import numpy as np
import pytest

from skylattice.llm import leakage

DOCS = "doc_id long, text string, item_id long, words string"


def brute(docs, items, least):
    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    grams = lambda w: {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}
    return {(d, i) for d, t in docs if d is not None and t for i, u in items if i is not None and u and grams(words(t)) & grams(words(u))}


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, None, "x") for d in docs], DOCS).repartition(3), spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("least,shard,block", [(3, 1_000_000, 2_000_000), (4, 200, 50), (12, 50, 100)])
def test_equals_brute_force(spark, monkeypatch, least, shard, block):
    monkeypatch.setattr(leakage, "ITEM_BLOCK", block)
    rng = random.Random(least)
    vocab = [f"v{i}" for i in range(25)] + ["zz"]
    items = [(i, " ".join(rng.choices(vocab[:25], k=rng.randint(0, 30)))) for i in range(20)] + [(50, None), (None, "a b c")]
    docs = []
    for d in range(80):
        w = rng.choices(vocab + ["other", "words"], k=rng.randint(0, 60))
        if d % 3 == 0:
            u = items[rng.randrange(20)][1].split()
            a = rng.randrange(len(u) + 1)
            w[5:5] = u[a : a + rng.randint(least - 2, least + 6)]
        docs.append((d, (", " if d % 2 else " ").join(w).upper()))
    docs += [(90, None), (91, ""), (None, docs[0][1]), docs[3]]
    d, i = frames(spark, docs, items)
    got = leakage.leaked_passages(d, i, least).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items, least)
    text, test = dict(docs), dict(items)
    for r in got:
        a, b = re.findall("[a-z0-9]+", text[r.doc_id].lower()), re.findall("[a-z0-9]+", test[r.item_id].lower())
        n = r.match_words
        assert n >= least and a[r.doc_word : r.doc_word + n] == b[r.item_word : r.item_word + n]
        longer = lambda x: {tuple(x[k : k + n + 1]) for k in range(len(x) - n)}
        assert not longer(a) & longer(b)


def test_no_match_across_documents_or_items(spark):
    d, i = frames(spark, [(1, "a b"), (2, "c d")], [(1, "a b c d"), (2, "x a b"), (3, "c d y")])
    assert leakage.leaked_passages(d, i, 3).count() == 0


def test_a_very_long_text(spark):
    passage = " ".join(f"t{i}" for i in range(30))
    d, i = frames(spark, [(1, "filler " * 300_000 + passage)], [(9, "begin " + passage)])
    r = leakage.leaked_passages(d, i).first()
    assert (r.doc_id, r.item_id, r.match_words, r.doc_word, r.item_word) == (1, 9, 30, 300_000, 1)
    assert leakage.without_leaks(d, i).count() == 0


def test_empty_tables(spark):
    d, i = frames(spark, [(1, "a b c")], [(1, "a b c")])
    assert leakage.leaked_passages(d.limit(0), i, 3).count() == 0
    assert leakage.leaked_passages(d, i.limit(0), 3).count() == 0
    assert leakage.without_leaks(d, i.limit(0), 3).count() == 1


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    x = np.append(rng.integers(0, 4, 500), -1)
    order = leakage.ranks_of_suffixes(x, np.arange(500), 501)
    suffixes = [tuple(x[i:]) for i in order]
    assert suffixes == sorted(suffixes)


def test_a_passage_that_is_everywhere_is_expanded_in_parts(monkeypatch):
    """Many copies of one passage on both sides: parts are bounded, and only the beginnings of matches are measured."""
    monkeypatch.setattr(leakage, "EXPAND", 500)
    passage = list(range(20))
    corpus = np.array([x for i in range(60) for x in (*passage, -1)])
    tests = np.array([x for i in range(40) for x in (*passage, -2)])
    parts = list(leakage.matches_in_shard(corpus, tests, 12, 20))
    assert all(len(p[0]) <= 500 for p in parts)
    found = {(int(a) // 21, int(b) // 21, int(n)) for part in parts for a, b, n in zip(*part)}
    assert found == {(a, b, 20) for a in range(60) for b in range(40)} and sum(len(p[0]) for p in parts) == 2400
