import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from orfspark.llm import near
from orfspark.llm.components import components
from orfspark.llm.scratch import Scratch


def _vary(rng, words, share):
    return [w if rng.random() > share else f"x{rng.randint(0, 10**6)}" for w in words]


def _corpus(seed=1, groups=12, size=14, extra=40):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    texts = []
    for g in range(groups):
        base = fresh(rng.choice([6, 9, 20, 60, 150, 400]))
        texts += [" ".join(base)] * rng.randint(1, 3)
        # edits around the threshold: linked, not linked, and linked through others only
        texts += [" ".join(_vary(rng, base, rng.choice([0.01, 0.02, 0.03, 0.04, 0.06]))) for _ in range(size)]
    texts += [" ".join(fresh(rng.randint(1, 80))) for _ in range(extra)]
    texts += ["a b c d", "A b C d", "a b c", "", None, " \n", "a b c d e", "Ä b c d e", "ä b c d e", "one " * 20_000]
    rng.shuffle(texts)
    return dict(enumerate(texts, 5))


def _check(spark, texts, docs=None):
    got = {r.doc_id: r for r in near.near_duplicates(docs if docs is not None else brute.docs(spark, texts)).collect()}
    expected = brute.components(texts)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == expected
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_equals_all_pairs(spark):
    texts = _corpus()
    _check(spark, texts, brute.clashing(brute.docs(spark, texts)))


def test_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 4)
    texts = _corpus(2, groups=3, size=60, extra=5)
    _check(spark, texts)


def test_band_rows_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(near, "BROADCAST_IDS", 0)  # as for large tables
    plans, save = [], Scratch.save

    def watched(self, df, name, rows=None):
        if name in ("buckets", "members"):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df, name, rows)

    monkeypatch.setattr(Scratch, "save", watched)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _check(spark, _corpus(4, groups=3, size=6, extra=5))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(p.count("Exchange hashpartitioning(key") for p in plans) == 1


def test_chain(spark):
    """Each text links to its neighbours only; all are one component."""
    words = [f"w{i}" for i in range(400)]
    texts = {50 - k: " ".join(words[10 * k : 10 * k + 100]) for k in range(25)}
    assert len(brute.shingles(texts[50]) & brute.shingles(texts[49])) * 100 >= 75 * len(brute.shingles(texts[50]) | brute.shingles(texts[49]))
    _check(spark, texts)


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "a b c d e f g h"), (None, "a b c d e f g h"), (3, "q r s t u v"), (3, "a b c d e f g h"), (4, "q r s t u v")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], brute.DOCS)
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near.near_duplicates(df).collect())
    # id 3 speaks with its smallest text
    assert got == [(-1, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True)]
    kept = near.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4]


def test_stage_keeps_the_different_texts_of_an_id(spark):
    rows = [(1, "a b c d e f g h"), (1, "q r s t u v w x"), (1, "q r s t u v w x"), (2, "k l m n o p i j"), (2, "z y x w v u t s"), (3, "z y x w v u t s"), (None, "k l m n o p i j")]
    df = brute.clashing(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], brute.DOCS))
    kept = near.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "k l m n o p i j"), (1, "a b c d e f g h"), (1, "q r s t u v w x"), (2, "k l m n o p i j"), (3, "z y x w v u t s")]


def test_empty_table(spark):
    assert near.near_duplicates(brute.docs(spark, {})).collect() == []
    assert near.keep_one(brute.docs(spark, {})).collect() == []


def test_stage_keeps_one_of_each_group(spark):
    texts = _corpus(3, groups=4, size=6, extra=10)
    docs = brute.clashing(brute.docs(spark, texts))
    assert sorted(r.doc_id for r in near.keep_one(docs).collect()) == sorted(i for i, (_, c) in brute.components(texts).items() if c == i)


def _sets(a, b):
    values = np.array([hash(("s", x)) & (2**63 - 1) for x in [*sorted(a), *sorted(b)]], np.uint64)
    return values, np.array([0, len(a), len(a) + len(b)])


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1), st.sets(st.integers(0, 400), min_size=1))
def test_bounds_hold(a, b):
    values, offsets = _sets(a, b)
    once, twice = near.bitmaps(values, offsets)
    x, y = object.__new__(near._Side), object.__new__(near._Side)
    for side, k in ((x, 0), (y, 1)):
        side.n, side.once, side.twice, side.levels = np.array([offsets[k + 1] - offsets[k]]), [once[k]], [twice[k]], {}
        side.bits = np.array([8 * len(once[k])])
    if max(x.bits[0], y.bits[0]) <= 2 * min(x.bits[0], y.bits[0]):
        most = near.most_shared(x, np.array([0]), y, np.array([0]), int(min(x.bits[0], y.bits[0])))[0]
        assert len(a & b) <= most <= min(len(a), len(b))


@pytest.mark.parametrize("size, shared", [(40, 30), (200, 170), (3000, 2600), (3000, 1000), (50, 50)])
def test_estimates_are_near(size, shared):
    found, truth = [], shared / (2 * size - shared)
    for k in range(40):
        values, offsets = _sets({(k, i) for i in range(size)}, {(k, i) for i in range(size - shared, 2 * size - shared)})
        r, n = near.registers(values, offsets), np.diff(offsets)
        found.append(near.estimate(r[:1], r[1:], n[:1], n[1:])[0])
        if truth >= 0.75:
            assert found[-1] >= near.floor_of_estimates(n[:1], n[1:])[0]
    assert abs(np.mean(found) - truth) < 0.035


@pytest.mark.parametrize("links", [[], [(5, 5)], [(i, i + 1) for i in range(40)], [(i + 1, i) for i in range(0, 40, 2)], [(40, i) for i in range(40)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.comp for r in components(df, Scratch(spark, "test"), "c").collect()}
    least = {x: x for p in links for x in p}
    for _ in links:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert got == {x: c for x, c in least.items() if any(a != b and x in (a, b) for a, b in links)}
