import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from orfspark.llm import quality, rules

LABELS = "doc_id long, quality int, toxic int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text("ab \n#é|", max_size=80), max_size=5))
def test_statistics(texts):
    s = rules.statistics(pa.array(texts, pa.string()))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert list(zip(*(s[n].tolist() for n in names), strict=True)) == [brute.statistics(t) for t in texts]


def _corpus(n=400):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(rng.randint(30, 200))).capitalize() + "."
    bad = lambda: " ".join(word().upper() + "!!" + "#%"[rng.randint(0, 1)] * 3 for _ in range(rng.randint(30, 200)))
    return {i: bad() if i % 10 == 0 else good() for i in range(n)}


def test_verdicts(spark):
    texts = _corpus()
    texts |= {1000: None, 1001: "", 1002: "only nine words " * 3, 1003: "z " * 500_000, 1004: "one two three four five six seven eight nine ten"}
    docs = brute.clashing(brute.docs(spark, texts))
    docs = docs.unionAll(docs.where("doc_id = 1004"))
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(0, 400, 2)] + [(7, None, None), (None, 1, 0)], LABELS)
    rows = quality.quality_rules(docs, labels).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 1
    for i, t in texts.items():
        expected = brute.statistics(t)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected
        assert got[i].base_failed == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert not (got[i].base_failed and got[i].kept)
    assert sum(got[i].kept for i in range(400) if i % 10) >= 0.98 * 360
    assert sum(got[i].kept for i in range(0, 400, 10)) <= 4
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)], [(1, None, None)]])
def test_without_both_labels_only_the_base_rules_reject(spark, labels):
    docs = brute.docs(spark, {1: " ".join(map(str, range(40))), 2: "$$$ " * 4, 3: None})
    got = {r.doc_id: r.kept for r in quality.quality_rules(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_empty_table(spark):
    empty = brute.docs(spark, {})
    assert quality.quality_rules(empty, spark.createDataFrame([], LABELS)).collect() == []
    assert quality.keep_good(empty, spark.createDataFrame([], LABELS)).collect() == []


def test_forest_scores_outliers_higher():
    rng = np.random.default_rng(1)
    usual = np.column_stack([rng.normal(size=(2000, 3)), np.zeros(2000)])  # the last statistic is constant
    odd = usual[:200].copy()
    odd[:, 3] = 1
    both = np.concatenate([usual, odd])
    forest = rules.IsolationForest(usual, both.min(axis=0), both.max(axis=0), 60, 128)
    assert (forest.score(odd) > forest.score(usual[:200])).mean() > 0.97
    flat = np.zeros((5, 2))
    assert rules.IsolationForest(flat, flat[0], flat[0]).score(flat).shape == (5,)


def _score_by_hand(forest, row):
    """A row's anomaly by walking each tree from its root."""
    total = 0.0
    for feature, cut, right, path in forest.trees:
        at = 0
        while feature[at] >= 0:
            at = at + 1 if row[feature[at]] < cut[at] else int(right[at])
        total += path[at]
    n = forest.size
    usual = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    return 2 ** -(total / len(forest.trees) / usual)


def test_verdicts_equal_walking_the_trees(spark):
    texts = _corpus() | {900: None, 901: "short"}
    docs = brute.docs(spark, texts)
    known = {i: int(i % 10 > 0) for i in range(0, 400, 3)}
    labels = spark.createDataFrame([(i, q, 0) for i, q in known.items()], LABELS)
    forest = quality.fit_forest(docs, labels)
    failed, anomaly = {}, {}
    for i, t in texts.items():
        s = brute.statistics(t)
        failed[i] = s[0] < 10 or 100 * s[4] > 20 * s[0]
        anomaly[i] = _score_by_hand(forest, rules.statistics(pa.array([t], pa.string()))["features"][0])
    # every threshold a bin has, by counting labelled rows at or over it
    judged = {i: int(anomaly[i] * quality._BINS) for i in known if not failed[i]}
    share = lambda q, b: sum(judged[i] >= b for i in judged if known[i] == q) / sum(known[i] == q for i in judged)
    gains = {b: share(0, b) - quality.CLEAN_WEIGHT * share(1, b) for b in range(quality._BINS + 2)}
    best = max(gains, key=lambda b: (gains[b], -b))
    assert gains[best] > 0
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    for i in texts:
        assert got[i].anomaly == pytest.approx(anomaly[i])
        assert got[i].kept == (not failed[i] and anomaly[i] < best / quality._BINS)
    assert any(not r.kept and not r.base_failed for r in got.values())
