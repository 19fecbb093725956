import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from orfspark.llm import substrings
from orfspark.llm.spans import SuffixAutomaton


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=14), st.integers(1, 2)), min_size=1, max_size=6))
def test_automaton_counts_what_recurs(sequences):
    automaton = SuffixAutomaton()
    for s, times in sequences:
        automaton.add(s, times)
    automaton.close()
    times = lambda x: sum(n * sum(s.startswith(x, i) for i in range(len(s))) for s, n in sequences)
    for s, _ in sequences:
        expected = [max((k for k in range(e + 2) if k == 0 or times(s[e + 1 - k : e + 1]) > 1), default=0) for e in range(len(s))]
        assert automaton.statistics(s) == expected
    other = "abcabca"
    seen = automaton.statistics(other)
    for e, k in enumerate(seen):
        assert k == 0 or times(other[e + 1 - k : e + 1]) > 1
        assert k == e + 1 or times(other[e - k : e + 1]) < 2


def _corpus(seed=1):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randint(0, 300)}" for _ in range(n)]
    passages = [fresh(n) for n in (30, 34, 35, 36, 50, 120)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 3)):
            parts += fresh(rng.randint(0, 60))
            p = rng.choice(passages)
            parts += p[rng.randint(0, 5) :] if rng.random() < 0.5 else p
        texts.append(rng.choice([" ", "\n", " \t "]).join(parts))
    twice = fresh(40)
    texts += [" ".join([*twice, "x", *twice]), "a " * 100, texts[0], texts[0], "", None, " \n ", "b " * 35, "é" + " c" * 36, "q " * 60_000]
    rng.shuffle(texts)
    return texts


def _got(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("most", [256, 1])
def test_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(substrings, "MOST_RANGES", most)  # 1: every open anchor goes by counting
    monkeypatch.setattr(substrings, "SHARD_WORDS", 500)
    texts = _corpus()
    docs = brute.clashing(brute.docs(spark, texts))
    assert _got(substrings.removed_spans(docs)) == dict(enumerate(brute.removed(texts)))


def test_another_window(spark):
    texts = _corpus(2)
    assert _got(substrings.removed_spans(brute.docs(spark, texts), 12)) == dict(enumerate(brute.removed(texts, 12)))


def test_repeated_and_null_ids(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [(1, passage), (1, passage + " end"), (None, "start " + passage), (None, None), (2, "other")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], brute.DOCS)
    expected = sorted((i is None, i or 0, *x) for (i, _), x in zip(rows, brute.removed([t for _, t in rows]), strict=True))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removed_spans(df).collect()) == expected
    assert sorted(r.text or "" for r in substrings.cut_spans(df).collect()) == ["", "", "end", "other", "start "]


def test_stage_cuts_the_words_and_leaves_the_rest(spark):
    texts = _corpus(4)
    docs = brute.clashing(brute.docs(spark, texts))
    cut = substrings.cut_spans(docs)
    assert cut.columns == docs.columns
    for r in cut.collect():
        n, gone, digest = brute.removed(texts)[r.doc_id]
        assert (r.text == texts[r.doc_id] and r.n_chars == len(r.text or "")) if not gone else brute.removed([r.text])[0][0] == n - gone
        assert __import__("hashlib").sha256(" ".join(brute.WORD.findall(r.text or "")).encode()).hexdigest() == digest
        assert r.n_chars == len(r.text or "")


def test_empty_table(spark):
    assert substrings.removed_spans(brute.docs(spark, {})).collect() == []
    assert substrings.cut_spans(brute.docs(spark, {})).collect() == []
