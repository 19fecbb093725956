import collections
import math
import random

import pytest
from pyspark.sql import functions as F

import brute
from orfspark.llm import mixing


def _corpus(spark, n=3000, hot=0.6):
    rng = random.Random(5)
    texts = {i: " ".join(["w"] * rng.randint(1, 60)) for i in range(n)}
    source = {i: "hot" if rng.random() < hot else f"s{rng.randint(0, 5)}" for i in texts}
    return texts, source, brute.docs(spark, texts, source=source.get)


def _entropy(weights):
    return -sum(w * math.log(w) for w in weights if w) / math.log(len(weights))


def test_word_count(spark):
    texts = ["", None, " ", "a", " a\n", "\ta  b\x0b", "é ü", "a b c", "\n\n"]
    got = {r.doc_id: r.n for r in brute.docs(spark, texts).select("doc_id", mixing.word_count().alias("n")).collect()}
    assert got == {i: len(brute.WORD.findall(t or "")) for i, t in enumerate(texts)}


@pytest.mark.parametrize("entropy, repeats", [(0.9, 100.0), (0.97, 100.0), (0.97, 2.0), (0.2, 2.0)])
def test_exponent_meets_the_target(spark, entropy, repeats):
    tokens = [5000, 900, 700, 40, 10]
    alpha = mixing.exponent(spark.createDataFrame([(t,) for t in [*tokens, 0]], "tokens long"), entropy, repeats)
    shares = [t / sum(tokens) for t in tokens]
    powered = [s**alpha for s in shares]
    weights = [p / sum(powered) for p in powered]
    most = (max(shares) / min(shares)) ** (1 - alpha)
    assert most <= repeats * (1 + 1e-9)
    if alpha < 1 and most < repeats * (1 - 1e-6):
        assert _entropy(weights) == pytest.approx(entropy, abs=1e-4)
    if alpha == 1:
        assert _entropy(shares) >= entropy


def test_mixture(spark):
    texts, source, docs = _corpus(spark)
    rows = mixing.mix(brute.clashing(docs), block_tokens=2000).collect()
    size = {i: len(t.split()) for i, t in texts.items()}
    total, used = collections.Counter(), collections.Counter()
    for i, s in source.items():
        total[s] += size[i]
    copies = collections.Counter()
    for r in rows:
        assert (r.source, r.tokens) == (source[r.doc_id], size[r.doc_id])
        used[r.source] += r.tokens
        copies[r.doc_id] += 1
    assert set(copies) == set(texts), "no document is left out"
    weight = {s: u / sum(used.values()) for s, u in used.items()}
    alpha = math.log(weight["hot"] / weight["s0"]) / math.log(total["hot"] / total["s0"])
    powered = {s: (t / sum(total.values())) ** alpha for s, t in total.items()}
    for s in total:
        assert weight[s] == pytest.approx(powered[s] / sum(powered.values()), rel=0.03)
        passes = used[s] / total[s]
        # each document takes part as often as any other of its source, or once more
        assert {copies[i] for i in texts if source[i] == s} <= {math.floor(passes + 1e-9), math.floor(passes + 1e-9) + 1}
    assert max(used[s] / total[s] for s in total) <= 2.0 + 0.05
    blocks = collections.defaultdict(list)
    for r in rows:
        blocks[r.block].append(r)
    assert sorted(blocks) == list(range(len(blocks)))
    for b, own in blocks.items():
        assert sorted(r.position for r in own) == list(range(len(own)))
        if b < len(blocks) - 1:
            for s in total:
                assert abs(sum(r.tokens for r in own if r.source == s) - weight[s] * 2000) <= 2 * 60 + 2000 * 0.03
    assert [r.doc_id for r in sorted(blocks[0], key=lambda r: r.position)] != sorted(r.doc_id for r in blocks[0])


def test_budget_below_one_pass(spark):
    texts, source, docs = _corpus(spark)
    whole = sum(len(t.split()) for t in texts.values())
    rows = mixing.mix(docs, entropy=0.0, budget=whole // 3).collect()
    assert sum(r.tokens for r in rows) == pytest.approx(whole / 3, rel=0.02) and len({r.doc_id for r in rows}) == len(rows)


def test_stage_repeats_whole_rows(spark):
    _, _, docs = _corpus(spark, 600)
    docs = brute.clashing(docs)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert copies == {r.doc_id: r["count"] for r in mixing.mix(docs).groupBy("doc_id").count().collect()}
    assert mixed.distinct().exceptAll(docs).isEmpty() and docs.exceptAll(mixed.distinct()).isEmpty()


def test_odd_rows(spark):
    rows = [(1, None, "en", None, 0), (1, None, "en", None, 0), (None, "a b", "en", "x", 3), (2, "c", None, "", 1), (3, "", "en", "y", 0), (4, "d " * 5000, "en", "x", 9)]
    df = spark.createDataFrame(rows, brute.DOCS)
    got = mixing.mix(df, repeats=1.0).collect()
    assert sorted((r.doc_id or 0, r.source, r.tokens) for r in got) == [(0, "x", 2), (1, "", 0), (1, "", 0), (2, "", 1), (3, "y", 0), (4, "x", 5000)]
    assert len({(r.block, r.position) for r in got}) == len(got)
    assert mixing.mixed(df, repeats=1.0).count() == len(rows)


def test_empty_table(spark):
    assert mixing.mix(brute.docs(spark, {})).collect() == []
    assert mixing.mixed(brute.docs(spark, {})).collect() == []
    one = brute.docs(spark, ["only words"])
    assert [(r.doc_id, r.copy) for r in mixing.mix(one).collect()] == [(0, 0)]
    assert mixing.mix(brute.docs(spark, ["", None])).select(F.countDistinct("block", "position")).first()[0] == 2
