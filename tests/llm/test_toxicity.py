import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from orfspark.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"
INSULTS = ("idiot", "moron", "blockhead", "numskull", "dimwit")


def _corpus(n=1500, seed=2):
    rng = random.Random(seed)
    fresh = lambda: [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(5, 80))]
    texts, toxic = {}, {}
    for i in range(n):
        words, toxic[i] = fresh(), int(rng.random() < 0.25)
        if toxic[i]:
            for w in rng.sample(INSULTS, 2):
                words.insert(rng.randint(0, len(words)), rng.choice([w, w.upper() + "!", w + ",", w + "s"]))
            # insults often stand beside a group here, so a plain fit would blame the group
            if rng.random() < 0.6:
                words.append("muslims")
        elif rng.random() < 0.02:
            words.append(rng.choice(["muslims", "christians"]))
        texts[i] = " ".join(words)
    return texts, toxic


@pytest.fixture(scope="module")
def case(spark):
    texts, toxic = _corpus()
    texts |= {5000: None, 5001: "", 5002: "what an idiot", 5003: "a meeting of muslims in the town hall", 5004: "a meeting of christians in the town hall", 5005: "calm words " * 100_000}
    docs = brute.clashing(brute.docs(spark, texts))
    labels = spark.createDataFrame([(i, 1, t) for i, t in toxic.items()] + [(None, 1, 1), (3, 1, None)], LABELS)
    return texts, toxic, docs, labels, {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}


def test_held_out_accuracy(case):
    texts, toxic, _, _, got = case
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [i for i in toxic if got[i].held_out]
    assert np.mean([got[i].predicted == toxic[i] for i in held]) > 0.96


def test_single_mentions(case):
    got = case[-1]
    assert got[5002].score > 0.5
    assert got[5003].score < 0.5 and got[5004].score < 0.5 and abs(got[5003].score - got[5004].score) < 0.2
    assert got[5000].score == got[5001].score < 0.5 and got[5005].score < 0.5


def test_the_penalty_matters(spark, case, monkeypatch):
    texts, _, docs, labels, got = case
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL", 0.0)
    plain = {r.doc_id: r.score for r in toxicity.score_toxicity(docs.where("doc_id in (5003, 5004)").unionAll(docs.where("doc_id < 5000")), labels).where("doc_id >= 5000").collect()}
    assert plain[5003] - plain[5004] > abs(got[5003].score - got[5004].score) + 0.1


def test_labels_of_held_out_rows_and_other_columns_do_not_count(spark, case):
    _, _, docs, labels, got = case
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumns({"source": F.lit("z"), "lang": F.lit("z"), "n_chars": F.lit(0)})
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(other, flipped).collect()}
    assert again == pytest.approx({i: r.score for i, r in got.items()})


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0), (3, 1, 0)], [(1, 1, None)]])
def test_without_both_labels(spark, labels):
    df = spark.createDataFrame([(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (None, None, None, None, None)], brute.DOCS)
    got = toxicity.score_toxicity(df, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 3 and all(r.score < 0.5 and r.predicted == 0 for r in got) and [r.held_out for r in got if r.doc_id is None] == [False]
    assert toxicity.score_toxicity(df.limit(0), spark.createDataFrame(labels, LABELS)).collect() == []


def test_swaps_and_features():
    assert toxicity._swapped("The Women and (gay) men, said") == "The men and (straight) girls, said"
    owner, values = toxicity.features(pa.array(["Idiots!!", "idiots", None, ""]))
    assert set(values[owner == 0]) == set(values[owner == 1]) and not (owner > 1).any()


def _kinds(text):
    """The words of a text and their beginnings, as strings."""
    out = set()
    for w in brute.WORD.findall(text or ""):
        bare = w.encode()
        for _ in range(4):
            if len(bare) > 1 and not (bare[-1:].isalnum() or bare[-1] >= 128):
                bare = bare[:-1]
            if len(bare) > 1 and not (bare[:1].isalnum() or bare[0] >= 128):
                bare = bare[1:]
        bare = bytes(c + 32 if 65 <= c <= 90 else c for c in bare)
        out |= {(0, bare)} | {(k, bare[:k]) for k in toxicity.BEGINNINGS if len(bare) > k}
    return out


def test_scores_equal_a_plain_fit(spark):
    texts, toxic = _corpus(500, 4)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(brute.docs(spark, texts), spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], LABELS)).collect()}
    learnt = sorted(i for i in texts if zlib.crc32(str(i).encode()) % 5)
    bad = {i for i in learnt if toxic[i]}
    have = {i: _kinds(t) for i, t in texts.items()}
    count = lambda ids: collections.Counter(k for i in ids for k in have[i])
    in_bad, in_good = count(bad), count(set(learnt) - bad)
    part = lambda x, n, total: x * math.log(x * len(learnt) / n / total) if x else 0.0
    gain = {k: 2 * (part(in_bad[k], len(bad), in_bad[k] + in_good[k]) + part(in_good[k], len(learnt) - len(bad), in_bad[k] + in_good[k])) for k in {*in_bad, *in_good} if in_bad[k] + in_good[k] >= toxicity.LEAST_DOCS}
    chosen = sorted(k for k, g in gain.items() if g >= toxicity.LEAST_GAIN)
    assert 5 <= len(chosen) < toxicity.FEATURES
    # features in the order of the model, as steps of the fit leave some out by their places
    hashed = {k: int(toxicity.word_hashes(toxicity.split_words(pa.array([k[1].decode(errors="replace")])), 90 + k[0], lower=True)[0]) for k in chosen}
    chosen.sort(key=hashed.get)
    pairs = lambda sets: tuple(np.array(x, np.int64) for x in zip(*((r, c) for r, s in enumerate(sets) for c, k in enumerate(chosen) if k in s), strict=True))
    terms = toxicity._terms()
    named = np.array([any(w.strip(".,;:!?\"'()").lower() in terms for w in texts[i].split()) for i in learnt])
    swapped = [_kinds(toxicity._swapped(texts[i])) if n else set() for i, n in zip(learnt, named, strict=True)]
    weights, bias = toxicity.fit(pairs([have[i] for i in learnt]), pairs(swapped), named, np.array([float(i in bad) for i in learnt]), len(chosen))
    for i in texts:
        logit = bias + sum(w for k, w in zip(chosen, weights, strict=True) if k in have[i])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-min(30, max(-30, logit)))), abs=1e-6)


def test_training_rows_are_bounded_however_often_an_id_stands(spark):
    rows = [(1, f"w{k} one", "en", "s", 1) for k in range(300)] + [(2, "two words", "en", "s", 1), (3, None, "en", "s", 0)]
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 1, 0)], LABELS)
    got = toxicity.score_toxicity(spark.createDataFrame(rows, brute.DOCS), labels).collect()
    assert len(got) == 302 and all(0 <= r.score <= 1 for r in got)
