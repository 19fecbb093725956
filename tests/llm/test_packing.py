import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from orfspark.llm import packing
from orfspark.llm.tokens import default_vocabulary


def _tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    t.encode_special_tokens = True
    return t


def _texts(seed=1, n=150):
    rng = random.Random(seed)
    return [" ".join(rng.choices(["alpha", "Beta,", "gam\nma", "d!", "naïve"], k=rng.choice([0, 1, 5, 40, 300, 900]))) for _ in range(n)] + [None, "", "x " * 20_000, "ab " * 4095, "ab " * 4096]


def _check(rows, given, capacity=4096):
    """Every piece is right, sequences are gapless and full at most; returns the number of sequences."""
    whole, by, seq = _tokenizer(), {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    expected, total = {}, 0
    for i, t in given:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        parts = [ids[k : k + capacity] for k in range(0, len(ids), capacity)]
        expected.setdefault(i, []).extend((k, k * capacity, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(parts))
    assert {i: sorted(v) for i, v in by.items()} == {i: sorted(v) for i, v in expected.items()}
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(seq) >= -(-total // capacity)
    return len(seq), -(-total // capacity)


def test_round_trip_and_bound(spark):
    texts = _texts()
    rows = packing.pack(brute.clashing(brute.docs(spark, texts))).collect()
    used, floor = _check(rows, list(enumerate(texts)))
    assert used <= floor + 1


def test_partitions_exchange(spark, monkeypatch):
    """Many small partitions end with hardly more sequences than one large one."""
    texts = _texts(2, 400)
    alone = len({r.sequence_id for r in packing.pack(brute.docs(spark, texts)).collect()})
    monkeypatch.setattr(packing, "PIECES", 12)
    used, floor = _check(packing.pack(brute.docs(spark, texts)).collect(), list(enumerate(texts)))
    assert floor <= used <= alone + 2


def test_repeated_and_null_ids(spark):
    given = [(1, "one two"), (1, "one two"), (None, "three"), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in given], brute.DOCS)
    rows = packing.pack(df).collect()
    assert len(rows) == 4 and _check(rows, given)[0] == 1


def test_small_capacity(spark):
    texts = _texts(3, 30)
    _check(packing.pack(brute.docs(spark, texts), capacity=7).collect(), list(enumerate(texts)), 7)


def test_empty_table(spark):
    assert packing.pack(brute.docs(spark, {})).collect() == []


def _optimum(sizes, capacity):
    """The least number of bins, by trying all first-fit orders."""
    best = len(sizes)
    for order in set(itertools.permutations(sizes)):
        bins = []
        for s in order:
            for k, free in enumerate(bins):
                if free >= s:
                    bins[k] -= s
                    break
            else:
                bins.append(capacity - s)
        best = min(best, len(bins))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=6), st.integers(12, 16))
def test_lower_bound_is_one(sizes, capacity):
    lengths, counts = np.unique(sizes, return_counts=True)
    bound = packing.lower_bound(lengths, counts, capacity)
    bins, offsets, free = packing.best_fit(np.array(sizes), capacity)
    assert -(-sum(sizes) // capacity) <= bound <= _optimum(sizes, capacity) <= len(free)
    for b in range(len(free)):
        own = sorted((o, s) for k, (o, s) in enumerate(zip(offsets.tolist(), sizes, strict=True)) if bins[k] == b)
        assert [o for o, _ in own] == [sum(s for _, s in own[:k]) for k in range(len(own))] and sum(s for _, s in own) + free[b] == capacity


@pytest.mark.parametrize("sizes, bound", [([51] * 9, 9), ([34] * 6, 3), ([34] * 7, 4), ([60, 40] * 5, 5), ([67] * 4 + [34] * 4, 6)])
def test_dual_feasible_functions_beat_the_sum(sizes, bound):
    assert packing.lower_bound(*np.unique(sizes, return_counts=True), 100) == bound
