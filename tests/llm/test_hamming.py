import random

import duckdb
import numpy as np
import pytest

from orfspark.llm import hamming, queries

VECTORS = "vec_id long, embedding array<float>"


def _rows(n=1200, seed=3, hot=0.35):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = []
    for i in range(n):
        if rng.random() < hot:
            v = centres[0]
        else:
            v = [x + rng.gauss(0, 0.8) for x in rng.choice(centres)]
        rows.append((i, v))
    return rows


def _brute(rows, k, step):
    code = lambda v: sum(1 << i for i, x in enumerate(v[:64]) if x is not None and x > 0)
    coded = [(i, code(v)) for i, v in rows if i is not None and v is not None]
    out = []
    for q, c in coded:
        if q % step == 0:
            best = sorted(((c ^ d).bit_count(), i) for i, d in coded)[:k]
            out += [(q, rank, i, d) for rank, (d, i) in enumerate(best, 1)]
    return sorted(out)


def _got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("shard, block", [(50_000, 20_000), (60, 3)])
def test_equals_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(hamming, "SHARD", shard)
    monkeypatch.setattr(hamming, "QUERIES", block)
    rows = _rows()
    assert _got(hamming.nearest_codes(spark.createDataFrame(rows, VECTORS))) == _brute(rows, 10, 50)


def test_odd_rows(spark):
    rows = [(0, None), (50, []), (50, []), (100, [1.0, None, -1.0]), (None, [1.0]), (7, [1.0] * 70), (8, [0.0] * 64), (9, [float("nan")] * 3)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], VECTORS + ", code string, rank int")
    got = _got(hamming.nearest_codes(df, k=3, step=50))
    expected = _brute([r for r in rows if r[0] != 9], 3, 50)
    assert [g for g in got if g[0] == 50] == [e for e in expected if e[0] == 50] and {g[0] for g in got} == {50, 100}
    assert hamming.nearest_codes(df.limit(0)).collect() == []


def test_few_rows_give_all(spark):
    rows = _rows(4)
    assert _got(hamming.nearest_codes(spark.createDataFrame(rows, VECTORS), k=10)) == _brute(rows, 10, 50)


def test_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    df = queries.op3_hamming_top_k(spark, data)
    assert sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()['op3_hamming_top_k']})").fetchall()) == _got(df)


def test_search_is_covered_at_any_size():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 3000):
        codes = np.unique(rng.integers(0, 2**64, n, np.uint64))
        index = hamming.MultiIndex(codes, np.arange(len(codes)))
        for q in [*codes[:5], *rng.integers(0, 2**64, 5, np.uint64)]:
            at, distance = index.nearest(q, 4)
            truth = sorted((int(c ^ q).bit_count(), i) for i, c in enumerate(codes))[:4]
            assert list(zip(distance.tolist(), at.tolist(), strict=True)) == truth
