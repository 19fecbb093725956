import math
import random

import pytest
from pyspark.sql import functions as F

from orfspark import schema
from orfspark.operators import intervals, report, scoring
from orfspark.options import Semantics


def brute_flank(reads, anchor, reach, invert):
    same = [(p, c) for p, c in reads if (p - anchor) % 3 == 0 and anchor - reach <= p <= anchor + reach + 2]
    before, after = sum(c for p, c in same if p < anchor), sum(c for p, c in same if p > anchor)
    return math.log((1 + before) / (1 + after)) if invert else math.log((1 + after) / (1 + before))


def brute_frames(reads, start, stop):
    own = [(p, c) for p, c in reads if start <= p <= stop]
    f = [sum(c for p, c in own if p % 3 == k) for k in range(3)]
    rows = [p for p, c in own if c > 0]
    return (f[0] / max(f[1], f[2]) if f[1] and f[2] else 0.0, f[0] / ((stop - start) / 3) if f[0] else 0.0, sum(p % 3 == 0 for p in rows) / len(rows) if rows else 0.0)


def _reads(spark, by):
    return spark.createDataFrame([(t, p, p + 1, float(c)) for t, rows in by.items() for p, c in rows], schema.TRAN_READS)


@pytest.fixture(scope="module")
def random_case(spark):
    rng = random.Random(9)
    by = {f"t{k}": [(rng.randint(0, 120), rng.choice([0, 1, 2, 5])) for _ in range(rng.randint(1, 150))] for k in range(12)}
    orfs = {(f"t{rng.randint(0, 13)}", a, a + rng.randint(3, 60)) for a in (rng.randint(0, 110) for _ in range(150))}
    types = ["uORF", "uoORF", "doORF", "CDS"]
    rows = [(t, a, b, b - a - 2, "ATG", "TAA", rng.choice(types)) for t, a, b in sorted(orfs)]
    return by, rows, spark.createDataFrame(rows, schema.ORF_TYPED), _reads(spark, by)


def test_scores_equal_brute_force(random_case):
    by, rows, orfs, reads = random_case
    got = {(r.tran_id, r.start, r.stop): r for r in scoring.score_orfs(orfs, reads, 15).collect()}
    assert set(got) == {r[:3] for r in rows if r[0] in by}
    for t, a, b, *_, kind in rows:
        if t not in by:
            continue
        up, down = brute_flank(by[t], a, 15, False), brute_flank(by[t], b, 15, True)
        expected = (0.0 if kind == "doORF" else up, 0.0 if kind == "uoORF" else down, *brute_frames(by[t], a, b))
        r = got[t, a, b]
        assert (r.rise_up, r.step_down, r.hrf, r.avg, r.nzc) == pytest.approx(expected)
        assert r.score == pytest.approx(sum(expected))


def test_single_statistics_equal_brute_force(random_case):
    by, rows, orfs, reads = random_case
    for invert in (False, True):
        got = scoring.sru_scores(orfs.select("tran_id", F.col("start").alias("anchor")), reads, 12, invert).collect()
        for r in got:
            assert r.sru == pytest.approx(brute_flank(by.get(r.tran_id, []), r.anchor, 12, invert))
    for r in scoring.frame_scores(orfs, reads).collect():
        assert (r.hrf, r.avg, r.nzc) == pytest.approx(brute_frames(by.get(r.tran_id, []), r.start, r.stop))


def test_type_specific_and_unscored(random_case):
    by, _, orfs, reads = random_case
    for r in scoring.score_orfs(orfs, reads, semantics=Semantics(type_specific=True)).collect():
        have = {c for c in schema.SCORES if r[c] is not None}
        assert have == {"uoORF": {"rise_up"}, "doORF": {"step_down"}}.get(r.type, {"hrf", "avg", "nzc"})
        assert r.score == pytest.approx(sum(r[c] for c in have))
    kept = scoring.score_orfs(orfs, reads, semantics=Semantics(keep_unscored=True)).collect()
    assert len(kept) == orfs.count() and {r.score is None for r in kept if r.tran_id not in by} == {True}


def test_coverage_to_transcript(spark):
    exons = spark.createDataFrame([("1", "T", "+", 0, 100, 110, 0, 10), ("1", "U", "-", 0, 100, 110, 0, 10), ("chrM", "M", "+", 0, 1, 50, 0, 49), ("1", "O", "+", 0, 105, 105, 0, 0)], schema.EXON)
    coverage = spark.createDataFrame([("1", 99, 100, 1.0), ("1", 100, 101, 2.0), ("1", 109, 110, 3.0), ("1", 110, 111, 4.0), ("chrM", 5, 6, 9.0)], schema.COVERAGE)
    get = lambda s: sorted((r.tran_id, r.tran_start, r.tran_stop, r.counts) for r in scoring.coverage_to_transcript(coverage, exons, s).collect())
    assert get(Semantics()) == [(t, *x) for t in "TU" for x in ((0, 1, 2.0), (9, 10, 3.0))]
    assert [x for x in get(Semantics(strand_aware=True)) if x[0] == "U"] == [("U", 0, 1, 3.0), ("U", 9, 10, 2.0)]
    assert {x[3] for x in get(Semantics(one_based=True))} == {1.0, 2.0, 3.0}


def test_overlaps_come_once_whatever_the_bins(spark):
    rng = random.Random(2)
    make = lambda n: [("c", a, a + rng.randint(0, 300)) for a in (rng.randint(0, 2000) for _ in range(n))]
    left, right = make(80), make(60)
    a = spark.createDataFrame(left, "chr string, l_start long, l_stop long")
    b = spark.createDataFrame(right, "chr string, r_start long, r_stop long")
    expected = sorted((p, q, x, y) for _, p, q in left for _, x, y in right if p < y and q > x and p < q and x < y)
    for size in (7, 100, 5000):
        assert sorted((r.l_start, r.l_stop, r.r_start, r.r_stop) for r in intervals.overlap_join(a, b, ["chr"], size).collect()) == expected
    inner, outer = a.toDF("chr", "i_start", "i_stop"), b.toDF("chr", "o_start", "o_stop")
    inside = sorted((p, q, x, y) for _, p, q in left for _, x, y in right if x <= p and q <= y)
    for size in (7, 100, 5000):
        assert sorted((r.i_start, r.i_stop, r.o_start, r.o_stop) for r in intervals.contain_join(inner, outer, ["chr"], size).collect()) == inside


def test_report_queries(random_case):
    by, rows, orfs, reads = random_case
    scored = scoring.score_orfs(orfs, reads)
    top = report.top_orfs(scored, 3).collect()
    best = sorted(scored.where("type = 'CDS'").collect(), key=lambda r: (-r.score, r.tran_id, r.start))[:3]
    assert [(r.tran_id, r.start) for r in sorted((r for r in top if r.type == "CDS"), key=lambda r: r.rank)] == [(r.tran_id, r.start) for r in best]
    for anchor, i, shift in (("start", 1, 0), ("stop", 2, 1)):
        got = {(r.type, r.relativeloc): r.counts for r in report.metagene(orfs, reads, anchor, 5).collect()}
        for kind in {r[-1] for r in rows}:
            for d in range(-5, 6):
                assert got[kind, d] == sum(c for r in rows if r[-1] == kind for p, c in by.get(r[0], []) if p + shift - r[i] == d)
    profile = report.transcript_profile(orfs.where("tran_id = 't1'"), reads).collect()
    assert {r.tran_id for r in profile} == {"t1"} and sum(r.counts for r in profile) == sum(c for _, c in by["t1"]) and all(r.frame == r.tran_start % 3 for r in profile)
