import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from orfspark.operators import orfs as of
from orfspark.options import Semantics

SEQUENCE = "ATGCATGACTAGCATCAGCATCAGCATATGGACGAATTAAGTTAA"


def brute(seq, starts=of.STARTS, stops=of.STOPS):
    out = []
    for i in range(len(seq) - 2):
        if seq[i : i + 3] in starts:
            end = next((j for j in range(i + 3, len(seq) - 2, 3) if seq[j : j + 3] in stops), None)
            stop = len(seq) if end is None else end + 2
            out.append((i, stop, stop - (i + 2), seq[i : i + 3], seq[-3:] if end is None else seq[end : end + 3]))
    return sorted(out)


def found(spark, seqs, **options):
    df = spark.createDataFrame([(f"t{i}", s) for i, s in enumerate(seqs)], "tran_id string, seq string")
    out = {f"t{i}": [] for i in range(len(seqs))}
    for r in of.find_orfs(df, **options).collect():
        out[r.tran_id].append((r.start, r.stop, r.length, r.startorf, r.stoporf))
    return [sorted(v) for v in out.values()]


def test_known_sequence(spark):
    (got,) = found(spark, [SEQUENCE])
    assert [(a, b, n, e) for a, b, n, _, e in got] == [(0, 11, 9, "TAG"), (4, 39, 33, "TAA"), (27, 44, 15, "TAA")]


def test_random_sequences(spark):
    rng = random.Random(4)
    seqs = ["".join(rng.choices("ACGT", k=rng.randint(0, 400))) for _ in range(60)] + ["", "A", "ATG", "ATGTAA", "ATGATGTGA", "atgtaa", "ATGA" * 50, "CATGATAATGA"]
    assert found(spark, seqs) == [brute(s) for s in seqs]
    alt = ("ATG", "CTG")
    assert found(spark, seqs, starts=alt, stops=("TAA",)) == [brute(s, alt, ("TAA",)) for s in seqs]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seqs=st.lists(st.text("ATG", max_size=40), min_size=1, max_size=12))
def test_dense_codons(spark, seqs):
    assert found(spark, seqs) == [brute(s) for s in seqs]


def test_sequences_that_share_an_id(spark):
    seqs = [SEQUENCE, "CATGATAATGACC", SEQUENCE, "ATG"]
    rows = of.find_orfs(spark.createDataFrame([("T1", s) for s in seqs], "tran_id string, seq string")).collect()
    assert sorted((r.start, r.stop, r.length, r.startorf, r.stoporf) for r in rows) == sorted(x for s in seqs for x in brute(s))
    got = of.codon_positions(spark.createDataFrame([("T1", s) for s in seqs], "tran_id string, seq string"), ["ATG"]).collect()
    assert sorted(r.pos for r in got) == sorted(i for s in seqs for i in range(len(s)) if s[i : i + 3] == "ATG")


def test_normalised_sequences(spark):
    df = spark.createDataFrame([("a", SEQUENCE.lower().replace("t", "u"))], "tran_id string, seq string")
    assert of.find_orfs(df).collect() == []
    assert sorted((r.start, r.stop) for r in of.find_orfs(df, semantics=Semantics(normalize=True)).collect()) == sorted(x[:2] for x in brute(SEQUENCE))


def test_bounds_are_exclusive(spark):
    assert [r[2] for r in found(spark, [SEQUENCE], minlen=9, maxlen=33)[0]] == [15]


def test_codons_have_three_letters(spark):
    with pytest.raises(ValueError):
        of.codon_positions(spark.createDataFrame([("a", "ATG")], "tran_id string, seq string"), ["AT"])


def test_types(spark):
    cases = {(0, 9): "uORF", (10, 50): "CDS", (51, 60): "dORF", (5, 20): "uoORF", (20, 60): "doORF", (12, 40): "iORF", (5, 60): "uoORF", (5, 50): "uoORF", (10, 53): "doORF"}
    orfs = spark.createDataFrame([("t", a, b) for a, b in cases] + [("none", 1, 5)], "tran_id string, start long, stop long")
    cds = spark.createDataFrame([("t", 10, 50)], "tran_id string, tran_start long, tran_stop long")
    got = {(r.tran_id, r.start, r.stop): r.type for r in of.classify_orfs(orfs, cds).collect()}
    assert got == {("t", *k): v for k, v in cases.items()} | {("none", 1, 5): "Non Coding"}
    strict = {(r.start, r.stop): r.type for r in of.classify_orfs(orfs, cds, Semantics(strict_types=True)).collect()}
    assert (strict[5, 60], strict[5, 50], strict[5, 20]) == ("eoORF", "extORF", "uoORF")
    longer = {(r.start, r.stop): r.type for r in of.classify_orfs(orfs, cds, Semantics(stop_codon_in_cds=True)).collect()}
    assert longer[10, 53] == "CDS"


def test_spliced_transcripts(spark):
    genome = spark.createDataFrame([("1", "ACGTTTGGCA")], "chr string, seq string")
    rows = [("1", "P", "+", 0, 1, 3, 0, 2), ("1", "P", "+", 1, 8, 10, 3, 5), ("1", "M", "-", 0, 8, 10, 0, 2), ("1", "M", "-", 1, 1, 3, 3, 5)]
    exons = spark.createDataFrame(rows, "chr string, tran_id string, strand string, exon_idx int, start long, stop long, tran_start long, tran_stop long")
    assert {r.tran_id: r.seq for r in of.spliced_transcripts(genome, exons).collect()} == {"P": "ACGGCA", "M": "TGCCGT"}


def test_spliced_from_chunks_equals_whole_contigs(spark):
    rng = random.Random(4)
    rows = [(c, k, "".join(rng.choices("ACGTNacgt", k=rng.choice([0, 1, 3, 20, 90])))) for c in ("a", "b") for k in range(40)] + [("a", 3, None), ("a", 90, "TT"), ("a", 90, "GG")]
    chunks = of.chunk_offsets(spark.createDataFrame(rows, "chr string, id long, seq string"), cell=8)
    whole = {c: "".join(x[2] or "" for x in sorted(rows, key=lambda x: (x[1], x[2] or "")) if x[0] == c) for c in ("a", "b")}
    exons = [(rng.choice("abc"), f"t{t}", s, k, k * 300 + rng.randint(1, 90), 0) for t in range(30) for s in ["+-"[t % 2]] for k in range(4)]
    exons = [(c, t, s, 3 - k if s == "-" else k, a, a + rng.choice([0, 8, 30, 150])) for c, t, s, k, a, _ in exons] + [("b", "far", "+", 0, 10**6, 10**6 + 8)]
    exons = spark.createDataFrame(exons, "chr string, tran_id string, strand string, exon_idx int, start long, stop long")
    expected = {tuple(r) for r in of.spliced_transcripts(spark.createDataFrame(list(whole.items()), "chr string, seq string"), exons).collect()}
    got = {tuple(r) for r in of.spliced_from_chunks(chunks, exons, tile=16).collect()}
    assert got == expected and ("far", "") in got and len(got) > 15


def test_no_contig_becomes_one_string(spark, monkeypatch):
    from orfspark import queries

    tr = spark.createDataFrame([(k, "s", "ACGTACGTTT" * 5) for k in range(200)], "doc_id long, source string, seq string")
    monkeypatch.setattr(queries, "table", lambda *_: tr)
    plan = queries.spliced_sequence(spark, "")._jdf.queryExecution().optimizedPlan().toString()
    # the one list that is collected is that of a transcript's exons
    assert plan.count("collect_list") == 1 and len(queries.spliced_sequence(spark, "").collect()) == 400
