import gzip
import os
import random
import struct
import zlib

import pytest

from orfspark import cli
from orfspark.plans import pipeline
from orfspark.sources import bam, bigwig, text

GTF = """#!genome
1\tsrc\texon\t101\t400\t.\t+\t.\tgene_id "G"; transcript_id "T1"; note "a;b"
1\tsrc\tCDS\t131\t190\t.\t+\t0\tgene_id "G"; transcript_id "T1";
1\tsrc\texon\tx\t400\t.\t+\t.\tgene_id "G"; transcript_id "T2";
"""


@pytest.fixture()
def files(tmp_path):
    seq = ("C" * 30 + "ATG" + "GCA" * 18 + "TAA" + "C" * 210)[:300]
    (tmp_path / "a.gtf").write_text(GTF)
    (tmp_path / "g.fa").write_text(f">1 dna\n{'A' * 60}\n{'A' * 40}{seq[:20]}\n{seq[20:]}\n")
    (tmp_path / "t.fa").write_text(f">T1|more text\n{seq[:100]}\n{seq[100:]}\n")
    (tmp_path / "sizes").write_text("1\t1000\n")
    reads = [(f"r{i}_x{i % 4 + 1}", "1", 101 + 3 * i, 101 + 3 * i + 28) for i in range(60)]
    bam.write_bam(str(tmp_path / "r.bam"), [("1", 1000)], reads)
    return tmp_path, seq, reads


def test_text_sources(spark, files):
    path, seq, _ = files
    rows = text.read_gtf(spark, str(path / "a.gtf")).collect()
    assert [(r.type, r.start, r.stop, r.strand) for r in rows] == [("exon", 101, 400, "+"), ("CDS", 131, 190, "+"), ("exon", None, 400, "+")]
    assert rows[0].attributes.endswith('note "a;b"')
    assert [tuple(r) for r in text.read_fasta(spark, str(path / "t.fa")).collect()] == [("T1", seq)]
    assert [tuple(r) for r in text.read_genome(spark, str(path / "g.fa")).collect()] == [("1", "A" * 100 + seq)]
    assert text.read_offsets(spark, {28: 12}).first().asDict() == {"length": 28, "offset": 12}
    text.write_fasta(text.read_fasta(spark, str(path / "t.fa")), str(path / "out.fa"))
    assert text.read_fasta(spark, str(path / "out.fa")).first().seq == seq


def test_bam_round_trip(spark, files):
    path, _, reads = files
    assert sorted(tuple(r) for r in bam.read_bam(spark, str(path / "r.bam")).collect()) == sorted(reads)
    assert bam.read_bam(spark, f"{path}/*.bam").count() == len(reads)


@pytest.mark.parametrize("split", [700, 5_000, 70_000, 1 << 30])
def test_bam_in_ranges(spark, tmp_path, split):
    """Every record is in one range, wherever ranges begin; blocks are small and records run over their ends."""
    rng = random.Random(split)
    rows = [(f"r{i}_{'q' * rng.randint(0, 60)}_x1", rng.choice("12"), rng.randint(1, 900), 0) for i in range(6000)]
    rows = [(q, r, p, p + rng.randint(0, 80)) for q, r, p, _ in rows]
    content, bam.CONTENT = bam.CONTENT, 997
    try:
        bam.write_bam(str(tmp_path / "a.bam"), [("1", 1000), ("2", 1000)], rows)
    finally:
        bam.CONTENT = content
    size, path = (tmp_path / "a.bam").stat().st_size, str(tmp_path / "a.bam")
    found = []
    for at in range(0, size, split):
        with open(path, "rb") as f:
            found += list(bam.records_of_range(f, at, min(at + split, size), ["1", "2"]))
    assert found == rows
    assert sorted(map(tuple, bam.read_bam(spark, path, max(split, 5_000)).collect())) == sorted(rows)
    # a plain gzip file has no block sizes, so it is one partition; a store's URI works like a path
    with gzip.open(path) as f:
        (tmp_path / "b.bam").write_bytes(gzip.compress(f.read()))
    assert sorted(map(tuple, bam.read_bam(spark, f"file://{tmp_path}/b.bam", split).collect())) == sorted(rows)


def test_fasta_headers_and_ids(spark, tmp_path):
    (tmp_path / "a.fa").write_text("\n>T1|x desc a>b\nACG\nT\n>T1 c.1A>G\r\nGG\r\n>T2\n\n>T3|y\nA")
    assert [tuple(r) for r in text.read_fasta(spark, str(tmp_path / "a.fa")).collect()] == [("T1", "ACGT"), ("T1", "GG"), ("T2", ""), ("T3", "A")]


def test_outputs_are_files_or_parts(spark, tmp_path):
    df = spark.createDataFrame([("T1", "AC"), ("T2", "GT")], "tran_id string, seq string").repartition(2, "seq")
    for parts in (False, True):
        paths = [str(tmp_path / f"{n}{parts}") for n in ("t", "f", "b")]
        text.write_table(df.orderBy("tran_id"), paths[0], parts)
        text.write_fasta(df, paths[1], parts)
        text.write_bedgraph(spark.createDataFrame([("2", 5, 6, 1.0), ("1", 9, 10, 2.0), ("1", 3, 4, 3.0)], "chr string, start long, stop long, value double"), paths[2], parts)
        assert all(os.path.isdir(p) == parts for p in paths)
        assert [tuple(r) for r in spark.read.option("header", True).csv(paths[0]).orderBy("tran_id").collect()] == [("T1", "AC"), ("T2", "GT")]
        assert sorted(map(tuple, text.read_fasta(spark, paths[1]).collect())) == [("T1", "AC"), ("T2", "GT")]
        assert sorted(map(tuple, text.read_bedgraph(spark, paths[2]).collect())) == [("1", 3, 4, 3.0), ("1", 9, 10, 2.0), ("2", 5, 6, 1.0)]
    assert (tmp_path / "tFalse").read_text() == "tran_id,seq\nT1,AC\nT2,GT\n"
    assert [x.split("\t")[1] for x in (tmp_path / "bFalse").read_text().splitlines()] == ["3", "9", "5"]
    assert not [p for p in os.listdir(tmp_path) if ".parts-" in p]


def test_bigwig_round_trip(spark, tmp_path):
    rows = [(c, 2 * i, 2 * i + 1 + i % 2, float(i % 7)) for c in ("1", "2", "X") for i in range(3000)]
    df = spark.createDataFrame(rows, "chr string, start long, stop long, value double")
    p = bigwig.write_bigwig(df, {"1": 10_000, "2": 10_000, "X": 10_000}, str(tmp_path / "a.bw"))
    back = bigwig.read_bigwig(spark, p)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    some = back.where("chr = '2' and start < 100 and stop > 50")
    assert sorted(tuple(r) for r in some.collect()) == sorted(r for r in rows if r[0] == "2" and r[1] < 100 and r[2] > 50)
    index = bigwig._Index(p)
    assert len(list(index.blocks(None, None, None))) == 9 and len(list(index.blocks({1}, 50, 100))) == 1
    with pytest.raises(ValueError, match="no size"):
        bigwig.write_bigwig(df, {"1": 10_000}, str(tmp_path / "b.bw"))
    for outside in ((-1, 3), (98, 101)):
        row = spark.createDataFrame([("1", *outside, 1.0)], "chr string, start long, stop long, value double")
        with pytest.raises(ValueError, match="not within"):
            bigwig.write_bigwig(row, {"1": 100}, str(tmp_path / "b.bw"))
    assert bigwig.read_bigwig(spark, bigwig.write_bigwig(df.limit(0), {"1": 5}, str(tmp_path / "c.bw"))).count() == 0


def test_bigwig_zoom_levels(spark, tmp_path, monkeypatch):
    """Each level against sums by hand, base by base; wide rows lie in several bins."""
    monkeypatch.setattr(bigwig, "_ITEMS", 8)
    rng, rows = random.Random(3), []
    for c in ("1", "2"):
        at = 0
        for _ in range(300):
            at += rng.choice((0, 1, 7))
            rows.append((c, at, at + rng.choice((1, 2, 90)), rng.choice((0.0, -2.0, 1.0, 8.0))))
            at = rows[-1][2]
    p = bigwig.write_bigwig(spark.createDataFrame(rows, "chr string, start long, stop long, value double"), {"1": 100_000, "2": 100_000}, str(tmp_path / "a.bw"))
    index = bigwig._Index(p)
    assert len(index.zooms) >= 3 and sorted(map(tuple, bigwig.read_bigwig(spark, p).collect())) == sorted(rows)
    data = (tmp_path / "a.bw").read_bytes()
    bases = {(c, x): v for c, start, stop, v in rows for x in range(start, stop)}
    for width, place, at in index.zooms:
        bins = {}
        for (c, x), v in sorted(bases.items()):
            bins.setdefault((c, x // width), []).append((x, v))
        wanted = sorted((int(c) - 1, v[0][0], v[-1][0] + 1, len(v), min(y for _, y in v), max(y for _, y in v), sum(y for _, y in v), sum(y * y for _, y in v)) for (c, _), v in bins.items())
        found = [r for a, n in index.blocks(None, None, None, at) for r in struct.iter_unpack("<IIIIffff", zlib.decompress(data[a : a + n]))]
        assert sorted(found) == wanted and struct.unpack_from("<I", data, place)[0] == len(wanted)
    assert len(wanted) <= 8 or index.zooms[-1][0] > 50_000
    empty = bigwig.write_bigwig(spark.createDataFrame(rows, "chr string, start long, stop long, value double").limit(0), {"1": 5}, str(tmp_path / "b.bw"))
    assert bigwig._Index(empty).zooms == []


def test_bigwig_tree_of_several_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bigwig, "_FANOUT", 3)
    monkeypatch.setattr(bigwig, "_ITEMS", 5)
    monkeypatch.setattr(bigwig, "_ZOOMS", 0)
    rows = [("1", i, i + 1, float(i)) for i in range(400)]
    p = bigwig.write_bigwig(spark.createDataFrame(rows, "chr string, start long, stop long, value double"), {"1": 400}, str(tmp_path / "a.bw"))
    assert len(list(bigwig._Index(p).blocks(None, None, None))) == 80
    assert sorted(tuple(r) for r in bigwig.read_bigwig(spark, p).collect()) == rows


def test_other_files_are_not_bigwig(spark, tmp_path):
    (tmp_path / "x.bw").write_bytes(b"nope")
    with pytest.raises(ValueError, match="not a BigWig"):
        bigwig.read_bigwig(spark, str(tmp_path / "x.bw"))


def test_whole_pipeline(spark, files, monkeypatch, capsys):
    path, seq, _ = files
    out = str(path / "out")
    first = pipeline.run(spark, bam=str(path / "r.bam"), ann=str(path / "a.gtf"), chromsize=str(path / "sizes"), offsets={28: 0}, outfilename=out)
    assert set(first) == {"bedgraph", "bigwig"}
    from_tran = pipeline.run(spark, tran=str(path / "t.fa"), ann=str(path / "a.gtf"), bigwig=first["bigwig"], outfilename=out + "_t")
    from_seq = pipeline.run(spark, seq=str(path / "g.fa"), ann=str(path / "a.gtf"), bigwig=first["bigwig"], outfilename=out + "_s")
    scored = [text.read_scored(spark, p["scored"]).orderBy("start").collect() for p in (from_tran, from_seq)]
    assert scored[0] == scored[1] and [(r.start, r.stop, r.type) for r in scored[0]] == [(30, 89, "CDS")]
    again = pipeline.run(spark, orfs=from_tran["orfs"], exon=from_tran["exons"], bigwig=first["bigwig"], outfilename=out + "_o")
    assert text.read_scored(spark, again["scored"]).orderBy("start").collect() == scored[0]
    last = pipeline.run(spark, plotfile=from_tran["scored"], exon=from_tran["exons"], bedfile=first["bedgraph"], outfilename=out + "_p")
    html = open(last["report"]).read()
    assert html.count("<svg") >= 3 and "T1" in html and "plotfile" in html
    cli.main(["--tran", str(path / "t.fa"), "--ann", str(path / "a.gtf"), "--outfilename", out + "_c", "--starts", "ATG,CTG"])
    assert "orfs:" in capsys.readouterr().out


def test_missing_inputs(spark):
    with pytest.raises(ValueError, match="outfilename"):
        pipeline.run(spark, tran="x", ann="y")
    with pytest.raises(ValueError, match="give bam"):
        pipeline.run(spark, bam="x", outfilename="o")
