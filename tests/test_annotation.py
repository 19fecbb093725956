import pytest
from pyspark.sql import functions as F

from orfspark import schema
from orfspark.functions import join_longs, read_count, reverse_complement, split_longs, transcript_id
from orfspark.operators import annotation as an
from orfspark.operators import reads as rd
from orfspark.options import Semantics

ANN = ["chr", "type", "start", "stop", "strand", "tran_id"]


@pytest.mark.parametrize(
    "attributes, expected",
    [
        ('gene_id "G"; transcript_id "ENST1.2"; x "y"', "ENST1.2"),
        ('transcript_id "ENST1.2"; x', ""),  # no leading space
        ("ID=transcript:ENST7;Parent=gene:G", "ENST7"),
        ("Parent=transcript:ENST8:x;rank=1", "ENST8"),
        ("ID=x;transcript_id=T9", "T9"),
        ('transcript_id=A; transcript_id "B"', "A"),  # the first attribute that names one
        ("gene_id=G", ""),
        ("", ""),
        (None, None),
    ],
)
def test_transcript_id(spark, attributes, expected):
    df = spark.createDataFrame([(attributes,)], "a string")
    assert df.select(transcript_id(F.col("a"))).first()[0] == expected


def test_column_functions(spark):
    df = spark.createDataFrame([("r1_x12", "AAcgT", [1, 2, 30])], "q string, s string, l array<bigint>")
    row = df.select(read_count(F.col("q")).alias("n"), reverse_complement(F.col("s")).alias("r"), join_longs(F.col("l")).alias("j"), split_longs(join_longs(F.col("l"))).alias("b")).first()
    assert (row.n, row.r, row.j, row.b) == (12, "AcgTT", "1,2,30", [1, 2, 30])


def test_read_count_without_a_number(spark):
    df = spark.createDataFrame([("r1",)], "q string")
    assert df.select(read_count(F.col("q"), strict=False)).first()[0] is None
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        df.select(read_count(F.col("q"))).collect()


def test_exon_coords_of_the_plus_strand(spark):
    rows = [("1", "exon", a, b, "+", "T") for a, b in ((11869, 14409), (12613, 12721), (13221, 14409))]
    got = an.exon_coords(spark.createDataFrame(rows, ANN)).orderBy("exon_idx").collect()
    assert [r.tran_start for r in got] == [0, 2541, 2650]
    assert [r.tran_stop for r in got] == [2540, 2649, 3838]


@pytest.mark.parametrize("order", [(0, 1), (1, 0)])
def test_exon_coords_of_the_minus_strand_in_any_order(spark, order):
    rows = [[("1", "exon", 100, 109, "-", "T"), ("1", "exon", 200, 204, "-", "T")][i] for i in order]
    got = {r.start: (r.tran_start, r.tran_stop) for r in an.exon_coords(spark.createDataFrame(rows, ANN)).collect()}
    assert got == {200: (0, 4), 100: (5, 14)}


def test_other_strands_and_transcripts_are_left_out(spark):
    rows = [("1", "exon", 1, 5, ".", "A"), ("1", "exon", 1, 5, "+", "B"), ("1", "exon", 1, 5, "+", "C")]
    wanted = spark.createDataFrame([("C",), ("A",)], "tran_id string")
    assert [r.tran_id for r in an.exon_coords(spark.createDataFrame(rows, ANN), wanted).collect()] == ["C"]


def test_cds_coords(spark):
    ann = spark.createDataFrame(
        [
            ("1", "exon", 100, 199, "+", "P"), ("1", "exon", 300, 399, "+", "P"), ("1", "CDS", 150, 199, "+", "P"), ("1", "CDS", 300, 320, "+", "P"),
            ("1", "exon", 100, 199, "-", "M"), ("1", "exon", 300, 399, "-", "M"), ("1", "CDS", 310, 399, "-", "M"), ("1", "CDS", 150, 199, "-", "M"),
            ("1", "exon", 100, 199, "+", "X"), ("1", "CDS", 190, 205, "+", "X"),  # not inside an exon
        ], ANN,
    )
    got = {r.tran_id: (r.tran_start, r.tran_stop) for r in an.cds_coords(ann, an.exon_coords(ann)).collect()}
    # minus strand: 310..399 is the first 90 bases, 150..199 goes on to base 100 + 49
    assert got == {"P": (50, 120), "M": (0, 149)}


def test_exon_file_round_trip(spark):
    rows = [("1", "exon", 100, 109, "+", "T"), ("1", "exon", 200, 204, "+", "T")]
    exons = an.exon_coords(spark.createDataFrame(rows, ANN))
    packed = an.pack_exons(exons)
    assert packed.first().asDict() == {"chr": "1", "tran_id": "T", "start": "100,200", "stop": "109,204", "tran_start": "0,10", "tran_stop": "9,14"}
    assert sorted(map(tuple, an.unpack_exons(packed).collect())) == sorted(map(tuple, exons.collect()))


EXONS = [("1", "T", "+", 0, 1000, 1099, 0, 99), ("1", "T", "+", 1, 2000, 2099, 100, 199), ("1", "U", "-", 0, 1000, 1099, 0, 99)]


def _norm(spark, rows):
    return spark.createDataFrame([(n, "1", a, b, b - a) for n, a, b in rows], "count long, chr string, start long, stop long, length long")


def test_reads_count_once_for_each_exon_that_holds_them(spark):
    exons = spark.createDataFrame(EXONS, schema.EXON)
    got = rd.reads_to_transcript(_norm(spark, [(2, 1010, 1040), (1, 1090, 1120), (5, 2000, 2099)]), exons).collect()
    assert sorted((r["count"], r.tran_id, r.tran_start_bam, r.tran_stop_bam) for r in got) == [(2, "T", 10, 40), (2, "U", 10, 40), (5, "T", 100, 199)]
    aware = rd.reads_to_transcript(_norm(spark, [(2, 1010, 1040)]), exons, Semantics(strand_aware=True)).where("tran_id = 'U'").first()
    assert (aware.tran_start_bam, aware.tran_stop_bam) == (59, 89)


def test_windowed_reads_drop_what_straddles(spark):
    exons = spark.createDataFrame([("1", "A", "+", 0, 1, 100, 0, 99), ("1", "B", "+", 0, 224_990, 225_050, 0, 60), ("1", "C", "+", 0, 225_010, 225_050, 0, 40)], schema.EXON)
    reads = _norm(spark, [(1, 5, 30), (1, 225_000, 225_030), (1, 225_015, 225_030)])
    names = lambda s: sorted(r.tran_id for r in rd.reads_to_transcript(reads, exons, s).collect())
    assert names(Semantics()) == ["A", "B", "B", "C"]
    assert names(Semantics(windowed_reads=True)) == ["A", "C"]


def test_offsets(spark):
    flat = [(1, -40 + i, 28) for i in range(60)]
    jump = [(1 if p < -12 else 9, p, 30) for p in range(-33, 15)]
    none = [(3, 100, 35)]
    df = spark.createDataFrame([(n, "1", 0, 0, length, "T", p) for n, p, length in (*flat, *jump, *none)], "count long, chr string, start long, stop long, length long, tran_id string, bamcds_start long")
    got = {r.length: r.offset for r in rd.estimate_offsets(df).collect()}
    assert got == {28: 15, 30: -13, 35: 15}
    last = {r.length: r.offset for r in rd.estimate_offsets(df, Semantics(last_position_only=True)).collect()}
    assert last == {28: 15, 30: 15, 35: 15}


def test_asite_coverage(spark):
    df = spark.createDataFrame([(2, "1", 100, 130, 30, "T", 0), (3, "1", 101, 130, 29, "T", 1)], "count long, chr string, start long, stop long, length long, tran_id string, bamcds_start long")
    offsets = spark.createDataFrame([(30, 12), (29, 11)], schema.OFFSETS)
    assert [tuple(r) for r in rd.asite_coverage(df, offsets).collect()] == [("1", 112, 113, 5)]
    assert sorted(tuple(r) for r in rd.asite_coverage(df, offsets, Semantics(offset_sign=-1)).collect()) == [("1", 88, 89, 2), ("1", 90, 91, 3)]
