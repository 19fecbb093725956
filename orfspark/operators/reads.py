"""Aligned reads: transcript and CDS coordinates, offsets by read length, A-site coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import read_count
from ..options import DEFAULT, Semantics
from .intervals import contain_join

#: Bases of the windows that ``windowed_reads`` counts from a chromosome's first exon.
WINDOW_BASES = 225_000
#: Positions that the change point scans, reads on each side of it, and the offset without one.
FIRST, LAST, SIDE, DEFAULT_OFFSET = -30, 10, 4, 15


def normalize_reads(reads: DataFrame, strict: bool = True, semantics: Semantics = DEFAULT) -> DataFrame:
    """count, chr, start, stop, length of ``reads(qname, rname, pos, end)``; the count is in the name.

    With ``dedupe_reads`` the name itself comes along as ``read_id``, and through the joins up to the A-sites.
    """
    name = [F.col("qname").alias("read_id")] if semantics.dedupe_reads else []
    return reads.select(read_count(F.col("qname"), strict).alias("count"), F.col("rname").cast("string").alias("chr"), F.col("pos").alias("start"), F.col("end").alias("stop"), (F.col("end") - F.col("pos")).alias("length"), *name)


def _named(df: DataFrame) -> list[str]:
    return ["read_id"] if "read_id" in df.columns else []


def reads_to_transcript(reads: DataFrame, exons: DataFrame, semantics: Semantics = DEFAULT) -> DataFrame:
    """One row per read and exon that holds it, with the read's place in that exon's transcript."""
    outer = exons.select("chr", "tran_id", "strand", F.col("start").alias("o_start"), F.col("stop").alias("o_stop"), F.col("tran_start").alias("__first"), F.col("tran_stop").alias("__last"))
    inner = reads.withColumn("i_start", F.col("start")).withColumn("i_stop", F.col("stop"))
    if semantics.windowed_reads:
        outer = outer.join(exons.groupBy("chr").agg(F.min("start").alias("__origin")), "chr")
    pairs = contain_join(inner, outer, ["chr"])
    if semantics.windowed_reads:
        number = lambda c: F.floor((F.col(c) - F.col("__origin")) / WINDOW_BASES)
        last = F.col("__origin") + (number("o_start") + 1) * WINDOW_BASES
        pairs = pairs.where((number("o_start") == number("i_start")) & (F.col("o_stop") <= last) & (F.col("i_stop") <= last))
    lead, tail = F.col("i_start") - F.col("o_start"), F.col("o_stop") - F.col("i_stop")
    if semantics.strand_aware:
        minus = F.col("strand") == "-"
        lead, tail = F.when(minus, tail).otherwise(lead), F.when(minus, lead).otherwise(tail)
    placed = pairs.withColumn("tran_start_bam", F.col("__first") + lead).withColumn("tran_stop_bam", F.col("__last") - tail)
    return placed.select("count", "chr", "start", "stop", "length", "tran_id", "tran_start_bam", "tran_stop_bam", *_named(reads))


def reads_to_cds(read_tran: DataFrame, cds: DataFrame) -> DataFrame:
    """Reads relative to the start of their transcript's CDS; those on transcripts without one are left out."""
    begin = cds.select("tran_id", F.col("tran_start").alias("__cds"))
    placed = read_tran.join(begin, "tran_id").withColumn("bamcds_start", F.col("tran_start_bam") - F.col("__cds"))
    return placed.select("count", "chr", "start", "stop", "length", "tran_id", "bamcds_start", *_named(read_tran))


def read_sites(read_cds: DataFrame) -> DataFrame:
    """``read_cds`` summed by place: count, chr, start, length, bamcds_start (and read_id).

    Offsets and coverage both start from it; written once, it saves the interval join from being computed for each.
    """
    return read_cds.groupBy("chr", "start", "length", "bamcds_start", *_named(read_cds)).agg(F.sum("count").alias("count"))


def length_profile(read_cds: DataFrame) -> DataFrame:
    """Counts by position relative to the CDS start and read length."""
    return read_cds.groupBy("bamcds_start", "length").agg(F.sum("count").alias("count"))


def estimate_offsets(read_cds: DataFrame, semantics: Semantics = DEFAULT) -> DataFrame:
    """(length, offset): the position with the largest jump between the means of the four before and the four after it.

    Positions run from -30 to 10, missing ones count 0, ties go to the first, and without any jump the offset is 15.
    """
    low, high = (F.lit(x).cast("long") for x in (FIRST - SIDE + 1, LAST + SIDE))
    at = F.col("bamcds_start")
    # of each length the counts in range, at most one per position
    inside = F.collect_list(F.when(at.between(low, high), F.struct(at.alias("at"), F.col("count"))))
    known = length_profile(read_cds).groupBy("length").agg(F.map_from_entries(inside).alias("known"))
    filled = known.select("length", "known", F.explode(F.sequence(low, high)).alias("bamcds_start"))
    filled = filled.select("length", "bamcds_start", F.coalesce(F.col("known")[F.col("bamcds_start")], F.lit(0)).alias("count"))
    order = Window.partitionBy("length").orderBy("bamcds_start")
    before, after = (F.avg("count").over(order.rowsBetween(*r)) for r in ((1 - SIDE, 0), (1, SIDE)))
    jumps = filled.withColumn("jump", F.abs(after - before)).where(F.col("bamcds_start").between(LAST if semantics.last_position_only else FIRST, LAST))
    best = F.max_by("bamcds_start", F.struct("jump", -F.col("bamcds_start")))
    found = jumps.groupBy("length").agg(F.max("jump").alias("jump"), best.alias("at"))
    return found.select("length", F.when(F.col("jump") > 0, F.col("at")).otherwise(DEFAULT_OFFSET).cast("long").alias("offset"))


def asite_coverage(read_cds: DataFrame, offsets: DataFrame, semantics: Semantics = DEFAULT) -> DataFrame:
    """(chr, `A-site`, stop, count): reads by A-site, the start moved by the offset of their length.

    A read counts once for each transcript that has it, or once in all with ``dedupe_reads``, told by read_id.
    """
    moved = read_cds.join(offsets, "length").withColumn("A-site", F.col("start") + semantics.offset_sign * F.col("offset"))
    if semantics.dedupe_reads:
        moved = moved.groupBy("chr", "A-site", "read_id").agg(F.max("count").alias("count"))
    return moved.groupBy("chr", "A-site").agg(F.sum("count").alias("count")).select("chr", "A-site", (F.col("A-site") + 1).alias("stop"), "count")
