"""Annotation: transcript ids, exons and coding regions in transcript coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import join_longs, split_longs, transcript_id

_EXON = ["chr", "tran_id", "strand", "exon_idx", "start", "stop", "tran_start", "tran_stop"]


def with_transcript_id(annotation: DataFrame) -> DataFrame:
    return annotation.withColumn("tran_id", transcript_id(F.col("attributes"))).drop("attributes")


def exon_coords(annotation: DataFrame, transcripts: DataFrame | None = None) -> DataFrame:
    """Exons with their 0-based inclusive place in the transcript: a running sum of lengths, from the 5' end of the strand.

    ``annotation`` has chr, type, start, stop, strand, tran_id. Strands other than + and - are left out. ``transcripts``
    (tran_id) restricts the result. The order within a transcript is by position, whatever the file's.
    """
    exons = annotation.where((F.col("type") == "exon") & F.col("strand").isin("+", "-"))
    if transcripts is not None:
        exons = exons.join(transcripts.select("tran_id").distinct(), "tran_id", "left_semi")
    forward = F.when(F.col("strand") == "+", F.col("start")).otherwise(-F.col("start"))
    order = Window.partitionBy("tran_id").orderBy(forward, "stop", "chr")
    upto = F.sum(F.col("stop") - F.col("start") + 1).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = exons.withColumn("exon_idx", F.row_number().over(order) - 1).withColumn("tran_stop", upto - 1)
    return placed.withColumn("tran_start", F.col("tran_stop") - (F.col("stop") - F.col("start"))).select(_EXON)


def cds_coords(annotation: DataFrame, exons: DataFrame) -> DataFrame:
    """(tran_id, tran_start, tran_stop): the extent of the CDS segments that lie inside one exon of their transcript."""
    segments = annotation.where(F.col("type") == "CDS").select("tran_id", F.col("start").alias("c_start"), F.col("stop").alias("c_stop"))
    inside = F.col("c_start").between(F.col("start"), F.col("stop")) & F.col("c_stop").between(F.col("start"), F.col("stop"))
    pairs = segments.join(exons, "tran_id").where(inside)
    lead, tail = F.col("c_start") - F.col("start"), F.col("stop") - F.col("c_stop")
    plus = F.col("strand") == "+"
    first = F.col("tran_start") + F.when(plus, lead).otherwise(tail)
    last = F.col("tran_stop") - F.when(plus, tail).otherwise(lead)
    return pairs.groupBy("tran_id").agg(F.min(first).alias("tran_start"), F.max(last).alias("tran_stop"))


def pack_exons(exons: DataFrame) -> DataFrame:
    """One row per transcript with comma-joined coordinates, in transcript order: the layout of the exon file."""
    one = F.struct("exon_idx", "chr", "start", "stop", "tran_start", "tran_stop")
    packed = exons.groupBy("tran_id").agg(F.array_sort(F.collect_list(one)).alias("e"))
    joined = [join_longs(F.col(f"e.{c}")).alias(c) for c in ("start", "stop", "tran_start", "tran_stop")]
    return packed.select(F.element_at("e.chr", 1).alias("chr"), "tran_id", *joined)


def unpack_exons(packed: DataFrame, strand: str = "+") -> DataFrame:
    """The exon table of an exon file. The file has no strand; ``strand`` is filled in."""
    lists = [split_longs(F.col(c)).alias(c) for c in ("start", "stop", "tran_start", "tran_stop")]
    rows = packed.select("chr", "tran_id", F.posexplode(F.arrays_zip(*lists)).alias("exon_idx", "e"))
    return rows.select("chr", "tran_id", F.lit(strand).alias("strand"), "exon_idx", "e.start", "e.stop", "e.tran_start", "e.tran_stop")
