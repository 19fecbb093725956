"""Sequences: spliced transcripts, codon positions, open reading frames and their types."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import reverse_complement
from ..options import DEFAULT, Semantics

STARTS, STOPS = ("ATG",), ("TAA", "TAG", "TGA")


def spliced_transcripts(genome: DataFrame, exons: DataFrame) -> DataFrame:
    """(tran_id, seq) from contigs ``genome(chr, seq)``: exon sequences (1-based inclusive) in transcript order, 5' to 3'.

    Exons meet the tiles of a contig that they overlap, not the contig, so a long one is not one key.
    """
    return spliced_from_chunks(genome.select("chr", F.lit(0).cast("long").alias("offset"), F.coalesce("seq", F.lit("")).alias("seq")), exons)


#: Positions of a tile, the part of a chunk that an exon is cut from.
TILE = 4096


def chunk_offsets(chunks: DataFrame, cell: int = 4096) -> DataFrame:
    """``chunks(chr, id, seq)`` with ``offset``, the length of what comes before it in its contig by id (then by sequence).

    Lengths are summed by cells of ``cell`` ids, then over the cells before, so no task has all chunks of a contig.
    """
    sized = chunks.withColumn("seq", F.coalesce("seq", F.lit(""))).withColumn("size", F.length("seq").cast("long")).withColumn("cell", F.floor(F.col("id") / cell))
    upto = lambda order, *keys: Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = sized.groupBy("chr", "cell").agg(F.sum("size").alias("total"))
    cells = cells.select("chr", "cell", (F.sum("total").over(upto(["cell"], "chr")) - F.col("total")).alias("before"))
    placed = sized.withColumn("inner", F.sum("size").over(upto(["id", "seq"], "chr", "cell")) - F.col("size"))
    return placed.join(cells, ["chr", "cell"]).select("chr", (F.col("before") + F.col("inner")).alias("offset"), "seq")


def spliced_from_chunks(chunks: DataFrame, exons: DataFrame, tile: int = TILE) -> DataFrame:
    """(tran_id, seq) of contigs in ``chunks(chr, offset, seq)``: each exon is cut from the tiles that it overlaps."""
    last = exons.groupBy("chr").agg(F.max("stop").alias("last"))
    size, end = F.length("seq").cast("long"), F.col("offset") + F.length("seq")
    bins = F.sequence(F.floor(F.col("offset") / tile), F.floor((end - 1) / tile))
    at, stop = lambda b: F.greatest(b * tile, F.col("offset")), lambda b: F.least((b + 1) * tile, end)
    cut = lambda b: F.struct(b.alias("bin"), at(b).alias("at"), F.substring(F.col("seq"), (at(b) - F.col("offset") + 1).cast("int"), (stop(b) - at(b)).cast("int")).alias("text"))
    tiles = chunks.join(last, "chr").where((size > 0) & (F.col("offset") < F.col("last"))).select("chr", F.explode(F.transform(bins, cut)).alias("tile")).select("chr", "tile.*")
    # a contig without what an exon asks for gives it an empty piece
    known = exons.join(chunks.select("chr").distinct(), "chr", "left_semi").withColumn("first", F.col("start") - 1)
    asked = known.withColumn("bin", F.explode(F.sequence(F.floor(F.col("first") / tile), F.floor(F.greatest(F.col("stop") - 1, F.col("first")) / tile))))
    wanted = asked.select("chr", "bin").distinct()
    tiles = tiles.join(wanted, ["chr", "bin"], "left_semi")
    low, high = F.greatest("first", "at"), F.least("stop", F.col("at") + F.length("text"))
    piece = F.when(high > low, F.substring(F.col("text"), (low - F.col("at") + 1).cast("int"), (high - low).cast("int"))).otherwise("")
    pieces = asked.join(tiles, ["chr", "bin"], "left").withColumn("piece", F.coalesce(F.when(F.col("strand") == "-", reverse_complement(piece)).otherwise(piece), F.lit("")))
    order = F.when(F.col("strand") == "-", -F.col("at")).otherwise(F.col("at")).alias("order")
    parts = F.array_sort(F.collect_list(F.struct("exon_idx", order, "piece")))
    return pieces.groupBy("tran_id").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("seq"))


def normalised(transcripts: DataFrame) -> DataFrame:
    """Sequences in upper case, with T for U."""
    return transcripts.withColumn("seq", F.translate(F.upper("seq"), "U", "T"))


def _hits(transcripts: DataFrame, codons: Sequence[str]) -> DataFrame:
    """(tran_id, row, size, tail, pos, codon) of every occurrence; ``row`` tells sequences of one id apart, ``size`` is the
    sequence's length, ``tail`` its last three bases.

    The sequence is split before each codon by one look-ahead expression, so only occurrences become rows, and positions are
    running sums of the pieces' lengths.
    """
    if not codons or any(len(c) != 3 for c in codons):
        raise ValueError("codons have three letters")
    ahead = "(?=" + "|".join(re.escape(c) for c in dict.fromkeys(codons)) + ")"
    # sequences are dealt out before they are split: the windows need no further exchange, and size and tail are computed once
    whole = transcripts.select("tran_id", "seq", F.length("seq").cast("long").alias("size"), F.substring("seq", -3, 3).alias("tail")).repartition("tran_id")
    # a number per sequence, given where it is split and used in the same task
    whole = whole.withColumn("row", F.monotonically_increasing_id())
    pieces = whole.select("tran_id", "row", "size", "tail", F.posexplode(F.split("seq", ahead)).alias("k", "piece"))
    # a codon may run on into the next two pieces, which begin within it
    window = Window.partitionBy("tran_id", "row").orderBy("k")
    at = F.coalesce(F.sum(F.length("piece")).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    text = F.concat("piece", F.coalesce(F.lead("piece", 1).over(window), F.lit("")), F.coalesce(F.lead("piece", 2).over(window), F.lit("")))
    found = pieces.select("tran_id", "row", "size", "tail", at.alias("pos"), F.substring(text, 1, 3).alias("codon"))
    return found.where(F.col("codon").isin(*codons))


def codon_positions(transcripts: DataFrame, codons: Sequence[str]) -> DataFrame:
    """(tran_id, pos, codon) of every occurrence, overlapping ones too; ``pos`` is 0-based."""
    return _hits(transcripts, codons).select("tran_id", "pos", "codon")


def find_orfs(
    transcripts: DataFrame, starts: Sequence[str] = STARTS, stops: Sequence[str] = STOPS, minlen: int = 0, maxlen: int = 1_000_000, semantics: Semantics = DEFAULT
) -> DataFrame:
    """One row per start codon, nested ones too: tran_id, start, stop, length, startorf, stoporf. Sequences that share an id are
    searched one by one, as each row of ``transcripts`` is a sequence of its own.

    ``stop`` is the last base of the first stop codon further on in the frame; without one it is the sequence's length and
    ``stoporf`` its last three bases. ``length`` counts from the start codon's last base; both bounds are exclusive.
    """
    stop = F.when(F.col("codon").isin(*stops), F.struct(F.col("pos").alias("pos"), F.col("codon").alias("codon")))
    # from the 3' end on, the last stop seen is the nearest one downstream
    behind = Window.partitionBy("tran_id", "row", F.col("pos") % 3).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    hits = _hits(normalised(transcripts) if semantics.normalize else transcripts, [*starts, *stops]).withColumn("next", F.last(stop, ignorenulls=True).over(behind))
    orfs = hits.where(F.col("codon").isin(*starts)).select(
        "tran_id", F.col("pos").alias("start"), F.coalesce(F.col("next.pos") + 2, "size").alias("stop"), F.col("codon").alias("startorf"), F.coalesce("next.codon", "tail").alias("stoporf")
    )
    orfs = orfs.withColumn("length", F.col("stop") - (F.col("start") + 2))
    return orfs.where((F.col("length") > minlen) & (F.col("length") < maxlen)).select("tran_id", "start", "stop", "length", "startorf", "stoporf")


def classify_orfs(orfs: DataFrame, cds: DataFrame, semantics: Semantics = DEFAULT) -> DataFrame:
    """``orfs`` with ``type``, by where each lies relative to its transcript's CDS; "Non Coding" without one."""
    last = F.col("tran_stop") + (3 if semantics.stop_codon_in_cds else 0)
    coding = cds.select("tran_id", F.col("tran_start").alias("__first"), last.alias("__last"))
    start, stop, a, b = (F.col(c) for c in ("start", "stop", "__first", "__last"))
    rules = [
        (a.isNull(), "Non Coding"), (stop < a, "uORF"), ((start == a) & (stop == b), "CDS"), (start > b, "dORF"),
        ((start < a) & (stop >= a), "uoORF"), ((start <= b) & (stop > b), "doORF"), ((start >= a) & (stop <= b), "iORF"),
    ]
    if semantics.strict_types:
        rules[4:4] = [((start < a) & (stop > b), "eoORF"), ((start < a) & (stop == b), "extORF")]
    label = F
    for condition, name in rules:
        label = label.when(condition, name)
    return orfs.join(coding, "tran_id", "left").withColumn("type", label.otherwise("Unexpected")).drop("__first", "__last")
