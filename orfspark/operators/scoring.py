"""Coverage in transcript coordinates, and the scores of open reading frames over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import log_ratio, null_skipping_sum
from ..options import DEFAULT, Semantics
from ..schema import SCORES
from .intervals import overlap_join

#: Fixed value: the contig that is left out of coverage.
MITOCHONDRIAL = "chrM"


def coverage_to_transcript(coverage: DataFrame, exons: DataFrame, semantics: Semantics = DEFAULT) -> DataFrame:
    """(tran_id, tran_start, tran_stop, counts) of every coverage interval that overlaps an exon.

    Exons of one base and those on the mitochondrion give nothing. Exon bounds meet the half-open track as they are.
    """
    shift = 1 if semantics.one_based else 0
    usable = exons.where((F.col("chr") != MITOCHONDRIAL) & (F.col("start") != F.col("stop")))
    right = usable.select("chr", "tran_id", "strand", (F.col("start") - shift).alias("r_start"), F.col("stop").alias("r_stop"), F.col("tran_start").alias("__first"), F.col("tran_stop").alias("__last"))
    left = coverage.select("chr", F.col("start").alias("l_start"), F.col("stop").alias("l_stop"), F.col("value").alias("counts"))
    pairs = overlap_join(left, right, ["chr"])
    lead, tail = F.col("l_start") - F.col("r_start"), F.col("r_stop") - F.col("l_stop")
    if semantics.strand_aware:
        minus = F.col("strand") == "-"
        lead, tail = F.when(minus, tail).otherwise(lead), F.when(minus, lead).otherwise(tail)
    return pairs.select("tran_id", (F.col("__first") + lead).alias("tran_start"), (F.col("__last") - tail).alias("tran_stop"), "counts")


def _at_places(anchors: DataFrame, places: dict[str, Column], tran_reads: DataFrame, reach: int = 0, frames: bool = False) -> DataFrame:
    """``anchors`` with what reads say at each of the named ``places``; rows that repeat come back once.

    ``covered``: whether the transcript has reads. With ``reach``: {place}_before and {place}_after, the reads in the place's
    frame on the ``reach`` positions before and ``reach`` + 2 after it. With ``frames``: {place}_f0 to f2, the reads of each frame up
    to the place, {place}_n and {place}_n0, the rows with reads and those of frame 0; a place named "start" is itself left out.

    Reads and places are merged by position, and windows over positions answer all of them in one sort: the work grows with
    reads plus places, not with their product on a transcript. Both sides are read once and dealt once, by transcript, whose
    reads by position and open reading frames are no more than its bases.
    """
    keys = anchors.columns
    struct = lambda i, p: F.struct(F.lit(i).cast("byte").alias("place"), p.cast("long").alias("at"))
    each = F.explode(F.array(*(struct(i, p) for i, p in enumerate(places.values())))).alias("q")
    asked = anchors.select(*keys, each).select(*keys, "q.place", "q.at", F.lit(None).cast("double").alias("counts"))
    nothing = [F.lit(None).cast(anchors.schema[k].dataType).alias(k) for k in keys if k != "tran_id"]
    reads = tran_reads.select("tran_id", *nothing, F.lit(None).cast("byte").alias("place"), F.col("tran_start").alias("at"), "counts")
    merged = asked.unionByName(reads).repartition("tran_id")
    by_place = Window.partitionBy("tran_id").orderBy("at")
    frame = F.pmod("at", F.lit(3))
    columns = {"covered": F.max(F.col("place").isNull()).over(by_place.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing))}
    of_frame = lambda k, window: F.coalesce(F.sum(F.when(frame == k, F.col("counts"))).over(window), F.lit(0.0))
    if reach:
        for side, window in (("before", by_place.rangeBetween(-reach, -1)), ("after", by_place.rangeBetween(1, reach + 2))):
            columns[side] = F.when(frame == 0, of_frame(0, window)).when(frame == 1, of_frame(1, window)).otherwise(of_frame(2, window))
    if frames:
        some = F.col("counts") > 0
        for name, last in (("outside", -1), ("inside", 0)):
            window = by_place.rangeBetween(Window.unboundedPreceding, last)
            columns |= {f"{name}_f{k}": of_frame(k, window) for k in range(3)}
            columns |= {f"{name}_n": F.count_if(some).over(window), f"{name}_n0": F.count_if(some & (frame == 0)).over(window)}
    answered = merged.withColumns(columns).where("place is not null")
    # plain numbers, one row per place, so that they are gathered in hash maps
    gathered = []
    for i, name in enumerate(places):
        found = {k: k for k in ("before", "after") if reach} | {k: f"{'outside' if name == 'start' else 'inside'}_{k}" for k in ("f0", "f1", "f2", "n", "n0") if frames}
        gathered += [F.max(F.when(F.col("place") == i, F.col(c))).alias(f"{name}_{k}") for k, c in found.items()]
    return answered.groupBy(*keys, "covered").agg(*gathered)


def sru_scores(anchors: DataFrame, tran_reads: DataFrame, reach: int = 15, invert: bool = False) -> DataFrame:
    """(tran_id, anchor, sru): ln of (1 + reads after) over (1 + reads before) in the anchor's frame; inverted for stops.

    Reads are of the ``reach`` bases before and ``reach`` + 2 after; the anchor itself is left out.
    """
    summed = _at_places(anchors.select("tran_id", "anchor"), {"anchor": F.col("anchor")}, tran_reads, reach)
    before, after = F.col("anchor_before"), F.col("anchor_after")
    return summed.select("tran_id", "anchor", (log_ratio(before, after) if invert else log_ratio(after, before)).alias("sru"))


def _ends() -> dict[str, Column]:
    return {name: F.col(name) for name in ("start", "stop")}


def _frame_scores() -> dict[str, Column]:
    f = [F.col(f"stop_f{k}") - F.col(f"start_f{k}") for k in range(3)]
    rows, first = (F.col(f"stop_{n}") - F.col(f"start_{n}") for n in ("n", "n0"))
    codons = (F.col("stop") - F.col("start")) / F.lit(3.0)
    return {
        "hrf": F.when((f[1] != 0) & (f[2] != 0), F.try_divide(f[0], F.greatest(f[1], f[2]))).otherwise(0.0),
        "avg": F.when(f[0] != 0, F.try_divide(f[0], codons)).otherwise(0.0),
        "nzc": F.when(rows > 0, F.try_divide(first.cast("double"), rows)).otherwise(0.0),
    }


def frame_scores(orfs: DataFrame, tran_reads: DataFrame) -> DataFrame:
    """(tran_id, start, stop, hrf, avg, nzc) of each distinct range.

    hrf: reads in frame 0 over the larger of frames 1 and 2 (0 unless both have reads). avg: reads in frame 0 a codon.
    nzc: the share of frame 0 among positions with reads. Frames count from the transcript's first base.
    """
    summed = _at_places(orfs.select("tran_id", "start", "stop"), _ends(), tran_reads, frames=True)
    return summed.select("tran_id", "start", "stop", *(c.alias(n) for n, c in _frame_scores().items()))


def score_orfs(orfs: DataFrame, tran_reads: DataFrame, sru_range: int = 15, semantics: Semantics = DEFAULT) -> DataFrame:
    """Typed ORFs with rise_up, step_down, hrf, avg, nzc and their sum. ORFs on transcripts without reads are left out.

    uoORFs have no step-down and doORFs no rise-up: both are 0 there. With ``type_specific`` those two types have only the
    one, other types only the frame scores, and what a type lacks is null.
    """
    # rows that repeat are answered once and given back as often as they stand
    different = orfs.groupBy(*orfs.columns).agg(F.count(F.lit(1)).cast("int").alias("__times"))
    summed = _at_places(different, _ends(), tran_reads, sru_range, frames=True)
    rise, drop = (log_ratio(F.col(a), F.col(b)) for a, b in (("start_after", "start_before"), ("stop_before", "stop_after")))
    found = {"rise_up": rise, "step_down": drop} | _frame_scores()
    scored = summed.select(*orfs.columns, "__times", "covered", *(F.when(F.col("covered"), c).alias(n) for n, c in found.items()))
    if not semantics.keep_unscored:
        scored = scored.where("covered")
    scored = scored.withColumn("__times", F.explode(F.array_repeat(F.lit(1), F.col("__times"))))
    upstream, downstream = F.col("type") == "uoORF", F.col("type") == "doORF"
    if semantics.type_specific:
        none = F.lit(None).cast("double")
        keep = {"rise_up": upstream, "step_down": downstream} | dict.fromkeys(("hrf", "avg", "nzc"), ~upstream & ~downstream)
        scored = scored.withColumns({c: F.when(ok, F.col(c)).otherwise(none) for c, ok in keep.items()})
    else:
        scored = scored.withColumns({"rise_up": F.when(downstream & F.col("rise_up").isNotNull(), 0.0).otherwise(F.col("rise_up")), "step_down": F.when(upstream & F.col("step_down").isNotNull(), 0.0).otherwise(F.col("step_down"))})
    score = null_skipping_sum([F.col(c) for c in SCORES])
    if semantics.keep_unscored and not semantics.type_specific:
        score = F.when(F.col("hrf").isNotNull(), score)
    return scored.withColumn("score", score).select(*orfs.columns, *SCORES, "score")
