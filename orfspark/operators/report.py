"""Queries behind the report: best ORFs by type, metagene profiles, coverage of transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOP, RANGE = 10, 30


def top_orfs(scored: DataFrame, k: int = TOP) -> DataFrame:
    """The k best-scored ORFs of each type, with their ``rank``."""
    best = Window.partitionBy("type").orderBy(F.desc("score"), "tran_id", "start", "stop")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def metagene(orfs: DataFrame, tran_reads: DataFrame, anchor: str = "start", reach: int = RANGE) -> DataFrame:
    """(type, relativeloc, counts): reads by distance from the ORFs' starts (by read start) or stops (by read stop), zeros filled in.

    ORFs that share an anchor are counted together, so each read meets an anchor once, in bins as wide as the profile.
    """
    position = {"start": "tran_start", "stop": "tran_stop"}[anchor]
    width = 2 * reach + 1
    anchors = orfs.groupBy("tran_id", "type", F.col(anchor).alias("at")).agg(F.count(F.lit(1)).alias("times"))
    near = anchors.withColumn("bin", F.explode(F.array_distinct(F.array(F.floor((F.col("at") - reach) / width), F.floor((F.col("at") + reach) / width)))))
    reads = tran_reads.groupBy("tran_id", F.col(position).alias("pos")).agg(F.sum("counts").alias("counts")).withColumn("bin", F.floor(F.col("pos") / width))
    # anchors without reads stay, as their types have profiles of zeros; sums are by type and distance, so few
    away = F.col("pos") - F.col("at")
    pairs = near.join(reads, ["tran_id", "bin"], "left").withColumn("relativeloc", F.when(away.between(-reach, reach), away))
    sums = pairs.groupBy("type", "relativeloc").agg(F.sum(F.col("counts") * F.col("times")).alias("counts"))
    known = F.collect_list(F.when(F.col("relativeloc").isNotNull(), F.struct("relativeloc", "counts")))
    by_type = sums.groupBy("type").agg(F.map_from_entries(known).alias("known"))
    spine = by_type.withColumn("relativeloc", F.explode(F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"))))
    return spine.select("type", "relativeloc", F.coalesce(F.col("known")[F.col("relativeloc")], F.lit(0.0)).alias("counts"))


def transcript_profile(transcripts: DataFrame, tran_reads: DataFrame) -> DataFrame:
    """(tran_id, tran_start, frame, counts) of the reads on ``transcripts(tran_id)``."""
    wanted = tran_reads.join(transcripts.select("tran_id").distinct(), "tran_id", "left_semi")
    return wanted.groupBy("tran_id", "tran_start").agg(F.sum("counts").alias("counts")).withColumn("frame", F.pmod("tran_start", F.lit(3)).cast("int")).select("tran_id", "tran_start", "frame", "counts")


def rounded(scored: DataFrame, digits: int = 2) -> DataFrame:
    """Score columns rounded for display."""
    return scored.withColumns({c: F.round(F.col(c), digits) for c in ("rise_up", "step_down", "hrf", "avg", "nzc", "score")})
