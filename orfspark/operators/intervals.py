"""Interval joins by position bins: an equi-join on (key, bin) with the exact condition on top.

Spark has no interval join, and an equi-join on the chromosome alone pairs all reads of it with all exons of it. With bins
the pairs grow with the data, the exchange is keyed by many values, and adaptive execution can split a bin that is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases of a bin, about the length of a long exon, so most intervals lie in one or two.
BIN = 4096


def _bins(first: Column, last: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(first / size), F.floor(last / size)))


def contain_join(inner: DataFrame, outer: DataFrame, on: Sequence[str], size: int = BIN) -> DataFrame:
    """Pairs with ``inner``'s [i_start, i_stop] inside ``outer``'s [o_start, o_stop] and equal ``on`` columns.

    An inner interval is in the one bin of its start, so a pair is made once.
    """
    left = inner.withColumn("__bin", F.floor(F.col("i_start") / size))
    right = outer.where("o_start <= o_stop").withColumn("__bin", _bins(F.col("o_start"), F.col("o_stop"), size))
    inside = (F.col("i_start") >= F.col("o_start")) & (F.col("i_stop") <= F.col("o_stop"))
    return left.join(right, [*on, "__bin"]).where(inside).drop("__bin")


def overlap_join(left: DataFrame, right: DataFrame, on: Sequence[str], size: int = BIN) -> DataFrame:
    """Pairs of half-open intervals [l_start, l_stop) and [r_start, r_stop) that overlap, with equal ``on`` columns.

    Both sides take part in every bin they touch; a pair counts only in the first bin that it shares.
    """
    a = left.where("l_start < l_stop").withColumn("__bin", _bins(F.col("l_start"), F.col("l_stop") - 1, size))
    b = right.where("r_start < r_stop").withColumn("__bin", _bins(F.col("r_start"), F.col("r_stop") - 1, size))
    first = F.floor(F.greatest("l_start", "r_start") / size)
    both = (F.col("l_start") < F.col("r_stop")) & (F.col("l_stop") > F.col("r_start")) & (F.col("__bin") == first)
    return a.join(b, [*on, "__bin"]).where(both).drop("__bin")
