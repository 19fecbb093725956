"""Temperature mixing of sources, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Target entropy, as a share of that of equal weights, and the largest number of times that a source is repeated.
ENTROPY, REPEATS = 0.97, 2.0
#: Tokens of a block, about.
BLOCK_TOKENS = 1_000_000
#: Exponents tried by each pass over the source table.
_TRIES, _PASSES = 32, 6
_BITS = 12


def word_count() -> Column:
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"^[\x20\x09-\x0D]+", "")
    parts = F.size(F.split(text, r"[\x20\x09-\x0D]+"))
    return F.when(text == "", 0).otherwise(parts - F.when(text.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)).cast("long")


def exponent(sources: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """The exponent of token shares in [0, 1] whose weights have the target entropy, or the least one within ``repeats``.

    ``sources`` has a row (tokens) per source. Each pass narrows the interval around the target by aggregates over it, for
    several exponents at once, so sources may be many. One is returned where shares are as even as asked.
    """
    live = sources.where("tokens > 0")
    first = live.agg(F.sum(F.col("tokens").cast("double")), F.min("tokens"), F.max("tokens"), F.count(F.lit(1))).first()
    total, low, high, n = first
    if not n or n == 1 or low == high:
        return 1.0
    share = F.col("tokens") / F.lit(float(total))

    def entropies(tried: list[float]) -> list[float]:
        sums = [f for a in tried for f in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share)))]
        got = live.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
        return [(math.log(got[2 * i]) - a * got[2 * i + 1] / got[2 * i]) / math.log(n) for i, a in enumerate(tried)]

    lo, hi = 0.0, 1.0
    if entropies([1.0])[0] >= entropy:
        lo = 1.0
    else:
        for _ in range(_PASSES):
            tried = [lo + (hi - lo) * i / _TRIES for i in range(_TRIES + 1)]
            found = entropies(tried)
            at = max(i for i, h in enumerate(found) if i == 0 or h >= entropy)  # entropy falls as the exponent grows
            lo, hi = tried[at], tried[min(at + 1, _TRIES)]
    # all sources pass once or more, so the most repeated one passes (high / low) ** (1 - exponent) times
    within = max(0.0, 1 - math.log(repeats) / math.log(high / low))
    return max(lo, within)


def plan(sizes: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None) -> DataFrame:
    """(source, tokens, weight, passes, whole, cut) of each source, from ``sizes(source, draw, tokens)``.

    Documents with ``draw < cut`` take part ``whole + 1`` times, the others ``whole`` times. ``budget`` tokens are dealt out
    by weight; by default just enough that every source passes once, so no document is left out.
    """
    sources = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    spark = sizes.sparkSession
    scratch = Scratch(spark, "mixing")
    sources = scratch.save(sources, "sources")
    alpha = exponent(sources, entropy, repeats)
    total, = sources.agg(F.sum(F.col("tokens").cast("double"))).first()
    powered = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(total or 1.0), F.lit(alpha))).otherwise(0.0)
    z, = sources.agg(F.sum(powered)).first()
    weighed = sources.withColumn("weight", powered / F.lit(z or 1.0))
    if budget is None:
        budget, = weighed.where("weight > 0").agg(F.max(F.col("tokens") / F.col("weight"))).first()
    passes = F.when(F.col("weight") > 0, F.col("weight") * F.lit(float(budget or 0)) / F.col("tokens")).otherwise(1.0)
    # the last of many decimals must not turn a pass into one less
    weighed = weighed.withColumn("passes", F.round(passes, 9)).withColumn("whole", F.floor("passes").cast("int"))
    weighed = scratch.save(weighed.withColumn("wanted", (F.col("passes") - F.col("whole")) * F.col("tokens")), "weighed")

    # the cut: the end of the finest cell of draws in which the sum of tokens reaches what is wanted, found in two levels
    cell = lambda bits: F.shiftrightunsigned("draw", 64 - bits)
    ordered = Window.partitionBy("source")

    def crossing(cells: DataFrame) -> DataFrame:
        run = cells.withColumn("upto", F.sum("tokens").over(ordered.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        return run.join(weighed.select("source", "wanted"), "source").where("wanted > 0 and upto + offset >= wanted").groupBy("source").agg(F.min(F.struct("cell", (F.col("upto") + F.col("offset") - F.col("tokens")).alias("offset"))).alias("at"))

    coarse = sizes.groupBy("source", cell(_BITS).alias("cell")).agg(F.sum("tokens").alias("tokens")).withColumn("offset", F.lit(0).cast("long"))
    at = scratch.save(crossing(coarse).select("source", F.col("at.cell").alias("big"), F.col("at.offset").alias("offset")), "coarse")
    fine = sizes.withColumn("big", cell(_BITS)).join(at, ["source", "big"]).groupBy("source", cell(2 * _BITS).alias("cell"), "offset").agg(F.sum("tokens").alias("tokens"))
    cuts = crossing(fine).select("source", ((F.col("at.cell") + 1) * F.lit(1 << (63 - 2 * _BITS)).cast("long")).alias("cut"))
    out = weighed.join(cuts, "source", "left").select("source", "tokens", "weight", "passes", "whole", F.coalesce("cut", F.lit(0).cast("long")).alias("cut"))
    return scratch.save(out, "plan")


def _draw(*columns) -> Column:
    return F.xxhash64(*columns)


def _id_draw() -> Column:
    """The draw of a document: by its id, or by its text where it has none."""
    return F.when(F.col("doc_id").isNull(), _draw("text", F.lit(1))).otherwise(_draw("doc_id"))


def _small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Ready to be broadcast where it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def _copies(docs: DataFrame, planned: DataFrame) -> DataFrame:
    """``docs(source, draw, ...)`` with the plan's columns and ``copies``."""
    taken = F.shiftrightunsigned("draw", 1) < F.col("cut")
    return docs.join(_small(planned.withColumnRenamed("tokens", "source_tokens")), "source").withColumn("copies", F.col("whole") + taken.cast("int"))


def _sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), _id_draw().alias("draw"), word_count().alias("tokens"))


def mix(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per copy of a document in the mixture: doc_id, source, copy, tokens, block, position.

    Tokens are words of the whole text. A null source counts as the empty one; a null or empty text has no tokens and rides
    along. A source without tokens passes once, spread over all blocks. Rows that repeat an id share their place in the
    permutation and are taken together, as do rows with a null id and the same text; ties in it break by copy and id. Texts of
    any length are counted whole and never split. Extra columns are ignored; an empty table gives an empty result.

    Each pass of a source is a fresh permutation by hash. Its tokens are dealt to blocks in proportion to the weight, so
    every block holds each source's share up to a document; within a block a second hash gives the order.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.save(_sizes(docs), "sizes")
    planned = plan(sizes, entropy, repeats, budget)
    used, = planned.agg(F.sum(F.col("tokens") * F.col("passes"))).first()
    idle = sizes.join(_small(planned.where("weight = 0").select("source")), "source", "left_semi").count()
    blocks = max(1, int((used or 0) // block_tokens), idle // block_tokens)
    each = _copies(sizes, planned).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    each = each.withColumn("turn", _draw("draw", "copy")).withColumn("cell", F.shiftrightunsigned("turn", 64 - _BITS))
    each = each.select("doc_id", "source", "copy", "tokens", "turn", "cell", "weight", "source_tokens")
    by_cell = Window.partitionBy("source", "copy").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = each.groupBy("source", "copy", "cell").agg(F.sum("tokens").alias("cell_tokens")).withColumn("before", F.sum("cell_tokens").over(by_cell) - F.col("cell_tokens"))
    inside = Window.partitionBy("source", "copy", "cell").orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.join(cells.select("source", "copy", "cell", "before"), ["source", "copy", "cell"])
    at = F.col("copy") * F.col("source_tokens") + F.col("before") + F.sum("tokens").over(inside) - F.col("tokens")
    block = F.when(F.col("weight") > 0, F.floor(at / (F.col("weight") * F.lit(float(block_tokens))))).otherwise(F.pmod("turn", F.lit(blocks)))
    placed = placed.withColumn("block", block.cast("long"))
    order = Window.partitionBy("block").orderBy(_draw("turn", "block"), "copy", "doc_id")
    return placed.withColumn("position", F.row_number().over(order) - 1).select("doc_id", "source", "copy", "tokens", "block", F.col("position").cast("long").alias("position"))


def mixed(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> DataFrame:
    """Rows of ``docs``, each as often as the mixture takes it; all columns as they were, extra ones too. Texts are not shuffled.

    Nulls, empty and long texts, repeated rows, ties and sources without tokens count as in ``mix``; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    planned = plan(scratch.save(_sizes(docs), "sizes"), entropy, repeats)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(F.coalesce("source", F.lit("")).alias("source"), _id_draw().alias("draw"), row)
    return _copies(keyed, planned).select("row", F.explode_outer(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).where("copy is not null").select("row.*")
