"""Exact nearest binary codes by multi-index hashing with growing segment radii."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

BITS, NEAREST = 64, 10
#: Every row whose id this divides is a query.
QUERY_STEP = 50
#: Distinct codes of an index shard, and distinct query codes of a block, at most about.
SHARD, QUERIES = 50_000, 20_000
#: Query codes of a block, at least, where shards alone would leave cores without work.
FEWEST = 100


def sign_code(vector: str, bits: int = BITS) -> Column:
    """Bit i is set where element i is positive; missing and null elements give 0."""
    one = lambda i: F.when(F.coalesce(F.get(F.col(vector), F.lit(i)), F.lit(0.0)) > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    parts = [one(i) for i in range(bits)]
    while len(parts) > 1:
        parts = [parts[i].bitwiseOR(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


@cache
def _masks(width: int, radius: int) -> np.ndarray:
    """All masks of ``width`` bits with ``radius`` of them set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.uint64)


class MultiIndex:
    """Codes under one sorted table per segment."""

    def __init__(self, codes: np.ndarray, firsts: np.ndarray):
        self.codes, self.firsts = codes, firsts
        # segments about as wide as the logarithm of the number of codes keep buckets near one code
        n = max(1, round(BITS / max(4.0, min(16.0, np.log2(max(len(codes), 2))))))
        edges = [BITS * i // n for i in range(n + 1)]
        self.tables = []
        for low, high in zip(edges, edges[1:], strict=False):
            values = (codes >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
            order = np.argsort(values, kind="stable")
            self.tables.append((low, high - low, values[order], order))

    def nearest(self, query: np.uint64, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances of the k codes with the least (distance, first id).

        After radius r of every segment all codes within n * (r + 1) - 1 have been seen, as one nearer differs in at most r
        bits of some segment. The search ends once the k-th distance found is within that.
        """
        found = np.zeros(0, np.int64)
        for r in range(max(w for _, w, _, _ in self.tables) + 1):
            parts = [found]
            for low, width, values, order in self.tables:
                if r > width:
                    continue
                probes = _masks(width, r) ^ ((query >> np.uint64(low)) & np.uint64((1 << width) - 1))
                a, b = np.searchsorted(values, probes), np.searchsorted(values, probes, side="right")
                n = b - a
                parts.append(order[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())])
            found = np.unique(np.concatenate(parts))
            distance = np.bitwise_count(self.codes[found] ^ query).astype(np.int64)
            best = np.lexsort((self.firsts[found], distance))[:k]
            if len(best) == min(k, len(self.codes)) and distance[best[-1]] <= len(self.tables) * (r + 1) - 1:
                break
            found = found[best]  # what k others precede can never be among the k nearest
        return found[best], distance[best]


def nearest_codes(vectors: DataFrame, k: int = NEAREST, step: int = QUERY_STEP) -> DataFrame:
    """One row per query and rank: vec_id, rank (from 1), neighbor_id, distance, from ``vectors(vec_id, embedding)``.

    Queries are the rows whose id ``step`` divides; all rows, the query itself included, are searched. Equal distances go by
    id. Rows with a null vector have no code: they neither search nor are found; nor are rows with a null id. An empty
    vector's code is 0; null elements count as not positive, NaN as positive, and elements beyond the 64th are left out. Rows that
    repeat an id count as often as they stand. With fewer than k rows all are returned. Extra columns are ignored; an empty table
    gives an empty result. There are no texts.

    Codes are searched once however many rows share them. Shards of distinct codes, spread by hash, each carry a multi-index;
    a block of queries meets every shard, and only the k nearest of each leave it.
    """
    scratch = Scratch(vectors.sparkSession, "hamming")
    coded = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), sign_code("embedding").alias("code"))
    coded = scratch.save(coded, "coded")
    classes = scratch.save(coded.groupBy("code").agg(F.min("vec_id").alias("first")), "classes")
    queries = coded.where(F.col("vec_id") % step == 0)
    distinct = scratch.save(queries.select("code").distinct(), "queries")
    shards, asked = max(1, -(-classes.count() // SHARD)), distinct.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-asked // QUERIES), min(-(-cores // shards), asked // FEWEST))
    part = lambda n, seed: F.pmod(F.xxhash64("code", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = classes.select("code", "first", part(shards, 1).alias("shard"), every(blocks).alias("block"))
    right = distinct.select("code", part(blocks, 2).alias("block"), every(shards).alias("shard"))

    def search(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        if len(own) and len(asked):
            codes = own["code"].to_numpy(np.int64)
            index = MultiIndex(codes.view(np.uint64), own["first"].to_numpy())
            for q in asked["code"].to_numpy(np.int64):
                at, distance = index.nearest(np.int64(q).view(np.uint64), k)
                out.append((np.full(len(at), q), codes[at], index.firsts[at], distance))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pd.DataFrame(dict(zip(("asked", "code", "first", "distance"), columns, strict=True)))

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "asked long, code long, first long, distance int")
    best = Window.partitionBy("asked").orderBy("distance", "first")
    found = scratch.save(found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place"), "found")
    by_code = Window.partitionBy("code").orderBy("vec_id")
    members = coded.join(found.select("code").distinct(), "code", "left_semi").withColumn("place", F.row_number().over(by_code)).where(F.col("place") <= k)
    members = members.select("code", F.col("vec_id").alias("neighbor_id"), "place")
    spread = found.join(members, "code").withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy("distance", "neighbor_id", "place"))).where(F.col("rank") <= k)
    answers = queries.join(spread.select(F.col("asked").alias("code"), "rank", "neighbor_id", "distance"), "code")
    return answers.select("vec_id", "rank", "neighbor_id", "distance")
