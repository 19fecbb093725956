"""Connected components of links by hooking, pointer doubling and contraction, all as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) for every id in ``links(a, b)``; comp is the smallest id that can be reached.

    Each round hooks every root to its smallest neighbour, doubles pointers until all point to roots, and contracts the
    links; roots that still have links at least halve, so rounds grow with the logarithm of the number of ids.
    """
    edges = scratch.save(links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x > y").distinct(), f"{name}-edges-0")
    labels, old, step = None, [f"{name}-edges-0"], 0
    rows = most = edges.count()
    while True:
        hook = edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("comp"))
        parents = scratch.save(hook, f"{name}-hook-{step}", rows)
        old.append(f"{name}-hook-{step}")
        jump = 0
        while True:
            nxt = parents.alias("p").join(parents.alias("q"), F.col("p.comp") == F.col("q.node"), "left")
            nxt = nxt.select("p.node", F.coalesce("q.comp", "p.comp").alias("comp"), F.col("q.comp").isNotNull().alias("moved"))
            nxt = scratch.save(nxt, f"{name}-jump-{step}-{jump}", rows)
            old.append(f"{name}-jump-{step}-{jump}")
            moved = not nxt.where("moved").limit(1).isEmpty()
            parents = nxt.select("node", "comp")
            jump += 1
            if not moved:
                break
        if labels is None:
            seen = edges.select(F.col("x").alias("node")).union(edges.select("y")).distinct()
            labels = seen.select("node", F.col("node").alias("root"))
        labels = labels.alias("l").join(parents.alias("p"), F.col("l.root") == F.col("p.node"), "left")
        labels = scratch.save(labels.select("l.node", F.coalesce("p.comp", "l.root").alias("root")), f"{name}-labels-{step}", 2 * most)
        side = lambda e, c: e.join(parents.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_root")), c, "left")
        moved = side(side(edges, "x"), "y").select(F.coalesce("x_root", "x").alias("u"), F.coalesce("y_root", "y").alias("v"))
        step += 1
        edges = scratch.save(moved.where("u <> v").select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y")).distinct(), f"{name}-edges-{step}", rows)
        scratch.drop(*old, *([f"{name}-labels-{step - 2}"] if step > 1 else []))
        old = [f"{name}-edges-{step}"]
        rows = edges.count()
        if not rows:
            scratch.drop(*old)
            return labels.withColumnRenamed("root", "comp")
