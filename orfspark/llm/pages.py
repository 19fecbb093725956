"""Main text of web pages, with site templates found by counting element subtrees per host."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import column, steps
from .html import article, counted, parse
from .scratch import Scratch

#: A subtree is a template of its host where it stands beside so many different articles, and beside this share of the host's.
LEAST_PAGES, LEAST_SHARE = 5, 0.2
#: Beside so many different articles it is one whatever their share. Prose (a line, a list item) needs the share, as short ones recur by chance.
MANY_PAGES = 100
#: Templates that a broadcast may hold, 8 bytes and a host name each, and pages with their templates; beyond it both are shuffled.
BROADCAST_TEMPLATES, BROADCAST_PAGES = 200_000, 20_000


def _host() -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


#: One row per page: its article's blocks; the subtrees that may be deleted, with their first and last block; the subtrees that
#: count towards a template, each with a hash of the article without it; and a hash of the whole article.
_READ = (
    "page_id long, url string, host string, blocks array<string>, trees array<struct<subtree: long, low: int, high: int>>, "
    "counted array<struct<subtree: long, prose: boolean, rest: long>>, whole long"
)


def _lists(parts: list[list], make: Callable[[list], pa.Array]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), make([x for p in parts for x in p]))


def read_pages(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html, host)`` parsed, once each; see ``_READ``."""
    signed = lambda x: pa.array([v - (1 << 63) for v in x], pa.int64())
    text = lambda x: pa.array(x, pa.string())
    span = lambda x: pa.StructArray.from_arrays([signed([t[0] for t in x]), *(pa.array([t[k] for t in x], pa.int32()) for k in (1, 2))], ["subtree", "low", "high"])
    tree = lambda x: pa.StructArray.from_arrays([signed([c[0] for c in x]), pa.array([c[1] for c in x], pa.bool_()), signed([c[2] for c in x])], ["subtree", "prose", "rest"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "html"):
            read = [parse(text or "") for text in column(step, "html").to_pylist()]
            parts = [article(p) for p in read]
            found = [_lists([p[0] for p in parts], text), _lists([p[1] for p in parts], span), _lists([counted(p) for p in read], tree), signed([p.elements[p.main].digest for p in read])]
            yield pa.RecordBatch.from_arrays([*(column(step, c) for c in ("page_id", "url", "host")), *found], ["page_id", "url", "host", "blocks", "trees", "counted", "whole"])

    return pages.select("page_id", "url", "html", "host").mapInArrow(rows, _READ)


def templates(read: DataFrame) -> DataFrame:
    """(host, subtree) of the subtrees that stand beside enough different articles of their host."""
    each = read.select("host", F.explode("counted").alias("c")).select("host", "c.subtree", "c.prose", "c.rest").distinct()
    times = each.groupBy("host", "subtree", "prose").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= LEAST_PAGES)
    sizes = read.select("host", "whole").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("articles"))
    enough = (F.col("times") >= LEAST_SHARE * F.col("articles")) | (~F.col("prose") & (F.col("times") >= MANY_PAGES))
    return times.join(sizes, "host").where(enough).select("host", "subtree").distinct()


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    A null or empty page has an empty text. The text is that of an article with over three quarters of the text
    of its main element or page; else of the main element; else of the innermost element that holds all articles, in page
    order. A page without an article or main element is judged by its body. Pages with a
    null url share the empty host. Copies of an article do not make its parts a template: a subtree counts once for each
    different rest of the article and is compared with the host's different articles, and plain prose inside a marked article
    is never deleted for recurring. A large part of an article does not count, but goes where it is a template by other
    pages, unless nothing else is left. Repeated rows get equal rows; ties do not arise. Pages of any length are read whole.
    Extra columns are ignored; an empty table gives an empty result.

    Python reads each page once, where it lies; counting subtrees per host, finding each page's templates and putting its text
    together are joins and functions over what was read.
    """
    scratch = Scratch(pages.sparkSession, "pages")
    read = scratch.save(read_pages(pages.select("page_id", "url", "html", _host().alias("host"))).withColumn("page", F.monotonically_increasing_id()), "read")
    known = scratch.save(templates(read), "templates")
    gone = read.select("page", "host", F.explode("trees").alias("t")).select("page", "host", "t.*")
    few = known.count() <= BROADCAST_TEMPLATES
    gone = gone.join(F.broadcast(known) if few else known, ["host", "subtree"]).groupBy("page").agg(F.collect_list(F.struct("low", "high")).alias("gone"))
    gone = scratch.save(gone, "gone")
    left = F.filter("blocks", lambda b, i: ~F.coalesce(F.exists("gone", lambda g: (g["low"] <= i) & (i < g["high"])), F.lit(False)))
    texts = read.join(F.broadcast(gone) if gone.count() <= BROADCAST_PAGES else gone, "page", "left").withColumn("left", left)
    text = F.array_join(F.when(F.size("left") > 0, F.col("left")).otherwise(F.col("blocks")), "\n\n")
    return texts.select("page_id", "url", text.alias("text")).select("*", F.length("text").cast("long").alias("n_chars"))
