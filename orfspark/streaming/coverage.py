"""Coverage of a stream of aligned reads.

The batch functions are stateless up to the last sum, so a stream runs the same plan against static annotation; the only
state is one running sum per A-site. Offsets must be given, as estimating them needs all reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import reads as rd
from ..options import DEFAULT, Semantics


def coverage_stream(reads: DataFrame, exons: DataFrame, cds: DataFrame, offsets: DataFrame, semantics: Semantics = DEFAULT) -> DataFrame:
    """A-site counts (chr, A-site, stop, count) of streaming ``reads(qname, rname, pos, end)``, for update or complete mode."""
    if semantics.dedupe_reads:
        raise ValueError("a stream keeps counts by A-site only, not the reads seen there")
    placed = rd.reads_to_cds(rd.reads_to_transcript(rd.normalize_reads(reads), exons, semantics), cds)
    return rd.asite_coverage(placed, offsets, semantics)
