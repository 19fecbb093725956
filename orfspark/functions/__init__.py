"""Column functions of the domain, all built from Spark's own expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How annotation attributes name a transcript.
PARENT_PREFIXES = ("Parent=transcript:", "ID=transcript:")
GFF_PREFIX, GTF_PREFIX = "transcript_id=", " transcript_id "


def transcript_id(attributes: Column) -> Column:
    """The id in the first attribute (of those split at ``;``) that names a transcript; '' if none does, null for null.

    The GTF form is recognised only after a leading space, and its id is the third space-separated token without quotes.
    """
    known = (*PARENT_PREFIXES, GFF_PREFIX, GTF_PREFIX)
    names = lambda a: F.array_contains(F.array(*(F.startswith(a, F.lit(p)) for p in known)), True)
    first = F.get(F.filter(F.split(attributes, ";"), names), F.lit(0))
    parent = F.startswith(first, F.lit(PARENT_PREFIXES[0])) | F.startswith(first, F.lit(PARENT_PREFIXES[1]))
    named = (
        F.when(parent, F.get(F.split(first, ":"), F.lit(1)))
        .when(F.startswith(first, F.lit(GFF_PREFIX)), F.get(F.split(first, "="), F.lit(1)))
        .otherwise(F.regexp_replace(F.get(F.split(first, " "), F.lit(2)), '"', ""))
    )
    return F.when(attributes.isNull(), None).when(first.isNull(), "").otherwise(F.coalesce(named, F.lit("")))


def read_count(qname: Column, strict: bool = True) -> Column:
    """Multiplicity of a collapsed read, the number after ``_x``; a name without one is an error, or null if not strict."""
    part = F.split(qname, "_x")
    return F.element_at(part, 2).cast("long") if strict else F.get(part, F.lit(1)).try_cast("long")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def join_longs(values: Column) -> Column:
    return F.concat_ws(",", F.transform(values, lambda x: x.cast("string")))


def split_longs(text: Column) -> Column:
    return F.split(text, ",").cast("array<bigint>")


def log_ratio(above: Column, below: Column) -> Column:
    """ln((1 + above) / (1 + below)), nulls as 0."""
    zero = F.lit(0.0)
    return F.log((1 + F.coalesce(above, zero)) / (1 + F.coalesce(below, zero)))


def null_skipping_sum(columns: Sequence[Column]) -> Column:
    """The sum of what is not null; 0 if all are."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(c, F.lit(0.0))
    return total
