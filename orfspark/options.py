"""Choices where the domain's conventions leave room."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Semantics:
    """Defaults follow the established behaviour; each flag names one deviation.

    strict_types: label eoORF and extORF before the overlap types that otherwise shadow them.
    stop_codon_in_cds: the annotated CDS leaves the stop codon out, so extend it by three.
    windowed_reads: drop reads and exons that straddle a 225 kb window counted from a chromosome's first exon.
    strand_aware: project minus-strand positions from the exon's far end.
    one_based: exon coordinates are 1-based inclusive against a 0-based half-open track.
    keep_unscored: keep ORFs on transcripts without coverage, with null scores.
    type_specific: score uORF overlaps by rise-up only, dORF overlaps by step-down only, others by frame only.
    last_position_only: evaluate the change point only at the last position of the scanned range.
    normalize: read sequences in upper case, with T for U.
    dedupe_reads: count a read once at each A-site, however many transcripts have it there.
    offset_sign: 1 adds a read length's offset to its start, -1 subtracts it.
    """

    strict_types: bool = False
    stop_codon_in_cds: bool = False
    windowed_reads: bool = False
    strand_aware: bool = False
    one_based: bool = False
    keep_unscored: bool = False
    type_specific: bool = False
    last_position_only: bool = False
    normalize: bool = False
    dedupe_reads: bool = False
    offset_sign: int = 1


DEFAULT = Semantics()
