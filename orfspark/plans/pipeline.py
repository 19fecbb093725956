"""From reads, annotation and sequences to scored open reading frames and their report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotation as an
from ..operators import orfs as of
from ..operators import reads as rd
from ..operators import report as rp
from ..operators import scoring as sc
from ..options import DEFAULT, Semantics
from ..session import written
from ..sources import report as page
from ..sources.bam import read_bam
from ..sources.bigwig import is_bigwig, read_bigwig, write_bigwig
from ..sources.text import read_bedgraph, read_exons, read_fasta, read_genome, read_gtf, read_offsets, read_orfs, read_scored, read_sizes, write_bedgraph, write_fasta, write_orfs_and_exons, write_table


@dataclass(frozen=True)
class Annotation:
    exons: DataFrame
    cds: DataFrame


def load_annotation(spark: SparkSession, path: str, transcripts: DataFrame | None = None) -> Annotation:
    """Exons and CDS extents of a GTF/GFF file, for ``transcripts(tran_id)`` if given."""
    ann = an.with_transcript_id(read_gtf(spark, path)).where("tran_id <> ''")
    exons = an.exon_coords(ann, transcripts)
    return Annotation(exons, an.cds_coords(ann, exons))


def coverage_of_reads(reads: DataFrame, known: Annotation, offsets: DataFrame | None = None, semantics: Semantics = DEFAULT) -> DataFrame:
    """A-site coverage (chr, A-site, stop, count) of aligned reads; offsets are estimated if none are given."""
    placed = rd.reads_to_cds(rd.reads_to_transcript(rd.normalize_reads(reads, semantics=semantics), known.exons, semantics), known.cds)
    if offsets is None:
        # offsets need all reads before coverage can begin
        placed = written(rd.read_sites(placed), "sites")
        offsets = rd.estimate_offsets(placed, semantics)
    return rd.asite_coverage(placed, offsets, semantics)


def typed_orfs(transcripts: DataFrame, cds: DataFrame, starts: Sequence[str] = of.STARTS, stops: Sequence[str] = of.STOPS, minlen: int = 0, maxlen: int = 1_000_000, semantics: Semantics = DEFAULT) -> DataFrame:
    return of.classify_orfs(of.find_orfs(transcripts, starts, stops, minlen, maxlen, semantics), cds, semantics)


def read_coverage(spark: SparkSession, path: str) -> DataFrame:
    """A BigWig file, or a bedGraph file or folder."""
    if path.endswith((".bw", ".bigwig", ".bigWig")) or (path.count(".") and not path.endswith((".bedGraph", ".bedgraph", ".bed")) and is_bigwig(path)):
        return read_bigwig(spark, path)
    return read_bedgraph(spark, path)


def write_report(scored: DataFrame, coverage: DataFrame, exons: DataFrame, parameters: Mapping[str, object], path: str, reach: int = rp.RANGE, semantics: Semantics = DEFAULT) -> str:
    """The HTML report of scored ORFs; returns its path. Only the report's own small results reach the driver."""
    covered = sc.coverage_to_transcript(coverage, exons, semantics)
    # read by both metagenes and the profiles
    covered = covered.persist()
    try:
        top = rp.top_orfs(scored)
        rows = [r.asDict() for r in rp.rounded(top).orderBy("type", "rank").collect()]
        metagene = {}
        for anchor in ("start", "stop"):
            for r in rp.metagene(scored, covered, anchor, reach).orderBy("type", "relativeloc").collect():
                metagene.setdefault((r.type, anchor), []).append((r.relativeloc, r.counts))
        profiles: dict[str, list[tuple[int, int, float]]] = {}
        for r in rp.transcript_profile(top, covered).orderBy("tran_id", "tran_start").toLocalIterator():
            profiles.setdefault(r.tran_id, []).append((r.tran_start, r.frame, r.counts))
    finally:
        covered.unpersist()
    with open(path, "w", encoding="utf-8") as f:
        f.write(page.render(parameters, rows, metagene, profiles))
    return path


def run(
    spark: SparkSession, *, bam: str | None = None, chromsize: str | None = None, seq: str | None = None, tran: str | None = None, ann: str | None = None,
    starts: str = "ATG", stops: str = "TAA,TAG,TGA", minlen: int = 0, maxlen: int = 1_000_000, bigwig: str | None = None, exon: str | None = None,
    bedfile: str | None = None, orfs: str | None = None, range_param: int = rp.RANGE, sru_range: int = 15, offsets: str | dict[int, int] | None = None,
    scoretype: bool = False, plotfile: str | None = None, outfilename: str | None = None, parts: bool = False, semantics: Semantics | None = None,
) -> dict[str, str]:
    """Run what the inputs ask for and return the paths written, by kind.

    ``bam`` + ``ann``: coverage as bedGraph, and as BigWig with ``chromsize``. ``bedfile`` + ``chromsize``: BigWig.
    ``seq`` or ``tran`` + ``ann``: ORFs and exons, and with coverage (``bigwig``, ``bedfile`` or ``bam``) scores and report.
    ``orfs`` + ``exon`` + coverage: scores and report. ``plotfile`` + ``exon`` + coverage: report. ``outfilename`` leads all
    paths, and each output is one file, or with ``parts`` a folder of them. ``scoretype`` scores each type by its own statistics only.
    """
    given = {k: v for k, v in locals().items() if k not in ("spark", "semantics", "parts") and v is not None}
    semantics = semantics or Semantics(type_specific=scoretype)
    if not outfilename:
        raise ValueError("outfilename is needed")
    if not (bam and ann or bedfile and chromsize or (seq or tran) and ann or orfs and exon and (bigwig or bedfile) or plotfile and exon and (bigwig or bedfile)):
        raise ValueError("give bam and ann; bedfile and chromsize; seq or tran and ann; orfs, exon and bigwig; or plotfile, exon and bigwig")
    paths: dict[str, str] = {}
    coverage = None
    if bam:
        known = load_annotation(spark, ann)
        sites = coverage_of_reads(read_bam(spark, bam), known, read_offsets(spark, offsets) if offsets else None, semantics)
        paths["bedgraph"] = f"{outfilename}.bedGraph"
        write_bedgraph(sites, paths["bedgraph"], parts)
        bedfile = paths["bedgraph"]
    if bigwig:
        coverage = read_coverage(spark, bigwig)
    elif bedfile:
        coverage = read_bedgraph(spark, bedfile)
        if chromsize:
            paths["bigwig"] = write_bigwig(coverage, read_sizes(spark, chromsize), f"{outfilename}.bw")
    scored, exons = None, None
    if seq or tran:
        known = load_annotation(spark, ann)
        if seq:
            paths["transcripts"] = f"{outfilename}_transcripts.fa"
            write_fasta(of.spliced_transcripts(read_genome(spark, seq), known.exons), paths["transcripts"], parts)
        transcripts = read_fasta(spark, paths.get("transcripts") or tran)
        exons = known.exons.join(transcripts.select("tran_id").distinct(), "tran_id", "left_semi")
        found = typed_orfs(transcripts, known.cds, starts.split(","), stops.split(","), minlen, maxlen, semantics)
        paths["orfs"], paths["exons"] = write_orfs_and_exons(found, exons, outfilename, parts)
        found = read_orfs(spark, paths["orfs"])
    elif orfs or plotfile:
        exons = read_exons(spark, exon)
        found = read_orfs(spark, orfs) if orfs else None
    if coverage is not None and exons is not None:
        if plotfile and not orfs:
            scored = read_scored(spark, plotfile)
        else:
            paths["scored"] = f"{outfilename}_orfs_scored.csv"
            write_table(sc.score_orfs(found, sc.coverage_to_transcript(coverage, exons, semantics), sru_range, semantics).orderBy(F.desc("score"), "tran_id", "start"), paths["scored"], parts)
            scored = read_scored(spark, paths["scored"])
        paths["report"] = write_report(scored, coverage, exons, given, f"{outfilename}_report.html", range_param, semantics)
    return paths
