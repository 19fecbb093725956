"""Command line: ``python -m orfspark.cli --tran transcripts.fa --ann annotation.gtf --bigwig reads.bw --outfilename out``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .plans.pipeline import run


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="orfspark", description="Score open reading frames by ribosome-profiling coverage.")
    text = {
        "bam": ("b", "alignments"), "chromsize": ("c", "chromosome sizes"), "seq": ("s", "genome FASTA"), "tran": ("t", "transcript FASTA"), "ann": ("a", "annotation, GTF or GFF"),
        "bigwig": ("bw", "coverage as BigWig"), "exon": ("ex", "exon table"), "bedfile": ("bed", "coverage as bedGraph"), "orfs": ("of", "annotated ORFs"),
        "offsets": ("ofs", "offsets by read length, CSV"), "plotfile": ("pf", "scored ORFs to report on"), "outfilename": ("ofn", "start of output names"),
    }
    for name, (short, what) in text.items():
        p.add_argument(f"--{name}", f"-{short}", help=what)
    p.add_argument("--starts", "-sta", default="ATG", help="start codons, comma-separated")
    p.add_argument("--stops", "-stp", default="TAA,TAG,TGA", help="stop codons, comma-separated")
    p.add_argument("--minlen", "-min", type=int, default=0, help="ORFs are longer than this")
    p.add_argument("--maxlen", "-max", type=int, default=1_000_000, help="ORFs are shorter than this")
    p.add_argument("--range_param", "-rp", type=int, default=30, help="reach of metagene profiles")
    p.add_argument("--sru_range", "-sru", type=int, default=15, help="reach of the rise-up and step-down scores")
    p.add_argument("--scoretype", "-st", action="store_true", help="score each type by its own statistics only")
    p.add_argument("--parts", action="store_true", help="write folders of parts, not single files")
    return p


def main(args: Sequence[str] | None = None) -> None:
    given = vars(parser().parse_args(args))
    spark = SparkSession.builder.appName("orfspark").getOrCreate()
    for kind, path in run(spark, **given).items():
        print(f"{kind}: {path}")


if __name__ == "__main__":
    main()
