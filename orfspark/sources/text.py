"""Text formats: GTF/GFF, FASTA, bedGraph, chromosome sizes, offsets, exon and ORF tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..operators.annotation import pack_exons, unpack_exons
from .files import as_one_file

_GTF = T.StructType([T.StructField(n, t) for n, t in (
    ("chr", T.StringType()), ("source", T.StringType()), ("type", T.StringType()), ("start", T.LongType()), ("stop", T.LongType()),
    ("score", T.StringType()), ("strand", T.StringType()), ("phase", T.StringType()), ("attributes", T.StringType()),
)])


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Annotation lines: chr, type, start, stop, strand, attributes. Comments are skipped, bad numbers become null."""
    reader = spark.read.schema(_GTF).option("sep", "\t").option("comment", "#").option("mode", "PERMISSIVE").option("quote", "").option("escape", "")
    return reader.csv(path).select(*schema.ANNOTATION.fieldNames())


def read_fasta(spark: SparkSession, path: str, id_end: str = "|") -> DataFrame:
    """(tran_id, seq): the first word of each header up to ``id_end``, and its lines put together. One row per record, whatever
    its id. A record begins with ``>`` at the start of a line; one within a line is part of it."""
    record = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value")).where(F.trim("value") != "")
    header = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    name = F.substring_index(F.regexp_extract(header, r"^\s*(\S*)", 1), id_end, 1)
    return record.select(name.alias("tran_id"), F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", "").alias("seq"))


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """(chr, seq) of a genome's contigs, named by the first word of their headers."""
    return read_fasta(spark, path, id_end="\u0000").withColumnRenamed("tran_id", "chr")


def _tab(spark: SparkSession, path: str, of: T.StructType) -> DataFrame:
    return spark.read.schema(of).option("sep", "\t").option("comment", "#").csv(path)


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    return _tab(spark, path, schema.COVERAGE).where("start is not null")


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    return _tab(spark, path, schema.SIZES)


def read_offsets(spark: SparkSession, given: str | dict[int, int]) -> DataFrame:
    """(length, offset) from a dict or a CSV file with a header."""
    if isinstance(given, dict):
        return spark.createDataFrame([(int(k), int(v)) for k, v in given.items()], schema.OFFSETS)
    return spark.read.schema(schema.OFFSETS).option("header", True).csv(given)


def read_exons(spark: SparkSession, path: str) -> DataFrame:
    return unpack_exons(spark.read.schema(schema.EXON_FILE).option("header", True).csv(path))


def read_orfs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.ORF_TYPED).option("header", True).csv(path)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.ORF_SCORED).option("header", True).csv(path)


def _put(df: DataFrame, path: str, kind: str, parts: bool, head: str = "", **options: object) -> None:
    """Write ``df`` as one file, or with ``parts`` as a folder of them, each then with ``head``."""
    if parts:
        df.write.mode("overwrite").options(**options).format(kind).save(path)
        return
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    df.write.options(**options | {"header": False}).format(kind).save(folder)
    as_one_file(df.sparkSession, folder, path, head)


def write_bedgraph(coverage: DataFrame, path: str, parts: bool = False) -> None:
    """Tab-separated, without a header, sorted by chromosome and position; parts are in order."""
    _put(coverage.orderBy(*coverage.columns[:2]), path, "csv", parts, sep="\t")


def write_fasta(transcripts: DataFrame, path: str, parts: bool = False) -> None:
    _put(transcripts.select(F.concat(F.lit(">"), "tran_id", F.lit("\n"), "seq").alias("value")), path, "text", parts)


def write_table(df: DataFrame, path: str, parts: bool = False) -> None:
    """A CSV table with a header."""
    _put(df, path, "csv", parts, ",".join(df.columns) + "\n", header=True)


def write_orfs_and_exons(orfs: DataFrame, exons: DataFrame, name: str, parts: bool = False) -> tuple[str, str]:
    """The annotated ORFs and the packed exons under ``name``; returns both paths."""
    paths = f"{name}_annotated_orfs.csv", f"{name}_exons.csv"
    write_table(orfs.orderBy("tran_id", "start"), paths[0], parts)
    write_table(pack_exons(exons), paths[1], parts)
    return paths
