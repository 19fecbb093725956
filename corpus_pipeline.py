"""A document corpus made ready for training: rules, near-duplicates, recurring spans, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orfspark.llm.mixing import mixed
from orfspark.llm.near import keep_one
from orfspark.llm.packing import pack
from orfspark.llm.quality import keep_good
from orfspark.llm.scratch import Scratch
from orfspark.llm.substrings import cut_spans


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the isolation forest keep."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that recur."""
    return cut_spans(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of small sources repeated towards the target weights."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", packing),
]

#: A classifier, sketches and a tokenizer are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it; the rows are those of ``packing``.

    Texts are judged whole, whatever their length. Null, empty and short texts fail the quality rules and go. Rows that repeat a
    text, with one id or several, are near-duplicates, of which one stays; different texts of one id stay, as do rows with a null
    id, whose packed pieces have a null doc_id. A null source counts as the empty one. Ties are broken as each stage's docstring
    says. Extra columns, whatever their names, come along up to packing. Empty tables give an empty result.
    """
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{i}")
        scratch.drop(*([f"stage-{i - 1}"] if i else []))
    return STAGES[-1][1](spark, docs, sf_dir)
