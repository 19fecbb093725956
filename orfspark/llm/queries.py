"""The registered queries of this subpackage: one per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .attribution import attribute
from .hamming import nearest_codes
from .mixing import mix
from .near import near_duplicates
from .oracles import HAMMING_SQL, NEAR_SQL, QUOTED, QUOTED_SQL, QUOTES_SQL, SUBSTRING_SQL
from .packing import pack
from .pages import extract
from .quality import quality_rules
from .quotes import link_quotes
from .substrings import removed_spans
from .toxicity import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(_table(spark, sf_dir, "conversations"))


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation linking over all conversations with quotations put into them, as the table itself has none."""
    return link_quotes(spark.sql(QUOTED, conversations=_table(spark, sf_dir, "conversations")))


def op3_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_codes(_table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(_table(spark, sf_dir, "documents"))


def op10_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_source_mixing, op2_quotation_linking, op3_hamming_top_k, op4_best_fit_packing, op5_minhash_near_dedup, op6_quality_rules,
        op7_toxicity, op8_html_extraction, op9_substring_dedup, op10_token_attribution, quoted_conversations,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_quotation_linking": QUOTES_SQL, "quoted_conversations": QUOTED_SQL, "op3_hamming_top_k": HAMMING_SQL, "op5_minhash_near_dedup": NEAR_SQL, "op9_substring_dedup": SUBSTRING_SQL}
