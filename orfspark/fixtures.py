"""Tables of the domain derived from the general test tables, by SQL that Spark and DuckDB both run.

Each document is a transcript: its letters, mapped to bases, are the sequence. Three exons of equal length make its locus;
reads come from ``lineitem``. Every row and the whole text take part. ``{...}`` marks what the two dialects spell differently.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Each letter's base.
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGGATGTACATTGCACG"

_SPARK = {"all": "", "end": "`end`", "exons": "explode(array(0, 1, 2))", "double": "double"}
_DUCKDB = {"all": ", 'g'", "end": '"end"', "exons": "unnest([0, 1, 2])", "double": "double"}

_TABLES = {
    "tr": f"""
        SELECT concat('T', doc_id) AS tran_id, doc_id, lang, source,
               translate(regexp_replace(lower(text), '[^a-z]', ''{{all}}), '{LETTERS}', '{BASES}') AS seq
        FROM documents""",
    "ex": """
        SELECT concat('chr', cast(doc_id % 5 + 1 AS int)) AS chr, concat('T', doc_id) AS tran_id,
               CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand,
               cast(10000 * ((doc_id - doc_id % 5) / 5) + 1 + k * 2000 AS bigint) AS start,
               cast(10000 * ((doc_id - doc_id % 5) / 5) + 1 + k * 2000 + 199 + doc_id % 50 AS bigint) AS stop,
               k, doc_id, lang
        FROM (SELECT doc_id, lang, {exons} AS k FROM documents) AS d""",
    # attributes in the three spellings; Spanish documents name no transcript
    "ann": """
        SELECT chr, 'exon' AS type, start, stop, strand,
               CASE WHEN lang = 'es' THEN 'gene_id "G1"; note "none"'
                    WHEN lang = 'de' THEN concat('Parent=transcript:', tran_id, ';rank=1')
                    WHEN lang = 'fr' THEN concat('ID=x;transcript_id=', tran_id)
                    ELSE concat('gene_id "G1"; transcript_id "', tran_id, '"; note "x"') END AS attributes,
               tran_id AS expected
        FROM ex""",
    # a CDS from within the first exon to within the last one; Spanish documents have none
    "cdsg": """
        SELECT chr, tran_id, strand, CASE WHEN k = 0 THEN start + 50 ELSE start END AS start,
               CASE WHEN k = 2 THEN stop - 50 ELSE stop END AS stop
        FROM ex WHERE lang <> 'es'""",
    "rd": """
        SELECT concat('r', l_orderkey, '_x', cast(l_quantity AS int)) AS qname, concat('chr', cast(d % 5 + 1 AS int)) AS rname,
               cast(10000 * ((d - d % 5) / 5) + 1 + (l_linenumber % 3) * 2000 + l_partkey % 180 AS bigint) AS pos,
               cast(10000 * ((d - d % 5) / 5) + 1 + (l_linenumber % 3) * 2000 + l_partkey % 180 + 27 + l_linenumber AS bigint) AS {end}
        FROM (SELECT l_orderkey, l_quantity, l_linenumber, l_partkey,
                     l_orderkey % (SELECT count(*) FROM documents) AS d FROM lineitem) AS l""",
}

SOURCES = ("documents", "lineitem")


def sql(name: str, dialect: str = "duckdb") -> str:
    return _TABLES[name].format(**(_DUCKDB if dialect == "duckdb" else _SPARK))


def ctes(names: Iterable[str]) -> str:
    """``WITH`` list of the named tables for DuckDB, in dependency order."""
    return ", ".join(f"{n} AS ({sql(n)})" for n in _TABLES if n in set(names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; its inputs are given to the statement by name, so nothing is registered in the session."""
    text = sql(name, "spark")
    frames = {s: spark.read.parquet(f"{sf_dir}/{s}.parquet") for s in SOURCES if f"FROM {s}" in text}
    if "FROM ex" in text:
        frames["ex"] = table(spark, sf_dir, "ex")
    for n in frames:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(text, **frames)
