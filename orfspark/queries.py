"""Registered queries of the domain's operators, with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import ctes, table
from .functions import transcript_id
from .operators import annotation, intervals, orfs, reads, report, scoring
from .options import Semantics
from .session import work_folder, written
from .sources import bam, bigwig, text

_FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}

# ---------------------------------------------------------------- SQL shared by the oracles

#: Every codon of the default start and stop sets, with its place.
_CODONS = """
letters AS (
  SELECT tran_id, length(seq) AS size, substr(seq, length(seq) - 2, 3) AS tail, string_split(seq, '') AS c FROM tr
), codons AS (
  SELECT tran_id, size, tail, i - 1 AS pos, codon
  FROM (SELECT tran_id, size, tail, i, c[i] || c[i + 1] || c[i + 2] AS codon FROM (SELECT *, unnest(generate_series(1, greatest(size - 2, 0))) AS i FROM letters) AS s) AS t
  WHERE codon IN ('ATG', 'CTG', 'GTG', 'TAA', 'TAG', 'TGA')
)"""
_ORFS = """
paired AS (
  SELECT *, min(CASE WHEN codon IN ('TAA', 'TAG', 'TGA') THEN {{'pos': pos, 'codon': codon}} END)
              OVER (PARTITION BY tran_id, pos % 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_stop
  FROM codons
), orf AS (
  SELECT tran_id, CAST(pos AS BIGINT) AS start, CAST(coalesce(next_stop.pos + 2, size) AS BIGINT) AS stop,
         CAST(coalesce(next_stop.pos + 2, size) - (pos + 2) AS BIGINT) AS length, codon AS startorf, coalesce(next_stop.codon, tail) AS stoporf
  FROM paired WHERE codon IN ({starts}) AND coalesce(next_stop.pos + 2, size) - (pos + 2) > {low} AND coalesce(next_stop.pos + 2, size) - (pos + 2) < {high}
)"""
_EXON = """
exon AS (
  SELECT chr, tran_id, strand, start, stop, CAST(row_number() OVER w - 1 AS INTEGER) AS exon_idx,
         CAST(sum(stop - start + 1) OVER w - 1 AS BIGINT) AS tran_stop,
         CAST(sum(stop - start + 1) OVER w - 1 - (stop - start) AS BIGINT) AS tran_start
  FROM ex WINDOW w AS (PARTITION BY tran_id ORDER BY CASE strand WHEN '+' THEN start ELSE -start END)
)"""
_CDS = """
cds AS (
  SELECT c.tran_id,
         min(e.tran_start + CASE e.strand WHEN '+' THEN c.start - e.start ELSE e.stop - c.stop END) AS tran_start,
         max(e.tran_stop - CASE e.strand WHEN '+' THEN e.stop - c.stop ELSE c.start - e.start END) AS tran_stop
  FROM cdsg c JOIN exon e ON c.tran_id = e.tran_id AND c.start BETWEEN e.start AND e.stop AND c.stop BETWEEN e.start AND e.stop
  GROUP BY c.tran_id
)"""
_TYPED = """
typed AS (
  SELECT o.*, CASE WHEN c.tran_id IS NULL THEN 'Non Coding' WHEN o.stop < c.tran_start THEN 'uORF'
    WHEN o.start = c.tran_start AND o.stop = c.tran_stop THEN 'CDS' WHEN o.start > c.tran_stop THEN 'dORF'
    WHEN o.start < c.tran_start AND o.stop >= c.tran_start THEN 'uoORF' WHEN o.start <= c.tran_stop AND o.stop > c.tran_stop THEN 'doORF'
    WHEN o.start >= c.tran_start AND o.stop <= c.tran_stop THEN 'iORF' ELSE 'Unexpected' END AS type
  FROM orf o LEFT JOIN cds c ON o.tran_id = c.tran_id
)"""
_NORM = """
norm AS (
  SELECT CAST(split_part(qname, '_x', 2) AS BIGINT) AS count, rname AS chr, pos AS start, "end" AS stop, "end" - pos AS length FROM rd
)"""
_READ_TRAN = """
read_tran AS (
  SELECT r.*, e.tran_id, e.tran_start + (r.start - e.start) AS tran_start_bam, e.tran_stop - (e.stop - r.stop) AS tran_stop_bam
  FROM norm r JOIN exon e ON r.chr = e.chr AND r.start >= e.start AND r.stop <= e.stop
)"""
_READ_CDS = """
read_cds AS (
  SELECT r.count, r.chr, r.start, r.stop, r.length, r.tran_id, r.tran_start_bam - c.tran_start AS bamcds_start
  FROM read_tran r JOIN cds c ON r.tran_id = c.tran_id
)"""
_OFFSETS = """
filled AS (
  SELECT s.length, s.p AS bamcds_start, coalesce(c.n, 0) AS n
  FROM (SELECT length, unnest(generate_series(-33, 14)) AS p FROM (SELECT DISTINCT length FROM read_cds)) AS s
  LEFT JOIN (SELECT length, bamcds_start, sum(count) AS n FROM read_cds GROUP BY ALL) AS c ON s.length = c.length AND s.p = c.bamcds_start
), jumps AS (
  SELECT * FROM (
    SELECT length, bamcds_start, abs(avg(n) OVER (PARTITION BY length ORDER BY bamcds_start ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)
                                   - avg(n) OVER (PARTITION BY length ORDER BY bamcds_start ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS jump FROM filled
  ) WHERE bamcds_start BETWEEN -30 AND 10
), offsets AS (
  SELECT length, CAST(CASE WHEN jump > 0 THEN bamcds_start ELSE 15 END AS BIGINT) AS "offset"
  FROM (SELECT *, row_number() OVER (PARTITION BY length ORDER BY jump DESC, bamcds_start) AS k FROM jumps) WHERE k = 1
)"""
_COVERAGE = """
coverage AS (
  SELECT r.chr, r.start + o."offset" AS start, r.start + o."offset" + 1 AS stop, CAST(sum(r.count) AS DOUBLE) AS value
  FROM read_cds r JOIN offsets o ON r.length = o.length GROUP BY ALL
)"""
_TRAN_READS = """
tran_reads AS (
  SELECT e.tran_id, e.tran_start + (c.start - e.start) AS tran_start, e.tran_stop - (e.stop - c.stop) AS tran_stop, c.value AS counts
  FROM coverage c JOIN exon e ON c.chr = e.chr AND c.start < e.stop AND c.stop > e.start
  WHERE e.chr <> 'chrM' AND e.start <> e.stop
)"""
_SUMS = """
live AS (SELECT DISTINCT t.tran_id, t.start, t.stop FROM typed t SEMI JOIN tran_reads r ON t.tran_id = r.tran_id),
sums AS (
  SELECT o.tran_id, o.start, o.stop,
    coalesce(sum(counts) FILTER (r.tran_start % 3 = o.start % 3 AND r.tran_start BETWEEN o.start - 15 AND o.start - 1), 0) AS up_before,
    coalesce(sum(counts) FILTER (r.tran_start % 3 = o.start % 3 AND r.tran_start BETWEEN o.start + 1 AND o.start + 17), 0) AS up_after,
    coalesce(sum(counts) FILTER (r.tran_start % 3 = o.stop % 3 AND r.tran_start BETWEEN o.stop - 15 AND o.stop - 1), 0) AS down_before,
    coalesce(sum(counts) FILTER (r.tran_start % 3 = o.stop % 3 AND r.tran_start BETWEEN o.stop + 1 AND o.stop + 17), 0) AS down_after,
    coalesce(sum(counts) FILTER (r.tran_start BETWEEN o.start AND o.stop AND r.tran_start % 3 = 0), 0) AS f0,
    coalesce(sum(counts) FILTER (r.tran_start BETWEEN o.start AND o.stop AND r.tran_start % 3 = 1), 0) AS f1,
    coalesce(sum(counts) FILTER (r.tran_start BETWEEN o.start AND o.stop AND r.tran_start % 3 = 2), 0) AS f2,
    count(*) FILTER (r.tran_start BETWEEN o.start AND o.stop AND r.tran_start % 3 = 0 AND counts > 0) AS n0,
    count(*) FILTER (r.tran_start BETWEEN o.start AND o.stop AND counts > 0) AS n
  FROM live o JOIN tran_reads r ON o.tran_id = r.tran_id GROUP BY ALL
), parts AS (
  SELECT tran_id, start, stop, ln((1 + up_after) / (1 + up_before)) AS rise_up, ln((1 + down_before) / (1 + down_after)) AS step_down,
    CASE WHEN f1 <> 0 AND f2 <> 0 THEN f0 / greatest(f1, f2) ELSE 0.0 END AS hrf,
    CASE WHEN f0 <> 0 THEN f0 / ((stop - start) / 3.0::DOUBLE) ELSE 0.0 END AS avg,
    CASE WHEN n > 0 THEN n0 / n::DOUBLE ELSE 0.0 END AS nzc
  FROM sums
)"""
_SCORED = """
scored AS (
  SELECT *, rise_up + step_down + hrf + avg + nzc AS score FROM (
    SELECT t.*, CASE WHEN t.type = 'doORF' THEN 0.0 ELSE p.rise_up END AS rise_up, CASE WHEN t.type = 'uoORF' THEN 0.0 ELSE p.step_down END AS step_down, p.hrf, p.avg, p.nzc
    FROM typed t JOIN parts p USING (tran_id, start, stop)
  )
)"""
_ORF_COLUMNS = "tran_id, start, stop, length, startorf, stoporf"
_SCORE_COLUMNS = ", ".join(f"round({c}, 9) AS {c}" for c in ("rise_up", "step_down", "hrf", "avg", "nzc", "score"))


def _orf_sql(starts: str = "'ATG'", low: int = 0, high: int = 1_000_000) -> str:
    return _ORFS.format(starts=starts, low=low, high=high)


_ANNOTATED = [_EXON, _CDS]
_MAPPED = [*_ANNOTATED, _NORM, _READ_TRAN, _READ_CDS]
_COVERED = [*_MAPPED, _OFFSETS, _COVERAGE, _TRAN_READS]
_TYPES = [_CODONS, _orf_sql(), _TYPED]
_ALL = ("tr", "ex", "cdsg", "rd")


def _query(name: str, tables: tuple[str, ...], parts: list[str], select: str) -> Callable:
    """Register a query with its SQL: the derived tables, further common tables, and the final statement."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _FOUND[name] = f
        _ORACLE[name] = "WITH " + ", ".join([ctes(tables), *(p.strip() for p in parts)]) + "\n" + select
        return f

    return keep


# ---------------------------------------------------------------- shared Spark inputs


def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tr").select("tran_id", "seq")


def _exons(spark: SparkSession, d: str) -> DataFrame:
    return annotation.exon_coords(table(spark, d, "ex").withColumn("type", F.lit("exon")))


def _cds(spark: SparkSession, d: str) -> DataFrame:
    return annotation.cds_coords(table(spark, d, "cdsg").withColumn("type", F.lit("CDS")), _exons(spark, d))


def _typed(spark: SparkSession, d: str, semantics: Semantics = Semantics()) -> DataFrame:
    return orfs.classify_orfs(orfs.find_orfs(_transcripts(spark, d)), _cds(spark, d), semantics)


def _read_tran(spark: SparkSession, d: str) -> DataFrame:
    return reads.reads_to_transcript(reads.normalize_reads(table(spark, d, "rd")), _exons(spark, d))


def _read_cds(spark: SparkSession, d: str) -> DataFrame:
    return reads.reads_to_cds(_read_tran(spark, d), _cds(spark, d))


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    placed = written(reads.read_sites(_read_cds(spark, d)), "sites")
    sites = reads.asite_coverage(placed, reads.estimate_offsets(placed))
    return sites.select("chr", F.col("A-site").alias("start"), "stop", F.col("count").cast("double").alias("value"))


def _tran_reads(spark: SparkSession, d: str) -> DataFrame:
    return scoring.coverage_to_transcript(_coverage(spark, d), _exons(spark, d))


def _covered(spark: SparkSession, d: str) -> DataFrame:
    """Coverage on transcripts, written before it is scored, as a run writes its coverage before it scores with it."""
    return written(_tran_reads(spark, d), "covered")


def _scored(spark: SparkSession, d: str, semantics: Semantics = Semantics()) -> DataFrame:
    return scoring.score_orfs(_typed(spark, d), _covered(spark, d), semantics=semantics)


def _nine(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 9) for c in columns})


_SCORED_COLUMNS = ("rise_up", "step_down", "hrf", "avg", "nzc", "score")

# ---------------------------------------------------------------- sequences


@_query("orf_find", ("tr",), [_CODONS, _orf_sql()], f"SELECT {_ORF_COLUMNS} FROM orf")
def orf_find(spark: SparkSession, d: str) -> DataFrame:
    return orfs.find_orfs(_transcripts(spark, d))


@_query("orf_find_minmax", ("tr",), [_CODONS, _orf_sql(low=30, high=90)], f"SELECT {_ORF_COLUMNS} FROM orf")
def orf_find_minmax(spark: SparkSession, d: str) -> DataFrame:
    return orfs.find_orfs(_transcripts(spark, d), minlen=30, maxlen=90)


@_query("orf_find_altstarts", ("tr",), [_CODONS, _orf_sql("'ATG', 'CTG', 'GTG'")], f"SELECT {_ORF_COLUMNS} FROM orf")
def orf_find_altstarts(spark: SparkSession, d: str) -> DataFrame:
    return orfs.find_orfs(_transcripts(spark, d), starts=("ATG", "CTG", "GTG"))


@_query("codon_positions", ("tr",), [_CODONS], "SELECT tran_id, CAST(pos AS BIGINT) AS pos, codon, CAST(pos % 3 AS INTEGER) AS frame FROM codons WHERE codon IN ('ATG', 'TAA', 'TAG', 'TGA')")
def codon_positions(spark: SparkSession, d: str) -> DataFrame:
    found = orfs.codon_positions(_transcripts(spark, d), [*orfs.STARTS, *orfs.STOPS])
    return found.select("tran_id", "pos", "codon", (F.col("pos") % 3).cast("int").alias("frame"))


_SPLICED = """
genome AS (SELECT chr, string_agg(seq, '' ORDER BY doc_id) AS seq FROM (SELECT 'g' || source AS chr, doc_id, seq FROM tr) GROUP BY chr),
cut AS (
  SELECT 'S' || t.doc_id || s.strand AS tran_id, 'g' || t.source AS chr, s.strand, k,
         CAST(1 + t.doc_id % 7 + k * 11 AS BIGINT) AS start, CAST(9 + t.doc_id % 7 + k * 11 AS BIGINT) AS stop
  FROM tr t, (SELECT unnest(['+', '-']) AS strand) s, (SELECT unnest([0, 1, 2]) AS k) n
), pieces AS (
  SELECT c.tran_id, c.strand, c.start, CASE c.strand WHEN '+' THEN substr(g.seq, c.start, c.stop - c.start + 1)
         ELSE reverse(translate(substr(g.seq, c.start, c.stop - c.start + 1), 'ACGTacgt', 'TGCAtgca')) END AS piece
  FROM cut c JOIN genome g ON c.chr = g.chr
)"""


@_query("spliced_sequence", ("tr",), [_SPLICED], "SELECT tran_id, string_agg(piece, '' ORDER BY CASE strand WHEN '+' THEN start ELSE -start END) AS seq FROM pieces GROUP BY tran_id, strand")
def spliced_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Contigs are the sequences of each source put together; each transcript's locus lies near its contig's start."""
    tr = table(spark, d, "tr").withColumn("chr", F.concat(F.lit("g"), "source"))
    chunks = orfs.chunk_offsets(tr.select("chr", F.col("doc_id").alias("id"), "seq"))
    loci = tr.select("doc_id", "chr", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand")).select("*", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    start = (1 + F.col("doc_id") % 7 + F.col("k") * 11).cast("long")
    exons = loci.select("chr", F.concat(F.lit("S"), "doc_id", "strand").alias("tran_id"), "strand", F.lit("exon").alias("type"), start.alias("start"), (start + 8).alias("stop"))
    return orfs.spliced_from_chunks(chunks, annotation.exon_coords(exons))


# ---------------------------------------------------------------- annotation

_IDS = """
ids AS (
  SELECT *, CASE WHEN lang = 'es' THEN '' ELSE tran_id END AS expected_id FROM ex
)"""


@_query("gtf_transcript_id", ("ex",), [_IDS], "SELECT chr, start, stop, strand, expected_id AS tran_id FROM ids")
def gtf_transcript_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ann").select("chr", "start", "stop", "strand", transcript_id(F.col("attributes")).alias("tran_id"))


@_query("exon_transcript_coords", ("ex",), [_EXON], "SELECT chr, tran_id, strand, exon_idx, start, stop, tran_start, tran_stop FROM exon")
def exon_transcript_coords(spark: SparkSession, d: str) -> DataFrame:
    return _exons(spark, d)


@_query("cds_transcript_coords", ("ex", "cdsg"), _ANNOTATED, "SELECT tran_id, tran_start, tran_stop FROM cds")
def cds_transcript_coords(spark: SparkSession, d: str) -> DataFrame:
    return _cds(spark, d)


@_query("exon_csv_pack", ("ex",), [_EXON], """
SELECT min(chr) AS chr, tran_id, string_agg(CAST(start AS VARCHAR), ',' ORDER BY exon_idx) AS start, string_agg(CAST(stop AS VARCHAR), ',' ORDER BY exon_idx) AS stop,
  string_agg(CAST(tran_start AS VARCHAR), ',' ORDER BY exon_idx) AS tran_start, string_agg(CAST(tran_stop AS VARCHAR), ',' ORDER BY exon_idx) AS tran_stop
FROM exon GROUP BY tran_id""")
def exon_csv_pack(spark: SparkSession, d: str) -> DataFrame:
    return annotation.pack_exons(_exons(spark, d))


# ---------------------------------------------------------------- types


@_query("orf_classify", ("tr", "ex", "cdsg"), [*_ANNOTATED, *_TYPES], f"SELECT {_ORF_COLUMNS}, type FROM typed")
def orf_classify(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d)


@_query("orf_classify_strict", ("tr", "ex", "cdsg"), [*_ANNOTATED, *_TYPES], f"""
SELECT {", ".join("t." + c for c in _ORF_COLUMNS.split(", "))}, CASE WHEN t.type = 'uoORF' AND t.stop > c.tran_stop THEN 'eoORF' WHEN t.type = 'uoORF' AND t.stop = c.tran_stop THEN 'extORF' ELSE t.type END AS type
FROM typed t LEFT JOIN cds c ON t.tran_id = c.tran_id""")
def orf_classify_strict(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d, Semantics(strict_types=True))


@_query("orf_noncoding", ("tr", "ex", "cdsg"), [*_ANNOTATED, _CODONS, _orf_sql()], f"SELECT {_ORF_COLUMNS} FROM orf ANTI JOIN cds ON orf.tran_id = cds.tran_id")
def orf_noncoding(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).where("type = 'Non Coding'").drop("type")


@_query("orf_type_counts", ("tr", "ex", "cdsg"), [*_ANNOTATED, *_TYPES], "SELECT type, count(*) AS n FROM typed GROUP BY type")
def orf_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- reads


@_query("read_count_parse", ("rd",), [_NORM], "SELECT count, chr, start, stop, length FROM norm")
def read_count_parse(spark: SparkSession, d: str) -> DataFrame:
    return reads.normalize_reads(table(spark, d, "rd"))


@_query("read_exon_containment", ("ex", "rd"), [_EXON, _NORM, _READ_TRAN], "SELECT count, chr, start, stop, length, tran_id, tran_start_bam, tran_stop_bam FROM read_tran")
def read_exon_containment(spark: SparkSession, d: str) -> DataFrame:
    return _read_tran(spark, d)


@_query("read_to_cds", ("ex", "cdsg", "rd"), _MAPPED, "SELECT count, chr, start, stop, length, tran_id, bamcds_start FROM read_cds")
def read_to_cds(spark: SparkSession, d: str) -> DataFrame:
    return _read_cds(spark, d)


@_query("metagene_by_length", ("ex", "cdsg", "rd"), _MAPPED, "SELECT bamcds_start, length, CAST(sum(count) AS BIGINT) AS count FROM read_cds GROUP BY ALL")
def metagene_by_length(spark: SparkSession, d: str) -> DataFrame:
    return reads.length_profile(_read_cds(spark, d))


@_query("change_point_offsets", ("ex", "cdsg", "rd"), [*_MAPPED, _OFFSETS], 'SELECT length, "offset" FROM offsets')
def change_point_offsets(spark: SparkSession, d: str) -> DataFrame:
    return reads.estimate_offsets(_read_cds(spark, d))


@_query("asite_coverage", ("ex", "cdsg", "rd"), [*_MAPPED, _OFFSETS, _COVERAGE], 'SELECT chr, start AS "A-site", stop, CAST(value AS BIGINT) AS count FROM coverage')
def asite_coverage(spark: SparkSession, d: str) -> DataFrame:
    placed = written(reads.read_sites(_read_cds(spark, d)), "sites")
    return reads.asite_coverage(placed, reads.estimate_offsets(placed))


# ---------------------------------------------------------------- coverage and scores


@_query("coverage_to_transcript", ("ex", "cdsg", "rd"), _COVERED, "SELECT tran_id, tran_start, tran_stop, counts FROM tran_reads")
def coverage_to_transcript(spark: SparkSession, d: str) -> DataFrame:
    return _tran_reads(spark, d)


@_query("sru_rise_up", _ALL, [*_COVERED, *_TYPES, _SUMS], "SELECT DISTINCT tran_id, start AS anchor, round(rise_up, 9) AS sru FROM parts")
def sru_rise_up(spark: SparkSession, d: str) -> DataFrame:
    covered = _covered(spark, d)
    live = _typed(spark, d).join(covered.select("tran_id").distinct(), "tran_id", "left_semi")
    return _nine(scoring.sru_scores(live.select("tran_id", F.col("start").alias("anchor")), covered), "sru")


@_query("sru_step_down", _ALL, [*_COVERED, *_TYPES, _SUMS], "SELECT DISTINCT tran_id, stop AS anchor, round(step_down, 9) AS sru FROM parts")
def sru_step_down(spark: SparkSession, d: str) -> DataFrame:
    covered = _covered(spark, d)
    live = _typed(spark, d).join(covered.select("tran_id").distinct(), "tran_id", "left_semi")
    return _nine(scoring.sru_scores(live.select("tran_id", F.col("stop").alias("anchor")), covered, invert=True), "sru")


@_query("frame_scores", _ALL, [*_COVERED, *_TYPES, _SUMS], "SELECT tran_id, start, stop, round(hrf, 9) AS hrf, round(avg, 9) AS avg, round(nzc, 9) AS nzc FROM parts")
def frame_scores(spark: SparkSession, d: str) -> DataFrame:
    covered = _covered(spark, d)
    live = _typed(spark, d).join(covered.select("tran_id").distinct(), "tran_id", "left_semi")
    return _nine(scoring.frame_scores(live, covered), "hrf", "avg", "nzc")


@_query("orf_scored", _ALL, [*_COVERED, *_TYPES, _SUMS, _SCORED], f"SELECT {_ORF_COLUMNS}, type, {_SCORE_COLUMNS} FROM scored")
def orf_scored(spark: SparkSession, d: str) -> DataFrame:
    return _nine(_scored(spark, d), *_SCORED_COLUMNS)


@_query("orf_scored_type_specific", _ALL, [*_COVERED, *_TYPES, _SUMS], f"""
SELECT {_ORF_COLUMNS}, type, {_SCORE_COLUMNS} FROM (
  SELECT *, coalesce(rise_up, 0) + coalesce(step_down, 0) + coalesce(hrf, 0) + coalesce(avg, 0) + coalesce(nzc, 0) AS score FROM (
    SELECT t.*, CASE WHEN type = 'uoORF' THEN p.rise_up END AS rise_up, CASE WHEN type = 'doORF' THEN p.step_down END AS step_down,
      CASE WHEN type NOT IN ('uoORF', 'doORF') THEN p.hrf END AS hrf, CASE WHEN type NOT IN ('uoORF', 'doORF') THEN p.avg END AS avg, CASE WHEN type NOT IN ('uoORF', 'doORF') THEN p.nzc END AS nzc
    FROM typed t JOIN parts p USING (tran_id, start, stop)))""")
def orf_scored_type_specific(spark: SparkSession, d: str) -> DataFrame:
    return _nine(_scored(spark, d, Semantics(type_specific=True)), *_SCORED_COLUMNS)


# ---------------------------------------------------------------- report

# ranks compare rounded scores, as the two engines' logarithms may differ in the last bit
_RANKED = "SELECT *, row_number() OVER (PARTITION BY type ORDER BY round(score, 9) DESC, tran_id, start, stop) AS rank FROM scored"


@_query("top10_per_type", _ALL, [*_COVERED, *_TYPES, _SUMS, _SCORED], f"SELECT {_ORF_COLUMNS}, type, {_SCORE_COLUMNS}, CAST(rank AS INTEGER) AS rank FROM ({_RANKED}) WHERE rank <= 10")
def top10_per_type(spark: SparkSession, d: str) -> DataFrame:
    return report.top_orfs(orf_scored(spark, d))


def _metagene_sql(anchor: str, position: str) -> str:
    return f"""
SELECT s.type, s.relativeloc, coalesce(c.counts, 0.0) AS counts FROM
  (SELECT type, unnest(generate_series(-30, 30)) AS relativeloc FROM (SELECT DISTINCT type FROM typed)) s LEFT JOIN
  (SELECT t.type, r.{position} - t.{anchor} AS relativeloc, sum(r.counts) AS counts FROM typed t JOIN tran_reads r
   ON t.tran_id = r.tran_id AND abs(r.{position} - t.{anchor}) <= 30 GROUP BY ALL) c ON s.type = c.type AND s.relativeloc = c.relativeloc"""


@_query("metagene_start", _ALL, [*_COVERED, *_TYPES], _metagene_sql("start", "tran_start"))
def metagene_start(spark: SparkSession, d: str) -> DataFrame:
    return report.metagene(_typed(spark, d), _covered(spark, d), "start")


@_query("metagene_stop", _ALL, [*_COVERED, *_TYPES], _metagene_sql("stop", "tran_stop"))
def metagene_stop(spark: SparkSession, d: str) -> DataFrame:
    return report.metagene(_typed(spark, d), _covered(spark, d), "stop")


@_query("transcript_profile", _ALL, [*_COVERED, *_TYPES, _SUMS, _SCORED], f"""
SELECT tran_id, tran_start, CAST(tran_start % 3 AS INTEGER) AS frame, sum(counts) AS counts FROM tran_reads
WHERE tran_id IN (SELECT tran_id FROM ({_RANKED}) WHERE rank <= 10) GROUP BY tran_id, tran_start""")
def transcript_profile(spark: SparkSession, d: str) -> DataFrame:
    covered = _covered(spark, d)
    return report.transcript_profile(report.top_orfs(_nine(scoring.score_orfs(_typed(spark, d), covered), *_SCORED_COLUMNS)), covered)


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "rd").select(F.col("rname").alias("chr"), F.col("pos").alias("l_start"), F.col("end").alias("l_stop"))
    right = table(spark, d, "cdsg").select("chr", "tran_id", F.col("start").alias("r_start"), F.col("stop").alias("r_stop"))
    return intervals.overlap_join(left, right, ["chr"])


@_query("interval_overlap", ("ex", "cdsg", "rd"), [], """
SELECT r.rname AS chr, r.pos AS l_start, r."end" AS l_stop, c.tran_id, c.start AS r_start, c.stop AS r_stop
FROM rd r JOIN cdsg c ON r.rname = c.chr AND r.pos < c.stop AND r."end" > c.start""")
def interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d)


# ---------------------------------------------------------------- files: written in the shared folder and read again


def _folder(spark: SparkSession, name: str) -> str:
    folder = work_folder(spark, name)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


@_query("gtf_file", ("ex", "ann"), [], "SELECT chr, type, start, stop, strand, attributes FROM ann")
def gtf_file(spark: SparkSession, d: str) -> DataFrame:
    dot = F.lit(".")
    lines = table(spark, d, "ann").select(F.concat_ws("\t", "chr", F.lit("src"), "type", "start", "stop", dot, "strand", dot, "attributes").alias("value"))
    path = _folder(spark, "gtf")
    lines.union(spark.createDataFrame([("#!comment",)], "value string")).write.text(path)
    return text.read_gtf(spark, path)


@_query("gtf_exons", ("ex", "ann"), [_EXON.replace("FROM ex WINDOW", "FROM (SELECT * FROM ex WHERE lang <> 'es') WINDOW")], "SELECT chr, tran_id, strand, exon_idx, start, stop, tran_start, tran_stop FROM exon")
def gtf_exons(spark: SparkSession, d: str) -> DataFrame:
    return annotation.exon_coords(annotation.with_transcript_id(gtf_file(spark, d)).where("tran_id <> ''"))


@_query("fasta_file", ("tr",), [], "SELECT tran_id, seq FROM tr")
def fasta_file(spark: SparkSession, d: str) -> DataFrame:
    """Headers with more than an id, a mark within a line, and lines of 60 bases."""
    tr = table(spark, d, "tr").select(F.concat("tran_id", F.lit("|"), "lang", F.lit(" c.1A>G")).alias("tran_id"), F.regexp_replace("seq", "(.{60})", "$1\n").alias("seq"))
    path = _folder(spark, "fasta")
    text.write_fasta(tr, path, parts=True)
    return text.read_fasta(spark, path)


@_query("transcript_fasta", ("tr",), [_SPLICED], "SELECT tran_id, string_agg(piece, '' ORDER BY CASE strand WHEN '+' THEN start ELSE -start END) AS seq FROM pieces GROUP BY tran_id, strand")
def transcript_fasta(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "transcripts") + "/out_transcripts.fa"
    text.write_fasta(spliced_sequence(spark, d), path)
    return text.read_fasta(spark, path)


@_query("bam_file", ("rd",), [], 'SELECT qname, rname, pos, "end" FROM rd')
def bam_file(spark: SparkSession, d: str) -> DataFrame:
    rd = table(spark, d, "rd")
    size = rd.agg(F.max("end")).first()[0] or 0
    folder = _folder(spark, "bam")
    rd.limit(0).write.parquet(folder)  # makes the folder
    return bam.read_bam(spark, bam.write_bam_parts(rd, [(f"chr{i}", size) for i in range(1, 6)], folder), split=1 << 18)


@_query("bedgraph_file", ("ex", "cdsg", "rd"), [*_MAPPED, _OFFSETS, _COVERAGE], "SELECT chr, start, stop, value FROM coverage")
def bedgraph_file(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "coverage") + "/out.bedGraph"
    text.write_bedgraph(_coverage(spark, d), path)
    return text.read_bedgraph(spark, path)


_SIZES = "SELECT chr, max(stop) + 2000 AS size FROM ex GROUP BY chr"


@_query("sizes_file", ("ex",), [], _SIZES)
def sizes_file(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "sizes")
    table(spark, d, "ex").groupBy("chr").agg((F.max("stop") + 2000).alias("size")).write.option("sep", "\t").csv(path)
    return text.read_sizes(spark, path)


#: A read at a contig's start can have its A-site before it (7 of 50,473 positions at sf0.01), where a BigWig has no places:
#: positions are moved in the file.
_MOVED = 1000


def _moved(coverage: DataFrame, by: int) -> DataFrame:
    return coverage.select("chr", (F.col("start") + by).alias("start"), (F.col("stop") + by).alias("stop"), "value")


def _bigwig(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark, "bigwig")
    coverage = _moved(_coverage(spark, d), _MOVED)
    coverage.limit(0).write.parquet(folder)  # makes the folder
    return bigwig.read_bigwig(spark, bigwig.write_bigwig(coverage, sizes_file(spark, d), f"{folder}/out.bw"))


@_query("bigwig_file", ("ex", "cdsg", "rd"), [*_MAPPED, _OFFSETS, _COVERAGE], "SELECT chr, start, stop, value FROM coverage")
def bigwig_file(spark: SparkSession, d: str) -> DataFrame:
    return _moved(_bigwig(spark, d), -_MOVED)


@_query("bigwig_ranges", ("ex", "cdsg", "rd"), [*_MAPPED, _OFFSETS, _COVERAGE], "SELECT chr, start, stop, value FROM coverage WHERE chr IN ('chr2', 'chr4') AND start < 500000 AND stop > 100000")
def bigwig_ranges(spark: SparkSession, d: str) -> DataFrame:
    some = _bigwig(spark, d).where(f"chr IN ('chr2', 'chr4') AND start < {500000 + _MOVED} AND stop > {100000 + _MOVED}")
    return _moved(some, -_MOVED)


@_query("offsets_file", ("ex", "cdsg", "rd"), [*_MAPPED, _OFFSETS], 'SELECT length, "offset" FROM offsets')
def offsets_file(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "offsets") + "/offsets.csv"
    text.write_table(change_point_offsets(spark, d), path)
    return text.read_offsets(spark, path)


@_query("exon_file", ("ex",), [_EXON], "SELECT chr, tran_id, '+' AS strand, exon_idx, start, stop, tran_start, tran_stop FROM exon")
def exon_file(spark: SparkSession, d: str) -> DataFrame:
    _, path = text.write_orfs_and_exons(_typed(spark, d).limit(0), _exons(spark, d), _folder(spark, "exons") + "/out")
    return text.read_exons(spark, path)


@_query("orf_file", ("tr", "ex", "cdsg"), [*_ANNOTATED, *_TYPES], f"SELECT {_ORF_COLUMNS}, type FROM typed")
def orf_file(spark: SparkSession, d: str) -> DataFrame:
    path, _ = text.write_orfs_and_exons(_typed(spark, d), _exons(spark, d), _folder(spark, "orfs") + "/out")
    return text.read_orfs(spark, path)


@_query("scored_file", _ALL, [*_COVERED, *_TYPES, _SUMS, _SCORED], f"SELECT {_ORF_COLUMNS}, type, {_SCORE_COLUMNS} FROM scored")
def scored_file(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "scored") + "/out_orfs_scored.csv"
    text.write_table(orf_scored(spark, d).orderBy(F.desc("score"), "tran_id", "start"), path)
    return text.read_scored(spark, path)


_SHOWN = ", ".join(f"CAST(round(CAST(round({c}, 9) AS DECIMAL(28, 9)), 2) AS DOUBLE) AS {c}" for c in _SCORED_COLUMNS)


@_query("top10_rounded", _ALL, [*_COVERED, *_TYPES, _SUMS, _SCORED], f"SELECT {_ORF_COLUMNS}, type, {_SHOWN}, CAST(rank AS INTEGER) AS rank FROM ({_RANKED}) WHERE rank <= 10")
def top10_rounded(spark: SparkSession, d: str) -> DataFrame:
    """The table of the report."""
    return report.rounded(top10_per_type(spark, d))


# twenty and more sequences to an id, each still searched by itself
@_query("orf_find_shared_ids", ("tr",), [_CODONS, _orf_sql()], "SELECT concat('G', CAST(substr(tran_id, 2) AS BIGINT) % 50) AS tran_id, start, stop, length, startorf, stoporf FROM orf")
def orf_find_shared_ids(spark: SparkSession, d: str) -> DataFrame:
    tr = table(spark, d, "tr").select(F.concat(F.lit("G"), F.col("doc_id") % 50).alias("tran_id"), "seq")
    return orfs.find_orfs(tr)


_ONCE = """
once AS (
  SELECT chr, "A-site", CAST(sum(count) AS BIGINT) AS count FROM (
    SELECT r.chr, r.start + 15 AS "A-site", r.qname, max(r.count) AS count
    FROM (SELECT CAST(split_part(qname, '_x', 2) AS BIGINT) AS count, qname, rname AS chr, pos AS start, "end" AS stop FROM rd) r
    JOIN exon e ON r.chr = e.chr AND r.start >= e.start AND r.stop <= e.stop JOIN cds c ON e.tran_id = c.tran_id
    GROUP BY ALL) GROUP BY ALL
)"""


@_query("asite_coverage_once", ("ex", "cdsg", "rd"), [*_ANNOTATED, _ONCE], 'SELECT chr, "A-site", "A-site" + 1 AS stop, count FROM once')
def asite_coverage_once(spark: SparkSession, d: str) -> DataFrame:
    """Every read name once at each A-site, with an offset of 15 for all lengths."""
    once = Semantics(dedupe_reads=True)
    placed = reads.reads_to_cds(reads.reads_to_transcript(reads.normalize_reads(table(spark, d, "rd"), semantics=once), _exons(spark, d)), _cds(spark, d))
    return reads.asite_coverage(placed, spark.range(0, 60).select(F.col("id").alias("length"), F.lit(15).cast("long").alias("offset")), once)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)
