"""Schemas of the logical tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_s, _l, _d, _i = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()

READS = _schema(qname=_s, rname=_s, pos=_l, end=_l)
ANNOTATION = _schema(chr=_s, type=_s, start=_l, stop=_l, strand=_s, attributes=_s)
COVERAGE = _schema(chr=_s, start=_l, stop=_l, value=_d)
SIZES = _schema(chr=_s, size=_l)
TRANSCRIPT = _schema(tran_id=_s, seq=_s)
EXON = _schema(chr=_s, tran_id=_s, strand=_s, exon_idx=_i, start=_l, stop=_l, tran_start=_l, tran_stop=_l)
CDS = _schema(tran_id=_s, tran_start=_l, tran_stop=_l)
OFFSETS = _schema(length=_l, offset=_l)
ORF = _schema(tran_id=_s, start=_l, stop=_l, length=_l, startorf=_s, stoporf=_s)
ORF_TYPED = T.StructType([*ORF.fields, T.StructField("type", _s)])
ORF_SCORED = T.StructType([*ORF_TYPED.fields, *_schema(rise_up=_d, step_down=_d, hrf=_d, avg=_d, nzc=_d, score=_d).fields])
TRAN_READS = _schema(tran_id=_s, tran_start=_l, tran_stop=_l, counts=_d)
EXON_FILE = _schema(chr=_s, tran_id=_s, start=_s, stop=_s, tran_start=_s, tran_stop=_s)

ORF_TYPES = ("uORF", "CDS", "dORF", "uoORF", "doORF", "iORF", "eoORF", "extORF", "Unexpected", "Non Coding")
SCORES = ("rise_up", "step_down", "hrf", "avg", "nzc")
