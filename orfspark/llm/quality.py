"""Quality rules: rule statistics of whole texts, and an isolation forest whose threshold comes from labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import column, steps
from .rules import IsolationForest, statistics
from .scratch import Scratch, restrict

#: Labelled rows that the forest is grown from, at most: those with the smallest hashes of their ids.
FOREST_ROWS = 8192
#: Trees, rows that each of them is grown from, and its splits from the root, at most.
TREES, TREE_ROWS, DEPTH = 100, 256, 16
#: Least words of a document, and the largest percentage of its words that may lie in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Rejecting a share of the clean labelled rows weighs as much as keeping this many times that share of the poor ones.
CLEAN_WEIGHT = 10
_BINS = 4000
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED * s["n_words"])


def _judged(texts: pa.Array, forest: IsolationForest | None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Statistics, whether the base rules fail, and the anomaly score (0 without a forest) of each text."""
    s = statistics(texts)
    return s, _base_failed(s), forest.score(s["features"]) if forest else np.zeros(len(texts))


def _known(labels: DataFrame) -> DataFrame:
    """One label per document; where several differ the lowest counts."""
    return labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def fit_forest(docs: DataFrame, labels: DataFrame) -> IsolationForest | None:
    """A forest grown from the clean ones (all, if none is) of at most FOREST_ROWS labelled documents, over the box of all of
    these; None where no document has a label."""
    wanted = _known(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FOREST_ROWS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "text"):
            s = statistics(column(step, "text"))
            yield pa.RecordBatch.from_arrays([column(step, "doc_id"), pa.array(_base_failed(s)), pa.array(list(s["features"]), pa.list_(pa.float64()))], ["doc_id", "failed", "features"])

    found = restrict(docs.select("doc_id", "text"), wanted.select("doc_id"), "doc_id").mapInArrow(rows, "doc_id long, failed boolean, features array<double>")
    sample = found.join(F.broadcast(wanted), "doc_id").orderBy("doc_id", "features").limit(FOREST_ROWS).collect()  # FOREST_ROWS rows on either side
    if not sample:
        return None
    features = np.array([r.features for r in sample])
    clean = np.array([bool(r.quality) and not r.failed for r in sample])
    return IsolationForest(features[clean] if clean.any() else features, features.min(axis=0), features.max(axis=0), TREES, TREE_ROWS, DEPTH)


def measure(docs: DataFrame, forest: IsolationForest | None) -> DataFrame:
    """doc_id, the five counts, base_failed and the anomaly score (0 without a forest) of each row of ``docs``."""
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, anomaly double"
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # TREES trees of at most 2 * TREE_ROWS nodes

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "text"):
            s, failed, score = _judged(column(step, "text"), shared.value)
            arrays = [column(step, "doc_id"), *(pa.array(s[c]) for c in _COUNTS), pa.array(failed), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *_COUNTS, "base_failed", "anomaly"])

    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def calibrate(measured: DataFrame, labels: DataFrame) -> float:
    """The anomaly score above which a document is rejected, from every labelled row that the base rules keep.

    Only counts by score bin and label reach the driver. Infinite where the labels lack either kind.
    """
    scored = measured.where("not base_failed").select("doc_id", F.floor(F.col("anomaly") * _BINS).cast("int").alias("bin"))
    counts = scored.join(_known(labels), "doc_id").groupBy("bin", "quality").count().collect()
    good, bad = np.zeros(_BINS + 2), np.zeros(_BINS + 2)
    for r in counts:
        (good if r.quality else bad)[r.bin] += r["count"]
    if not good.sum() or not bad.sum():
        return float("inf")
    above = lambda x: x[::-1].cumsum()[::-1] / x.sum()
    gain = above(bad) - CLEAN_WEIGHT * above(good)
    best = int(np.argmax(gain))
    return best / _BINS if gain[best] > 0 else float("inf")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts, base_failed, anomaly, kept.

    A null text has no words and fails the base rules, as does an empty one. Repeated rows get equal rows, a null id keeps
    its own row (it has no label). Ties with the threshold are rejected. Without labels of both kinds only the base rules
    reject. Extra columns are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    measured = scratch.save(measure(docs, fit_forest(docs, labels)), "measured")
    threshold = calibrate(measured, labels)
    return measured.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(threshold)))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``quality_rules`` keeps, all columns as they were, extra ones too.

    Nulls, empty and long texts, ties, repeated rows and missing labels are judged as there; an empty table stays empty. Each text
    is read by Python once, where it lies: rows are written with their scores, and the threshold then picks among them.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    shared = docs.sparkSession.sparkContext.broadcast(fit_forest(docs, labels))

    @F.arrow_udf("struct<base_failed: boolean, anomaly: double>")
    def judge(texts: pa.Array) -> pa.Array:
        parts = [_judged(column(step, "text"), shared.value) for step in steps(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text")]
        failed, score = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in (1, 2))
        return pa.StructArray.from_arrays([pa.array(failed, pa.bool_()), pa.array(score, pa.float64())], ["base_failed", "anomaly"])

    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    judged = scratch.save(docs.select(row, judge("text").alias("found")), "judged")
    threshold = calibrate(judged.select("row.doc_id", "found.base_failed", "found.anomaly"), labels)
    return judged.where(~F.col("found.base_failed") & (F.col("found.anomaly") < F.lit(threshold))).select("row.*")
