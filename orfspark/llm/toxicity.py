"""A toxicity classifier over words and word beginnings, with a penalty on score changes when identity terms are swapped."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import column, steps
from .near import BAND, REGISTERS, registers
from .scratch import Scratch, restrict
from .wordhash import Words, shingles, split_words, word_hashes

#: Labelled rows that the classifier learns from, at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 12_000
#: Of every so many ids by CRC-32 one is held out.
FOLDS = 5
#: Features kept, at most: those whose presence tells most about the label, from LEAST_DOCS training rows on.
FEATURES, LEAST_DOCS, LEAST_GAIN = 2048, 4, 20.0
#: Weight of the squared score change under a swap, and of the squared weights.
COUNTERFACTUAL, RIDGE = 4.0, 0.02
#: Share of a row's features that each step of the fit leaves out, so that one of them comes to be enough.
DROPOUT = 0.5
#: Bands of a row's sketch by which near-copies among the training rows are found; one of each group is learnt from.
COPY_BANDS = 24
#: Beginnings of words that are features, in bytes.
BEGINNINGS = (4, 5, 6)

#: Words that name groups of people, in sets whose members are swapped for one another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual", "homosexual"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "sikhs", "catholics", "protestants"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "sikh", "catholic", "protestant"),
    ("black", "white", "asian", "latino", "hispanic", "arab", "african", "european", "american", "mexican", "chinese", "indian", "turkish", "russian"),
    ("immigrants", "refugees", "natives", "foreigners", "migrants"),
    ("old", "young", "elderly"),
    ("disabled", "deaf", "blind", "autistic"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos"),
)

_TRIM = np.ones(256, bool)
_TRIM[48:58] = _TRIM[65:91] = _TRIM[97:123] = _TRIM[128:] = False


def _bare(words: Words) -> Words:
    """The words without up to four ASCII marks at either end."""
    start, end = words.start.copy(), words.end.copy()
    for _ in range(4):
        end -= (end - start > 1) & _TRIM[words.buffer[end - 1]]
        start += (end - start > 1) & _TRIM[words.buffer[start]]
    return Words(words.buffer, start, end, words.doc, words.first, words.text_start, words.text_end)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature hash) of each word and of its beginnings; lower case by A-Z, repeats included."""
    words = _bare(split_words(texts))
    owner, values = [words.doc], [word_hashes(words, 90, lower=True)]
    size = words.end - words.start
    for k in BEGINNINGS:
        long = np.flatnonzero(size > k)
        part = Words(words.buffer, words.start[long], words.start[long] + k, words.doc[long], words.first, words.text_start, words.text_end)
        owner.append(part.doc)
        values.append(word_hashes(part, 90 + k, lower=True))
    return np.concatenate(owner), np.concatenate(values)


def _swapped(text: str) -> str:
    """The text with every identity term replaced by the next one of its set; equal to the text if it has none."""
    swap = {t: own[(i + 1) % len(own)] for own in IDENTITY_TERMS for i, t in enumerate(own)}
    out = []
    for w in text.split():
        bare = w.strip(".,;:!?\"'()").lower()
        out.append(w.lower().replace(bare, swap[bare]) if bare in swap else w)
    return " ".join(out)


def _terms() -> frozenset[str]:
    return frozenset(t for own in IDENTITY_TERMS for t in own)


@dataclass
class Model:
    """Sorted feature hashes, their weights, and the bias. A score is the logistic of bias plus weights of what is present."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def present(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature number) of the model's features."""
        owner, values = features(texts)
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.zeros(1 << 20, bool)
        near[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        maybe = near[(values & np.uint64((1 << 20) - 1)).astype(np.int64)]
        owner, values = owner[maybe], values[maybe]
        at = np.minimum(np.searchsorted(self.hashes, values), len(self.hashes) - 1)
        hit = self.hashes[at] == values
        pairs = np.unique(owner[hit].astype(np.int64) * len(self.hashes) + at[hit])
        return pairs // len(self.hashes), pairs % len(self.hashes)

    def score(self, texts: pa.Array) -> np.ndarray:
        owner, at = self.present(texts)
        logit = self.bias + np.bincount(owner, self.weights[at], minlength=len(texts)) if len(owner) else np.full(len(texts), self.bias)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(pairs: tuple[np.ndarray, np.ndarray], swapped: tuple[np.ndarray, np.ndarray], has_swap: np.ndarray, toxic: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise logistic loss + RIDGE |w|^2 / 2 + COUNTERFACTUAL * mean squared logit change under swaps."""
    row, at = pairs
    swap_row, swap_at = swapped
    n, swaps = len(toxic), max(1, int(has_swap.sum()))
    w, bias = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    rng = np.random.default_rng(5)
    every = row, at
    rate = toxic.mean()
    bias = float(np.log(max(rate, 1e-3) / max(1 - rate, 1e-3)))
    for step in range(1, 401):
        left = rng.random(len(every[0])) >= DROPOUT
        row, at = every[0][left], every[1][left]
        logit = bias + np.bincount(row, w[at], minlength=n)
        slope = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - toxic) / n
        gradient = np.bincount(at, slope[row], minlength=size) + RIDGE / n * w
        if has_swap.any():
            whole = np.bincount(every[0], w[every[1]], minlength=n)
            change = np.where(has_swap, whole - np.bincount(swap_row, w[swap_at], minlength=n), 0) * 2 * COUNTERFACTUAL / swaps
            gradient += np.bincount(every[1], change[every[0]], minlength=size) - np.bincount(swap_at, change[swap_row], minlength=size)
        gb = slope.sum()
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        fix, fix2 = 1 - 0.9**step, 1 - 0.999**step
        w = w - 0.05 * (m / fix) / (np.sqrt(v / fix2) + 1e-9)
        bias -= 0.05 * (mb / fix) / (np.sqrt(vb / fix2) + 1e-9)
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from at most TRAIN_ROWS labelled rows that are not held out; without both labels one that scores the base rate."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    usable = labels.where("toxic is not null and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    chosen = scratch.save(chosen, "chosen")
    # one text per id, the smallest of those that share it, so there are TRAIN_ROWS rows at most
    texts = restrict(docs.select("doc_id", "text"), chosen.select("doc_id"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    texts = scratch.save(texts.join(F.broadcast(chosen), "doc_id"), "texts")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "text"):
            values, offsets, _ = shingles(column(step, "text"))
            bands = registers(values, offsets).reshape(-1, REGISTERS // BAND, BAND)[:, :COPY_BANDS].copy().view(np.int64).reshape(-1, COPY_BANDS)
            yield pa.RecordBatch.from_arrays([column(step, "doc_id"), pa.array(list(bands), pa.list_(pa.int64()))], ["doc_id", "keys"])

    bands = scratch.save(texts.mapInArrow(keys, "doc_id long, keys array<long>").select("doc_id", F.posexplode("keys").alias("band", "key")), "bands")
    heads = bands.groupBy("band", "key").agg(F.min("doc_id").alias("head"))
    copies = bands.join(heads, ["band", "key"]).where("head < doc_id").select("doc_id").distinct()
    chosen = scratch.save(chosen.join(copies, "doc_id", "left_anti"), "different")
    texts = texts.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "text"):
            owner, values = features(column(step, "text"))
            order = np.lexsort((values, owner))
            owner, values = owner[order], values[order]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
            kinds, where = np.unique(values[new], return_inverse=True)
            bad = column(step, "toxic").to_numpy()[owner[new]] > 0
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(np.bincount(where, bad, len(kinds)).astype(np.int64)), pa.array(np.bincount(where, ~bad, len(kinds)).astype(np.int64))], ["feature", "bad", "good"])

    n_bad, n_good = chosen.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    if not n_bad or not n_good:
        rate = (n_bad + 0.5) / (n_bad + n_good + 1)
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(rate / (1 - rate))) if n_bad + n_good else -3.0)
    by = texts.mapInArrow(counts, "feature long, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    total = F.col("bad") + F.col("good")
    part = lambda c, n: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) * F.lit((n_bad + n_good) / n) / total)).otherwise(0.0)
    gain = 2 * (part("bad", n_bad) + part("good", n_good))
    told = by.where(total >= LEAST_DOCS).withColumn("gain", gain).where(F.col("gain") >= LEAST_GAIN)
    kept = told.orderBy(F.desc("gain"), "feature").limit(FEATURES).collect()
    model = Model(np.sort(np.array([r.feature for r in kept], np.int64).view(np.uint64)), np.zeros(len(kept)), 0.0)
    terms = _terms()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "text"):
            given = column(step, "text").to_pylist()
            named = [any(w.strip(".,;:!?\"'()").lower() in terms for w in (t or "").split()) for t in given]
            found = []
            for own in (given, [_swapped(t) if s else "" for t, s in zip(given, named, strict=True)]):
                owner, at = model.present(pa.array(own, pa.large_string()))
                found.append(pa.array(np.split(at, np.searchsorted(owner, np.arange(1, len(step)))), pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([column(step, "doc_id"), column(step, "toxic").cast(pa.int64()), pa.array(named), *found], ["doc_id", "toxic", "named", "own", "swapped"])

    table = texts.mapInArrow(rows, "doc_id long, toxic long, named boolean, own array<long>, swapped array<long>").orderBy("doc_id").toPandas()
    pairs = lambda c: (np.repeat(np.arange(len(table)), table[c].str.len()), np.concatenate([*table[c], np.zeros(0, np.int64)]).astype(np.int64))
    model.weights, model.bias = fit(pairs("own"), pairs("swapped"), table["named"].to_numpy(bool), (table["toxic"] > 0).to_numpy(float), len(kept))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Only texts are scored: null and empty ones get the score of a text without features. Rows that repeat an id are scored
    by their own texts, and the classifier learns from the smallest of them. Texts of any length are read whole. A null id is not held out. Where several labels name one document the highest counts; null labels
    count as none. Extra columns are ignored; an empty table gives an empty result.
    """
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "text"):
            yield pa.RecordBatch.from_arrays([column(step, "doc_id"), pa.array(shared.value.score(column(step, "text")))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
