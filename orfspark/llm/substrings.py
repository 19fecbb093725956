"""Substring deduplication: anchors name the places where text may recur, suffix automata over them prove it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import column, steps
from .scratch import BROADCAST_IDS, Scratch, restrict, without
from .spans import SuffixAutomaton
from .wordhash import Words, joined, split_words, windows, word_hashes

#: Words of a window; a window that recurs anywhere is removed.
WINDOW = 35
#: Words of an anchor: each window's anchor is its run of so many words with the least hash. Equal windows have equal anchors.
ANCHOR = 8
#: Distinct ranges of an anchor that one automaton takes. Beyond it an anchor's windows become anchors of their own and are dealt
#: out by their 128-bit hashes, as one key would fill a task; a shard of equal windows is its own automaton, so counting answers it.
MOST_RANGES = 256
#: Words of the reference shard that an automaton is built over, about.
SHARD_WORDS = 20_000


def _anchors(texts: pa.Array, size: int) -> tuple[np.ndarray, ...]:
    """Per run of windows of one text with the same anchor: text, anchor hash, digest of the range's words, first word in text, windows."""
    words = split_words(texts)
    h = word_hashes(words)
    g = windows(h, ANCHOR, 1)
    spread = size - ANCHOR + 1
    n = len(h) - size + 1
    nothing = np.zeros(0, np.int64)
    if n <= 0:
        return nothing, nothing, nothing, nothing, nothing
    least, reach = np.arange(len(g)), 1
    better = lambda p, q: np.where(g[q] < g[p], q, p)  # noqa: E731  the first of equals
    while reach * 2 <= spread:
        least, reach = better(least[:-reach], least[reach:]), reach * 2
    if spread > reach:
        least = better(least[: len(least) - (spread - reach)], least[spread - reach :])
    ok = np.flatnonzero(words.doc[:n] == words.doc[size - 1 :])
    if not len(ok):
        return nothing, nothing, nothing, nothing, nothing
    at, doc = least[ok], words.doc[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    s = np.flatnonzero(new)
    count = np.diff(np.append(s, len(ok)))
    first = ok[s]
    flat, begin = joined(words)
    data, a, b = flat.tobytes(), begin[first].tolist(), (begin[first + count + size - 1] - 1).tolist()
    whole = b"".join([hashlib.blake2b(data[x:y], digest_size=8).digest() for x, y in zip(a, b, strict=True)])
    return doc[s], g[at[s]].view(np.int64), np.frombuffer(whole, "<i8"), first - words.first[doc[s]], count


def ranges(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """key, anchor (a hash), range (a cryptographic digest of its words), first (word number) and n (windows) of each range.

    Every window is in one range. Two ranges count as equal where anchor and digest are.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "text"):
            doc, anchor, whole, first, n = _anchors(column(step, "text"), size)
            ids = column(step, "key").take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([ids, pa.array(anchor), pa.array(whole), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], ["key", "anchor", "range", "first", "n"])

    return docs.select("key", "text").mapInArrow(rows, "key long, anchor long, range long, first int, n int")


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (text, wanted: array of anchor, range, first, n): the words of each wanted range."""
    for step in steps(batches, "text"):
        texts = column(step, "text")
        words = split_words(texts)
        anchor, whole, n, text = [], [], [], []
        for d, wanted in enumerate(column(step, "wanted").to_pylist()):
            at = words.first[d]
            for r in wanted:
                b = at + r["first"]
                anchor.append(r["anchor"])
                whole.append(r["range"])
                n.append(r["n"])
                text.append(words.buffer[words.start[b] : words.end[b + r["n"] + size - 2]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(whole, pa.int64()), pa.array(n, pa.int32()), pa.array(text, pa.binary())], ["anchor", "range", "n", "words"])


def _match(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: a bit for each window of a range, set where the matching statistics reach a window's length."""

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        automaton = SuffixAutomaton()
        split = [text.split() for _, _, text, _ in rows]
        for (_, _, _, times), own in zip(rows, split, strict=True):
            automaton.add(own, times)
        automaton.close()
        masks = []
        for own in split:
            mask = 0
            for i, reach in enumerate(automaton.statistics(own)[size - 1 :]):
                mask |= (reach >= size) << i
            masks.append(mask)
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(masks, pa.int64())], ["anchor", "range", "mask"])

    held: list[tuple] = []
    total, last = 0, None
    for batch in batches:
        for row in zip(*(column(batch, c).to_pylist() for c in ("anchor", "range", "words", "times")), strict=True):
            if row[0] != last and total >= SHARD_WORDS:
                yield shard(held)
                held, total = [], 0
            held.append(row)
            last = row[0]
            total += row[2].count(b" ") + 1
    if held:
        yield shard(held)


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """128-bit hashes of each window of a range."""
    for step in steps(batches, "words"):
        words = split_words(column(step, "words").cast(pa.large_binary()).cast(pa.large_string()))
        first, second = (windows(word_hashes(words, seed), size, seed) for seed in (61, 62))
        ok = np.flatnonzero(words.doc[: len(first)] == words.doc[size - 1 :]) if len(first) else np.zeros(0, np.int64)
        d = words.doc[ok]
        take = pa.array(d)
        cells = [column(step, "anchor").take(take), column(step, "range").take(take), column(step, "times").take(take), pa.array((ok - words.first[d]).astype(np.int32)), pa.array(first[ok].view(np.int64)), pa.array(second[ok].view(np.int64))]
        yield pa.RecordBatch.from_arrays(cells, ["anchor", "range", "times", "i", "x", "y"])


def recurring(docs: DataFrame, size: int, scratch: Scratch) -> DataFrame:
    """key, first, mask: the ranges with a window that also starts elsewhere; bit i of mask stands for window first + i."""
    every = scratch.save(ranges(docs, size), "ranges")
    # written, so that the join stands on exchanges alone and a hot anchor's partition can be split
    twice = scratch.save(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("anchor"), "anchors")
    found = scratch.save(every.join(twice, "anchor", "left_semi"), "found")
    scratch.drop("ranges", "anchors")
    one = F.min(F.struct("key", "first", "n")).alias("one")
    distinct = scratch.save(found.groupBy("anchor", "range").agg(F.count(F.lit(1)).alias("times"), one), "distinct")
    many = scratch.save(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("ranges")).where("ranges > 1"), "many")
    open_ = distinct.join(many, "anchor")
    wanted = open_.groupBy(F.col("one.key").alias("key")).agg(F.collect_list(F.struct("anchor", "range", F.col("one.first").alias("first"), F.col("one.n").alias("n"))).alias("wanted"))
    wanted = scratch.save(wanted, "wanted")
    texts = restrict(docs.select("key", "text"), wanted.select("key"), "key").join(wanted, "key")
    cut = scratch.save(texts.mapInArrow(lambda b: _cut(b, size), "anchor long, range long, n int, words binary"), "cut")
    scratch.drop("wanted")
    cut = cut.join(open_.select("anchor", "range", "times", "ranges"), ["anchor", "range"])
    few = cut.where(F.col("ranges") <= MOST_RANGES).repartition("anchor").sortWithinPartitions("anchor")
    by_automaton = few.select("anchor", "range", "words", "times").mapInArrow(lambda b: _match(b, size), "anchor long, range long, mask long")
    each = cut.where(F.col("ranges") > MOST_RANGES).mapInArrow(lambda b: _windows(b, size), "anchor long, range long, times long, i int, x long, y long")
    each = scratch.save(each, "each")
    often = each.groupBy("x", "y").agg(F.sum("times").alias("all")).where("all > 1").select("x", "y")
    by_count = each.join(often, ["x", "y"], "left_semi").groupBy("anchor", "range").agg(F.expr("bit_or(shiftleft(1L, i))").alias("mask"))
    masks = scratch.save(by_automaton.union(by_count).where("mask <> 0"), "masks")
    scratch.drop("cut", "each", "many")
    whole = distinct.where("times > 1").select("anchor", "range", F.expr("shiftleft(1L, one.n) - 1").alias("mask"))
    masks = whole.union(masks.join(distinct.where("times > 1"), ["anchor", "range"], "left_anti"))
    return found.join(masks, ["anchor", "range"]).select("key", "first", "mask")


def _covered(words: Words, masks: pa.Array, size: int) -> np.ndarray:
    """Which words are in a window that a text's ``masks`` (arrays of first, n, mask; null for none) name."""
    edge = np.zeros(len(words.start) + 1, np.int64)
    own = masks.flatten()
    if len(own):
        first, mask = (pc.struct_field(own, f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("first", "mask"))
        counts = pc.fill_null(pc.list_value_length(masks), 0).to_numpy(zero_copy_only=False)
        begin = np.repeat(words.first[:-1], counts) + first
        row, i = np.nonzero((mask[:, None] >> np.arange(size - ANCHOR + 1)) & 1)
        at = begin[row] + i
        edge += np.bincount(at, minlength=len(edge)) - np.bincount(at + size, minlength=len(edge))
    return edge.cumsum()[:-1] > 0


def _repeated(docs: DataFrame, size: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Keyed rows with a recurring window, with the array of their ranges as ``masks``; and the other rows."""
    found = recurring(docs, size, scratch)
    by_doc = scratch.save(found.groupBy("key").agg(F.collect_list(F.struct("first", "mask")).alias("masks")), "by_doc")
    scratch.drop("found", "distinct", "masks")
    if by_doc.count() > BROADCAST_IDS:
        # one exchange of the rows serves both
        placed = scratch.save(docs.join(by_doc, "key", "left"), "placed")
        return placed.where("masks is not null"), placed.where("masks is null").drop("masks")
    ids = by_doc.select("key")
    return restrict(docs, ids, "key").join(by_doc, "key"), without(docs, ids, "key")


def keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, text, row) with the whole row as a struct: the key is doc_id or, where ids are null or repeat, a number of the row."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 or doc_id is null")
    if ids.limit(1).isEmpty():
        return docs.select(F.col("doc_id").cast("long").alias("key"), "text", row)
    return scratch.save(docs.select(F.monotonically_increasing_id().alias("key"), "text", row), "keyed")


def removed_spans(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space.

    A null or empty text has no words and keeps the empty string. Windows are judged on the input; one that recurs in its
    own text counts, and so does one of an exact copy, of which no copy keeps it. Rows that repeat an id and rows with a
    null id are rows like others. A text of any length is judged whole. Extra columns are ignored; an empty table gives an empty
    result.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    some, rest = _repeated(keyed(docs.select("doc_id", "text"), scratch), size, scratch)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "text"):
            words = split_words(column(step, "text"))
            keep = ~_covered(words, column(step, "masks"), size) if "masks" in step.schema.names else np.ones(len(words.start), bool)
            flat, begin = joined(words, keep)
            upto = np.concatenate([[0], np.cumsum(keep)])[words.first]
            data, a, b = flat.tobytes(), begin[upto[:-1]].tolist(), begin[upto[1:]].tolist()
            kept = [hashlib.sha256(data[x : max(x, y - 1)]).hexdigest() for x, y in zip(a, b, strict=True)]
            counts = words.count()
            yield pa.RecordBatch.from_arrays([column(step, "doc_id"), pa.array(counts, pa.int64()), pa.array(counts - np.diff(upto), pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    some, rest = some.select(F.col("row.doc_id").alias("doc_id"), "text", "masks"), rest.select(F.col("row.doc_id").alias("doc_id"), "text")
    return some.mapInArrow(rows, schema).union(rest.mapInArrow(rows, schema))


def cut_spans(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` without the words of recurring windows; all columns, with ``n_chars`` (if there is one) of the new text.

    Each removed word goes with the white space after it, so what is left keeps its lines. Other texts stay as they were: null
    and empty ones, and those without a recurring window. Rows that repeat an id or have none are rows like others; extra columns
    pass through, whatever their names; a text of any length is judged whole; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    some, rest = _repeated(keyed(docs, scratch), size, scratch)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "text"):
            words = split_words(column(step, "text"))
            gone, texts = _covered(words, column(step, "masks"), size), []
            for d in range(len(step)):
                b, e = words.first[d], words.first[d + 1]
                starts = np.append(words.start[b:e], words.text_end[d])
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone[b:e], [False]]).astype(np.int8)))
                at, parts = words.text_start[d], []
                for x, y in zip(starts[edge[::2]], starts[edge[1::2]], strict=True):
                    parts.append(words.buffer[at:x].tobytes())
                    at = y
                texts.append(b"".join([*parts, words.buffer[at : words.text_end[d]].tobytes()]).decode())
            row = column(step, "row")
            arrays = dict(zip([f.name for f in row.type], row.flatten(), strict=True))
            arrays["text"] = pa.array(texts, arrays["text"].type)
            if "n_chars" in arrays and pa.types.is_integer(arrays["n_chars"].type):
                arrays["n_chars"] = pa.array([len(t) for t in texts], arrays["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    return some.select("text", "masks", "row").mapInArrow(rows, docs.schema).union(rest.select("row.*"))
