"""Bound-certified best-fit packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import column, steps
from .scratch import Scratch
from .tokens import default_vocabulary, encoder

CAPACITY, END_ID = 4096, 1
#: Pieces that one task packs; about 150 bytes each. Later rounds halve the tasks up to so many times as many pieces in one.
PIECES, FULLER = 40_000, 8


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids with END_ID after them, cut only above ``capacity``."""
    path = vocabulary or default_vocabulary()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for step in steps(batches, "text"):
            ids, offsets, *_ = encode(column(step, "text"))
            row, piece, start, length, crc = [], [], [], [], []
            for d in range(len(step)):
                own = np.append(ids[offsets[d] : offsets[d + 1]], END_ID).astype("<u4")
                for k, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    row.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            arrays = [column(step, "doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The best of several dual feasible functions: no packing of these lengths has fewer bins. Whole numbers throughout."""
    if not len(lengths):
        return 0
    x, n = lengths.astype(np.int64), counts.astype(np.int64)
    best = -(-int((x * n).sum()) // capacity)
    steps_ = np.unique(np.concatenate([[0], x[2 * x <= capacity], [capacity // 2]]))
    for e in steps_:
        big, middle = x > capacity - e, (x >= e) & (x <= capacity - e)
        # lengths above capacity - e count as a whole bin, those below e as nothing
        best = max(best, int(n[big].sum()) - (-int((x * n)[middle].sum()) // capacity))
        if e:
            # a length over half counts as a bin less the whole steps of e that fit beside it, the others as their whole steps
            whole = capacity // e
            half = 2 * x == capacity
            parts = np.where(2 * x > capacity, 2 * (whole - (capacity - x) // e), np.where(half, whole, 2 * (x // e)))
            best = max(best, -(-int((parts * n).sum()) // (2 * whole)))
    for k in range(1, 41):
        # lengths rounded down to k-ths, exact multiples of 1 / (k + 1) kept
        exact = (x * (k + 1)) % capacity == 0
        parts = np.where(exact, x * (k + 1) // capacity * k, x * (k + 1) // capacity * (k + 1))
        best = max(best, -(-int((parts * n).sum()) // (k * (k + 1))))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each length's bin and offset, and the free room of each bin."""
    order = np.argsort(-lengths, kind="stable")
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free: list[int] = []
    some = 0  # bit r is set while a bin has room r
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = some >> size
        if fits:
            r = (fits & -fits).bit_length() - 1 + size
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
        else:
            b, r = len(free), capacity
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        r -= size
        free[b] = r
        if not room[r]:
            some |= 1 << r
        room[r].append(b)
    return bins, offsets, np.array(free, np.int64)


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, step: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Pack a partition; ``certified`` where its number of bins meets its bound. Bins stay open to the next round where they have
    room and the partition is not certified, or where they are the emptiest of one that is, whose room only others can fill."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    lengths = rows.column("length").to_numpy()
    bins, offsets, free = best_fit(lengths, capacity)
    certified = len(free) == lower_bound(*np.unique(lengths, return_counts=True), capacity)
    open_ = free * 20 > capacity if certified else free * 100 > capacity
    if last:
        open_[:] = False
    base = (step << 56) | (rows.column("part")[0].as_py() << 24)
    rows = rows.drop_columns("part")
    more = {"sequence_id": pa.array(bins + base), "offset": pa.array(offsets), "open": pa.array(open_[bins]), "certified": pa.array(np.full(len(rows), certified))}
    for name, values in more.items():
        rows = rows.append_column(name, values)
    yield from rows.combine_chunks().to_batches()


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of ``docs``, and the proof:
    ``certified`` (the partition that made the sequence has as few as its own bound allows) and ``least_sequences`` (the bound
    of the whole table; as many sequences are as few as can be).

    A null or empty text is one piece with END_ID alone; a text of any length is encoded whole. Rows with a null id and rows
    that repeat an id are packed like others. Pieces of equal length are packed in any order. Extra columns are ignored; an
    empty table gives an empty result.

    Each partition runs best-fit decreasing and compares its bins with its own lower bound. What lies in bins with room is
    exchanged: it goes to fewer partitions, which pack it anew, round after round, until the sum of bins meets the bound of the
    whole table (from counts by length), one partition held all that was left, or a round gains nothing and partitions can be no
    fewer, as each holds what a task may.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    left = scratch.save(pieces(docs, capacity, vocabulary).withColumn("row", F.monotonically_increasing_id()), "pieces")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, open boolean, certified boolean"
    by_length = left.groupBy("length").count().collect()  # at most ``capacity`` rows
    least = lower_bound(np.array([r.length for r in by_length], np.int64), np.array([r["count"] for r in by_length], np.int64), capacity)
    rows, done, closed, before, step = sum(r["count"] for r in by_length), [], 0, None, 0
    tasks = 2 * rows
    while True:
        earlier, tasks = tasks, max(1, min(-(-rows // PIECES), tasks // 2), -(-rows // (FULLER * PIECES)))
        # dealt by row numbers, so ids that are null or repeat are spread too
        dealt = left.repartition(tasks, "row", F.lit(step)).withColumn("part", F.spark_partition_id())
        packed = scratch.save(dealt.mapInArrow(lambda b, step=step, last=tasks == 1: _pack(b, capacity, step, last), schema), f"round-{step}")
        sums = packed.groupBy("open").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("sequence_id").alias("bins")).collect()
        bins = {r.open: r.bins for r in sums}
        rows = sum(r.rows for r in sums if r.open)
        total = closed + sum(bins.values())
        if not rows or total <= least or (before is not None and total >= before and tasks >= earlier):
            done.append(packed)
            break
        done.append(packed.where("not open"))
        closed += bins.get(False, 0)
        before, left, step = total, packed.where("open").select(*columns, "row"), step + 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select(*columns, "sequence_id", "offset", "certified", F.lit(least).cast("long").alias("least_sequences"))
