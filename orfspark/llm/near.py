"""HyperMinHash near-duplicate detection: compressed registers, banding, corrected estimates, links proven on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import column, steps
from .components import components
from .scratch import BROADCAST_IDS, Scratch, restrict, without
from .wordhash import mix64, shingles

#: Words of a shingle; a link needs 100 * |A and B| >= PERCENT * |A or B|.
WIDTH, PERCENT = 5, 75
#: Registers of a sketch, those of a band, and mantissa bits of a register; its other six bits count leading zeros.
#: A linked pair shares no band with a probability of about (1 - 0.75 ** 4) ** 48 = 1e-8.
REGISTERS, BAND, MANTISSA = 192, 4, 10
BANDS = REGISTERS // BAND
#: Standard deviations below the threshold at which an estimate rules a pair out (about 1e-10 of linked pairs).
SIGMAS = 6.5
#: Rows of a block; larger buckets are compared block by block.
BLOCK = 1024
_SMALLEST, _LARGEST = 64, 16384  # bits of a bitmap


def _probe_table() -> np.ndarray:
    """For each register the order in which an empty one looks at the others for a value to borrow."""
    rng = np.random.default_rng(11)
    return np.stack([rng.permutation(REGISTERS) for _ in range(REGISTERS)])


_PROBES = _probe_table()


def registers(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16) of each set ``values[offsets[i]:offsets[i + 1]]``; an empty set has zeros."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    spread = mix64(values, 31)
    bucket = ((spread >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
    least = np.full(n * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, owner * REGISTERS + bucket.astype(np.int64), mix64(values, 32))
    least = least.reshape(n, REGISTERS)
    empty = least == np.iinfo(np.uint64).max
    # leading zeros from the exponent of the top 53 bits, mantissa from the bits that follow the leading one
    top = (least >> np.uint64(11)).astype(np.float64)
    exponent = np.frexp(np.maximum(top, 0.5))[1]
    zeros = np.clip(53 - exponent, 0, 53).astype(np.uint64)
    with np.errstate(over="ignore"):
        mantissa = (least << np.minimum(zeros + np.uint64(1), np.uint64(63))) >> np.uint64(64 - MANTISSA)
    out = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    some = ~empty.all(axis=1)
    out[~some] = 0
    row, at = np.nonzero(empty & some[:, None])
    k = 0
    while len(row):
        source = _PROBES[at, k]
        found = ~empty[row, source]
        out[row[found], at[found]] = out[row[found], source[found]]
        row, at, k = row[~found], at[~found], k + 1
    return out


def bitmaps(values: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """For each set two bitmaps of about four bits a shingle: cells hit at least once, and at least twice."""
    once, twice = [], []
    cells = mix64(values, 41)
    for i in range(len(offsets) - 1):
        n = int(offsets[i + 1] - offsets[i])
        bits = min(_LARGEST, max(_SMALLEST, 1 << (4 * n - 1).bit_length() if n else 0))
        hits = np.bincount((cells[offsets[i] : offsets[i + 1]] & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
        once.append(np.packbits(hits >= 1, bitorder="little").tobytes())
        twice.append(np.packbits(hits >= 2, bitorder="little").tobytes())
    return once, twice


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the shingle set (hi, lo), registers and bitmaps; rows with a null id are left out."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps(batches, "text"):
            values, offsets, _ = shingles(column(step, "text"), WIDTH)
            total = lambda seed: np.diff(np.concatenate([[np.uint64(0)], np.cumsum(mix64(values, seed))])[offsets])
            regs, (once, twice) = registers(values, offsets), bitmaps(values, offsets)
            arrays = [
                column(step, "doc_id"), pa.array(np.diff(offsets)), pa.array(total(51).view(np.int64)), pa.array(total(52).view(np.int64)),
                pa.array([r.tobytes() for r in regs], pa.binary()), pa.array(once, pa.binary()), pa.array(twice, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "hi", "lo", "regs", "once", "twice"])

    schema = "doc_id long, n_shingles long, hi long, lo long, regs binary, once binary, twice binary"
    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(rows, schema)


def chance(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The expected share of registers that agree for disjoint sets: same leading zeros, same mantissa."""
    octave = 0.5 ** np.arange(0, 40)
    pa_, pb = (np.exp(-np.outer(n / REGISTERS, octave[1:])) - np.exp(-np.outer(n / REGISTERS, octave[:-1])) for n in (na, nb))
    return (pa_ * pb).sum(axis=1) / (1 << MANTISSA)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates from registers, corrected for chance agreement."""
    c = chance(na, nb)
    return ((ra == rb).mean(axis=1) - c) / (1 - c)


def floor_of_estimates(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Estimates below this rule a link out; small sets fill few registers of their own, so theirs say less."""
    own = 0.8 * REGISTERS * (1 - np.exp(-np.minimum(na, nb) / REGISTERS))
    p = PERCENT / 100
    return p - SIGMAS * np.sqrt(p * (1 - p) / np.maximum(own, 1))


class _Side:
    """Sketch columns of a batch of rows."""

    def __init__(self, batch: pa.RecordBatch, suffix: str = ""):
        get = lambda n: column(batch, n + suffix)
        self.n = get("n_shingles").to_numpy()
        self.regs = np.frombuffer(b"".join(get("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        self.once, self.twice = get("once").to_pylist(), get("twice").to_pylist()
        self.bits = np.array([8 * len(x) for x in self.once], np.int64)
        self.levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def level(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers in, and both bitmaps of, the rows with ``bits`` bits or twice as many, these folded in half."""
        if bits not in self.levels:
            where = np.full(len(self.n), -1)
            maps = []
            for size in (bits, 2 * bits):
                rows = np.flatnonzero(self.bits == size)
                where[rows] = np.arange(len(rows)) + sum(len(m[0]) for m in maps)
                o, t = (np.frombuffer(b"".join([x[r] for r in rows]), np.uint64).reshape(len(rows), size // 64) for x in (self.once, self.twice))
                if size > bits:
                    h = size // 128
                    o, t = o[:, :h] | o[:, h:], t[:, :h] | t[:, h:] | (o[:, :h] & o[:, h:])
                maps.append((o, t))
            self.levels[bits] = where, np.concatenate([m[0] for m in maps]), np.concatenate([m[1] for m in maps])
        return self.levels[bits]


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def most_shared(x: _Side, i: np.ndarray, y: _Side, j: np.ndarray, bits: int) -> np.ndarray:
    """Proven upper bounds of intersections: per cell at most the smaller of both hit counts, and what further hits can add."""
    (wx, ox, tx), (wy, oy, ty) = x.level(bits), y.level(bits)
    oa, ta, ob, tb = ox[wx[i]], tx[wx[i]], oy[wy[j]], ty[wy[j]]
    over = np.minimum(x.n[i] - _ones(oa) - _ones(ta), y.n[j] - _ones(ob) - _ones(tb))
    return _ones(oa & ob) + _ones(ta & tb) + over


def _possible(x: _Side, i: np.ndarray, y: _Side, j: np.ndarray) -> np.ndarray:
    """Which pairs (i of x, j of y) can be links by their sizes, estimates and bitmaps."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 10_000):
        a, b = i[at : at + 10_000], j[at : at + 10_000]
        na, nb = x.n[a], y.n[b]
        ok = np.flatnonzero(100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb))
        ok = ok[estimate(x.regs[a[ok]], y.regs[b[ok]], na[ok], nb[ok]) >= floor_of_estimates(na[ok], nb[ok])]
        least = np.minimum(x.bits[a[ok]], y.bits[b[ok]])
        for bits in np.unique(least):
            k = ok[least == bits]
            most = most_shared(x, a[k], y, b[k], int(bits))
            out[at + k] = 100 * most >= PERCENT * (na[k] + nb[k] - most)
    return out


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both sketches in a row: those that can be links."""
    for batch in batches:
        x, y = _Side(batch, "_a"), _Side(batch, "_b")
        at = np.arange(len(batch))
        yield batch.select(["a", "b"]).filter(pa.array(_possible(x, at, y, at)))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, bi, bj), all rows of a block pair together: pairs of different components that can be links.

    A pair is looked at in the first band that it shares, and within one block pair only. Rows of different blocks meet; rows of
    one block do where the pair is of the block with itself.
    """
    keys = ("key", "bi", "bj")
    held: list[pa.RecordBatch] = []

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        batch = rows.combine_chunks().to_batches()[0]
        side, band = _Side(batch), column(batch, "band").to_numpy()
        own, comp, doc = (column(batch, c).to_numpy() for c in ("block", "comp", "doc_id"))
        bi, bj = column(batch, "bi").to_numpy(), column(batch, "bj").to_numpy()
        k = np.stack([column(batch, c).to_numpy() for c in keys])
        start = np.flatnonzero(np.concatenate([[True], (k[:, 1:] != k[:, :-1]).any(axis=0)]))
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(batch))))
        view = side.regs.reshape(len(batch), BANDS, BAND).view(np.uint64).reshape(len(batch), BANDS)
        live, shift = np.arange(len(batch)), 1
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            live = live[live + shift < len(batch)]
            live = live[group[live] == group[live + shift]]
            i, j = live, live + shift
            wanted = (comp[i] != comp[j]) & ((bi[i] == bj[i]) | (own[i] != own[j])) & (doc[i] != doc[j])
            i, j = i[wanted], j[wanted]
            if len(i):
                first = (view[i] == view[j]).argmax(axis=1) == band[i]
                i, j = i[first], j[first]
                ok = _possible(side, i, side, j)
                found.append((i[ok], j[ok]))
            shift += 1
        for i, j in found:
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(doc[i], doc[j])), pa.array(np.maximum(doc[i], doc[j]))], ["a", "b"])

    for batch in batches:
        if not len(batch):
            continue
        last = tuple(column(batch, c)[len(batch) - 1].as_py() for c in keys)
        k = [column(batch, c).to_numpy() for c in keys]
        same = np.logical_and.reduce([x == v for x, v in zip(k, last, strict=True)])
        begin = len(batch) - int(same[::-1].argmin()) if not same.all() else 0
        if begin:
            held.append(batch.slice(0, begin))
        elif held and tuple(column(held[-1], c)[len(held[-1]) - 1].as_py() for c in keys) == last:
            held.append(batch)
            continue
        if held:
            yield from pairs(pa.Table.from_batches(held))
        held = [batch.slice(begin)]
    if held:
        yield from pairs(pa.Table.from_batches(held))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both whole texts in a row: links, by their full shingle sets."""
    for step in steps(batches, "text_a"):
        for part in steps(iter([step]), "text_b"):
            (va, oa, _), (vb, ob, _) = shingles(column(part, "text_a"), WIDTH), shingles(column(part, "text_b"), WIDTH)
            owner = np.concatenate([np.repeat(np.arange(len(part)), np.diff(oa)), np.repeat(np.arange(len(part)), np.diff(ob))])
            values = np.concatenate([va, vb])
            order = np.lexsort((values, owner))
            owner, values = owner[order], values[order]
            same = owner[1:][(owner[1:] == owner[:-1]) & (values[1:] == values[:-1])]
            shared = np.bincount(same, minlength=len(part))
            link = (100 * shared >= PERCENT * (np.diff(oa) + np.diff(ob) - shared)) & (shared > 0)
            yield part.select(["a", "b"]).filter(pa.array(link))


def named(pairs: DataFrame) -> DataFrame:
    """The different ids of ``pairs(a, b)``."""
    return pairs.select("a").union(pairs.select("b")).distinct()


def confirm(pairs: DataFrame, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The links among ``pairs(a, b)`` of ids that ``docs`` has once. Only documents named in a pair are moved."""
    ids = scratch.save(named(pairs), f"{name}-ids", 2 * pairs.count())
    texts = restrict(docs.select("doc_id", "text"), ids, "doc_id")
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long")


def repeated_ids(docs: DataFrame) -> DataFrame | None:
    """Ids that more than one row has, or None."""
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id")
    return None if ids.limit(1).isEmpty() else ids


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id, kept.

    Null and empty texts and texts of white space have no shingles and are linked with nothing. Texts of equal sets form a
    class; its smallest id stands for it, so copies cost one sketch. Rows that share a doc_id count as one document, whose
    text is their smallest, and get equal rows. Rows with a null id come back with null class and component, and are kept.
    Extra columns are ignored; an empty table gives an empty result.

    Each bucket of a band compares its members with one of them, drawn anew in each band. Links so confirmed give first
    components; then every pair of a bucket that still lies in different components is examined, in blocks that emit only
    what sizes, corrected estimates and proven bounds cannot rule out. So no bucket is capped and no pair is skipped. Rows of
    a bucket's largest component are dealt to blocks of the rows outside it, not to each other. Texts of any length are
    sketched whole.
    """
    scratch = Scratch(docs.sparkSession, "near")
    given, repeated = docs, repeated_ids(docs)
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    if repeated is not None:
        same = restrict(docs, repeated, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
        docs = scratch.save(without(docs, repeated, "doc_id").unionByName(same), "docs")
    sketches = scratch.save(sketch(docs), "sketches")
    classes = scratch.save(sketches.where("n_shingles > 0").groupBy("hi", "lo", "n_shingles").agg(F.min("doc_id").alias("class_id")), "classes", sketches.count())
    heads = restrict(sketches.where("n_shingles > 0"), classes.select("class_id"), "doc_id")
    each = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.substring(F.col("regs"), b * (2 * BAND) + 1, F.lit(2 * BAND)), b)))
    # rows are dealt out by key once, for both a bucket's size and its drawn member; band and size travel as one number
    bands = heads.select("doc_id", "n_shingles", each.alias("band", "key")).select("key", "doc_id", (F.col("n_shingles") * BANDS + F.col("band")).alias("packed"))
    draw = F.struct(F.xxhash64("doc_id", "key").alias("draw"), F.col("doc_id").alias("doc_id"), F.col("packed").alias("packed"))
    bucket = Window.partitionBy("key")
    members = bands.select("*", F.count(F.lit(1)).over(bucket).alias("rows"), F.min(draw).over(bucket).alias("first")).where("rows > 1")
    size_of = lambda c: F.expr(f"{c} div {BANDS}")
    members = members.select("key", F.pmod("packed", F.lit(BANDS)).cast("int").alias("band"), "rows", "doc_id", size_of("packed").alias("n_shingles"), F.col("first.doc_id").alias("head"), size_of("first.packed").alias("head_n"))
    members = scratch.save(members, "members")

    size = 100 * F.least("n_shingles", "head_n") >= PERCENT * F.greatest("n_shingles", "head_n")
    star = members.where(size & (F.col("doc_id") != F.col("head"))).select(F.least("doc_id", "head").alias("a"), F.greatest("doc_id", "head").alias("b")).distinct()
    star = scratch.save(star, "star", members.count())
    slim = restrict(sketches, scratch.save(named(star), "star-ids", 2 * star.count()), "doc_id").select("doc_id", "n_shingles", "regs", "once", "twice")
    side = lambda c: slim.select(F.col("doc_id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n_shingles", "regs", "once", "twice")))
    hopeful = scratch.save(star.join(side("a"), "a").join(side("b"), "b").mapInArrow(_screen, "a long, b long"), "hopeful")
    links = scratch.save(confirm(hopeful, docs, scratch, "links"), "links")
    scratch.drop("star", "star-ids", "hopeful", "links-ids")
    labels = components(links, scratch, "first")

    known = labels.select(F.col("node").alias("doc_id"), "comp")
    now = members.join(known, "doc_id", "left").select("key", "band", "rows", "doc_id", F.coalesce("comp", "doc_id").alias("comp"))
    now = scratch.save(now, "now")
    # of each bucket with several components: the largest one and the number of rows outside it
    by_comp = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("own")).groupBy("key")
    mixed = by_comp.agg(F.max(F.struct("own", "comp")).alias("most"), (F.sum("own") - F.max("own")).alias("others")).where("others > 0")
    mixed = scratch.save(mixed.select("key", F.col("most.comp").alias("largest"), F.col("most.own").alias("inside"), "others"), "mixed", members.count() // 2)
    rest = now.join(F.broadcast(mixed) if mixed.count() <= BROADCAST_IDS else mixed, "key")
    rest = scratch.save(rest.withColumn("most", F.col("comp") == F.col("largest")), "rest")
    slim = restrict(sketches, scratch.save(rest.select("doc_id").distinct(), "rest-ids", rest.count()), "doc_id").select("doc_id", "n_shingles", "regs", "once", "twice")
    # rows outside the largest component meet each other and all of it, so a bucket's copies grow with those rows alone
    number = lambda rows: F.ceil(F.col(rows) / BLOCK).cast("int")
    place = lambda rows: F.pmod(F.xxhash64("doc_id", F.lit(5)), number(rows)).cast("int")
    pair = lambda i, j: F.struct(i.alias("bi"), j.alias("bj"))
    each = lambda rows, f: F.transform(F.sequence(F.lit(0), number(rows) - 1), f)
    block = F.when(F.col("most"), -1 - place("inside")).otherwise(place("others"))
    outside = F.concat(each("others", lambda o: pair(F.least("block", o), F.greatest("block", o))), each("inside", lambda i: pair(-1 - i, F.col("block"))))
    meets = F.when(F.col("most"), each("others", lambda o: pair(F.col("block"), o))).otherwise(outside)
    spread = rest.withColumn("block", block).join(slim, "doc_id").withColumn("meets", F.explode(meets))
    spread = spread.select("key", "meets.bi", "meets.bj", "block", "band", "comp", "doc_id", "n_shingles", "regs", "once", "twice")
    spread = spread.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    more = scratch.save(spread.mapInArrow(_compare, "a long, b long").distinct(), "more")
    scratch.drop("now", "rest", "rest-ids", "members", "mixed")
    extra = scratch.save(confirm(more, docs, scratch, "extra"), "extra")
    if not extra.limit(1).isEmpty():
        links = links.union(extra)
        labels = components(links, scratch, "second")

    ids = sketches.select("doc_id", "n_shingles", "hi", "lo")
    out = ids.join(classes, ["hi", "lo", "n_shingles"], "left").join(labels.select(F.col("node").alias("class_id"), "comp"), "class_id", "left")
    component = F.coalesce("comp", "class_id", "doc_id")
    out = out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
    if repeated is not None:
        out = given.select("doc_id").join(out, "doc_id")
    nameless = given.where("doc_id is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.union(nameless)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, that of its smallest id, and the rows with a null id; all columns as they were.

    Where ids repeat, each row is a document, so different texts of an id are all compared. A component's row is then that
    of the smallest id whose smallest text it has, as in ``near_duplicates``, else of the smallest id.
    """
    scratch = Scratch(docs.sparkSession, "near")
    repeated = repeated_ids(docs)
    if repeated is None:
        gone = scratch.save(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone", docs.count())
        return without(docs, gone, "doc_id")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = scratch.save(docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text", row), "keyed")
    least = restrict(keyed, repeated, "doc_id").groupBy("doc_id").agg(F.min("text").alias("least"), F.lit(True).alias("repeats"))
    found = near_duplicates(keyed.where("doc_id is not null").select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "component_id")
    other = F.col("repeats").isNotNull() & ~F.col("text").eqNullSafe(F.col("least"))
    placed = keyed.select("key", "doc_id", "text").join(found, "key").join(least, "doc_id", "left").select("key", "component_id", F.struct(other.alias("other"), "doc_id", "key").alias("place"))
    kept = scratch.save(placed.groupBy("component_id").agg(F.min("place").alias("place")).select("place.key"), "kept")
    return restrict(keyed, kept, "key").select("row").union(keyed.where("doc_id is null").select("row")).select("row.*")
