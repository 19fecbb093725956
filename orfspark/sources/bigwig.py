"""BigWig as a Python data source and a writer: header, contig tree, R-tree index and compressed sections.

A partition is a run of data blocks, so a large file spreads over executors. Equality and ``in`` filters on ``chr`` and
ranges on ``start`` and ``stop`` reach the index: blocks that cannot match are not read.
"""

from __future__ import annotations

import os
import struct
import tempfile
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schema
from .files import expand, local, opened

#: Magic numbers of the format.
MAGIC, CONTIG_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
_BLOCKS = 256
_ITEMS = 1024
_FANOUT = 256
#: Zoom levels at most, and how much wider each one's bins are than those of the one before.
_ZOOMS, _WIDER = 10, 4


@dataclass
class _Part(ds.InputPartition):
    path: str
    blocks: list[tuple[int, int]]
    compressed: bool
    names: dict[int, str]


class _Index:
    """The header of a file, its contigs, and a walk over its data blocks."""

    def __init__(self, path: str):
        self.path = path
        with opened(path) as f:
            head = f.read(64)
            if len(head) < 64 or struct.unpack_from("<I", head)[0] != MAGIC:
                raise ValueError(f"{path} is not a little-endian BigWig file")
            _, _, zooms, contigs, _, self.index, _, _, _, _, buffer, _ = struct.unpack("<IHHQQQHHQQIQ", head)
            self.compressed = buffer > 0
            #: (width, place of the records, place of the index) of each zoom level
            self.zooms = [(width, at, index) for width, _, at, index in struct.iter_unpack("<IIQQ", f.read(24 * zooms))]
            self.contigs = dict(self._contigs(f, contigs))

    def _contigs(self, f, at: int) -> Iterator[tuple[int, tuple[str, int]]]:
        f.seek(at)
        magic, _, key, _, _, _ = struct.unpack("<IIIIQQ", f.read(32))
        if magic != CONTIG_MAGIC:
            raise ValueError(f"{self.path} has no contig tree")
        todo = [at + 32]
        while todo:
            f.seek(todo.pop())
            leaf, _, n = struct.unpack("<BBH", f.read(4))
            for _ in range(n):
                name = f.read(key).rstrip(b"\0").decode()
                if leaf:
                    number, size = struct.unpack("<II", f.read(8))
                    yield number, (name, size)
                else:
                    todo.append(struct.unpack("<Q", f.read(8))[0])

    def blocks(self, wanted: set[int] | None, low: int | None, high: int | None, index: int | None = None) -> Iterator[tuple[int, int]]:
        """(place, size) of the blocks that may hold intervals of ``wanted`` contigs with stop > low and start < high, by the index
        of the whole data or that at ``index``."""
        index = self.index if index is None else index
        with opened(self.path) as f:
            f.seek(index)
            if struct.unpack("<I", f.read(4))[0] != INDEX_MAGIC:
                raise ValueError(f"{self.path} has no index")
            todo = [index + 48]
            while todo:
                f.seek(todo.pop())
                leaf, _, n = struct.unpack("<BBH", f.read(4))
                size = 32 if leaf else 24
                data = f.read(size * n)
                for i in range(n):
                    first, start, last, stop, at = struct.unpack_from("<IIIIQ", data, i * size)
                    if wanted is not None and not any(first <= w <= last for w in wanted):
                        continue
                    if first == last and (low is not None and stop <= low or high is not None and start >= high):
                        continue
                    if leaf:
                        yield at, struct.unpack_from("<Q", data, i * size + 24)[0]
                    else:
                        todo.append(at)


def _section(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    contig, start, _, step, span, kind, _, n = struct.unpack_from("<IIIIIBBH", data)
    if kind == 1:
        items = np.frombuffer(data, "<u4", 3 * n, 24).reshape(n, 3)
        return contig, items[:, 0].astype(np.int64), items[:, 1].astype(np.int64), items[:, 2].copy().view("<f4").astype(np.float64)
    if kind == 2:
        items = np.frombuffer(data, "<u4", 2 * n, 24).reshape(n, 2)
        first = items[:, 0].astype(np.int64)
        return contig, first, first + span, items[:, 1].copy().view("<f4").astype(np.float64)
    first = start + step * np.arange(n, dtype=np.int64)
    return contig, first, first + span, np.frombuffer(data, "<f4", n, 24).astype(np.float64)


@dataclass
class _Pushed:
    names: set[str] | None = None
    low: int | None = None  # stop > low
    high: int | None = None  # start < high


class BigWigReader(ds.DataSourceReader):
    def __init__(self, paths: str):
        self.paths = paths
        self.pushed = _Pushed()

    def pushFilters(self, filters: list) -> Iterable:
        """Take what narrows the index; all filters stay with Spark, which applies them to single intervals."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            if column == "chr" and isinstance(f, (ds.EqualTo, ds.In)):
                own = {f.value} if isinstance(f, ds.EqualTo) else set(f.value)
                self.pushed.names = own if self.pushed.names is None else self.pushed.names & own
            elif column == "start" and isinstance(f, (ds.LessThan, ds.LessThanOrEqual)):
                high = f.value + isinstance(f, ds.LessThanOrEqual)
                self.pushed.high = high if self.pushed.high is None else min(self.pushed.high, high)
            elif column == "stop" and isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual)):
                low = f.value - isinstance(f, ds.GreaterThanOrEqual)
                self.pushed.low = low if self.pushed.low is None else max(self.pushed.low, low)
            yield f

    def partitions(self) -> Sequence[ds.InputPartition]:
        out = []
        for path in expand(self.paths):
            index = _Index(path)
            names = {i: n for i, (n, _) in index.contigs.items()}
            wanted = None if self.pushed.names is None else {i for i, n in names.items() if n in self.pushed.names}
            found = sorted(index.blocks(wanted, self.pushed.low, self.pushed.high))
            out += [_Part(path, found[i : i + _BLOCKS], index.compressed, names) for i in range(0, len(found), _BLOCKS)]
        return out or [_Part("", [], False, {})]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.blocks:
            return
        with opened(partition.path) as f:
            for at, size in partition.blocks:
                f.seek(at)
                data = f.read(size)
                contig, start, stop, value = _section(zlib.decompress(data) if partition.compressed else data)
                yield pa.RecordBatch.from_arrays([pa.array([partition.names[contig]] * len(start), pa.string()), pa.array(start), pa.array(stop), pa.array(value)], schema.COVERAGE.fieldNames())


class BigWigSource(ds.DataSource):
    """``spark.read.format("bigwig").load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> StructType:
        return schema.COVERAGE

    def reader(self, schema: StructType) -> ds.DataSourceReader:
        return BigWigReader(self.options["path"])


def is_bigwig(path: str) -> bool:
    with opened(path) as f:
        head = f.read(4)
    return len(head) == 4 and struct.unpack("<I", head)[0] == MAGIC


def read_bigwig(spark: SparkSession, path: str) -> DataFrame:
    """coverage(chr, start, stop, value) of a BigWig file; others are an error."""
    from ..session import ship

    for p in expand(path):
        if not is_bigwig(p):
            raise ValueError(f"{p} is not a BigWig file")
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BigWigSource)
    return spark.read.format("bigwig").load(path)


#: A section as executors make it: place in the order, contig, bounds, compressed items, and what the file's summary needs of it.
_SECTION = "chr string, start long, stop long, packed binary, size int, covered long, low double, high double, total double, squares double"


def _intervals(part: pa.Table) -> tuple:
    """A section of rows (chr, start, stop, value) of one contig."""
    start, stop = (part.column(i).to_numpy().astype(np.int64) for i in (1, 2))
    value = part.column(3).to_numpy().astype("<f4")
    triples = np.empty((len(part), 3), "<u4")
    triples[:, 0], triples[:, 1], triples[:, 2] = start, stop, value.view("<u4")
    span, exact = stop - start, part.column(3).to_numpy().astype(np.float64)
    return part.column(0)[0].as_py(), int(start[0]), int(stop.max()), triples.tobytes(), len(part), int(span.sum()), float(exact.min()), float(exact.max()), float((exact * span).sum()), float((exact**2 * span).sum())


def _summaries(part: pa.Table) -> tuple:
    """A section of a zoom level: rows (chr, start, stop, covered, low, high, total, squares) of one contig."""
    records = np.zeros((len(part), 8), "<u4")
    for i in (1, 2, 3):
        records[:, i] = part.column(i).to_numpy()
    for i in (4, 5, 6, 7):
        records[:, i] = part.column(i).to_numpy().astype("<f4").view("<u4")
    return part.column(0)[0].as_py(), int(records[0, 1]), int(records[:, 2].max()), records.tobytes(), len(part), 0, 0.0, 0.0, 0.0, 0.0


def _sections(batches: Iterator[pa.RecordBatch], items: int, packed: Callable[[pa.Table], tuple]) -> Iterator[pa.RecordBatch]:
    """Rows in order of contig and start, cut into sections of one contig and at most ``items`` rows each; the contig's number
    is filled in later."""
    held: pa.Table | None = None

    def cut(table: pa.Table, last: bool) -> tuple[list[tuple], pa.Table]:
        names = table.column(0).combine_chunks()
        coded = pc.run_end_encode(names) if len(names) else None
        ends = coded.run_ends.to_pylist() if coded is not None else []
        out, begin = [], 0
        for k, end in enumerate(ends):
            while end - begin >= items or (end > begin and (last or k < len(ends) - 1)):
                out.append(packed(table.slice(begin, min(items, end - begin)).combine_chunks()))
                begin = min(begin + items, end)
        return out, table.slice(begin)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), *[pa.float64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in _SECTION.split(", ")])

    for given in batches:
        table = pa.Table.from_batches([given])
        held = pa.concat_tables([held, table]) if held is not None and len(held) else table
        rows, held = cut(held, False)
        if rows:
            yield batch(rows)
    if held is not None:
        rows, _ = cut(held, True)
        if rows:
            yield batch(rows)


def _tree(blocks: list[tuple[int, int, int, int, int]], at: int) -> bytes:
    """R-tree nodes from the root at ``at`` on; every level but the last points to the next."""
    levels = [[(c, s, c, e) for c, s, e, _, _ in blocks]]
    while len(levels[0]) > _FANOUT:
        below = levels[0]
        levels.insert(0, [(g[0][0], g[0][1], *max((x[2], x[3]) for x in g)) for g in (below[i : i + _FANOUT] for i in range(0, len(below), _FANOUT))])
    place, starts = at, []
    for depth, level in enumerate(levels):
        starts.append(place)
        leaf = depth == len(levels) - 1
        nodes = -(-len(level) // _FANOUT) or 1
        place += nodes * 4 + len(level) * (32 if leaf else 24)
    out = []
    for depth, level in enumerate(levels):
        leaf = depth == len(levels) - 1
        for i in range(0, max(len(level), 1), _FANOUT):
            node = level[i : i + _FANOUT]
            out.append(struct.pack("<BBH", leaf, 0, len(node)))
            for k, box in enumerate(node, i):
                if leaf:
                    out.append(struct.pack("<IIIIQQ", *box, blocks[k][3], blocks[k][4]))
                else:
                    # child k of the next level: all nodes before it are full
                    under = 32 if depth + 1 == len(levels) - 1 else 24
                    out.append(struct.pack("<IIIIQ", *box, starts[depth + 1] + k * (4 + _FANOUT * under)))
    return b"".join(out)


def _index(blocks: list[tuple[int, int, int, int, int]], at: int) -> bytes:
    """The index at ``at`` of blocks (contig, start, stop, place, size)."""
    first, last = (blocks[0], blocks[-1]) if blocks else ((0, 0, 0, at, 0),) * 2
    head = struct.pack("<IIQIIIIQII", INDEX_MAGIC, _FANOUT, len(blocks), first[0], first[1], last[0], last[2], at, _ITEMS, 0)
    return head + _tree(blocks, at + len(head))


def _summed(parts: DataFrame) -> DataFrame:
    """One summary of each bin's parts."""
    ways = {"start": F.min, "stop": F.max, "covered": F.sum, "low": F.min, "high": F.max, "total": F.sum, "squares": F.sum}
    return parts.groupBy("chr", "bin").agg(*(f(c).alias(c) for c, f in ways.items()))


def _binned(rows: DataFrame, width: int) -> DataFrame:
    """Summaries of rows (chr, start, stop, value) by bins of ``width`` bases; a row over several bins counts in each with its part."""
    first, last = (F.floor(x / F.lit(width)) for x in (F.col("start"), F.col("stop") - 1))
    cut = rows.where("stop > start").select("*", F.explode(F.sequence(first, last)).alias("bin"))
    cut = cut.select("chr", "bin", "value", F.greatest("start", F.col("bin") * width).alias("start"), F.least("stop", (F.col("bin") + 1) * width).alias("stop"))
    span, value = F.col("stop") - F.col("start"), F.col("value")
    parts = cut.select("chr", "bin", "start", "stop", span.alias("covered"), value.alias("low"), value.alias("high"), (value * span).alias("total"), (value * value * span).alias("squares"))
    return _summed(parts)


def _wider(level: DataFrame) -> DataFrame:
    """A level's summaries by bins ``_WIDER`` times as wide."""
    return _summed(level.withColumn("bin", F.floor(F.col("bin") / _WIDER)))


def write_bigwig(coverage: DataFrame, sizes: DataFrame | dict[str, int], path: str) -> str:
    """Write coverage(chr, start, stop, value) as one BigWig file and return its path.

    Executors sort the rows and cut them into sections; these come to the driver in order, a partition at a time, and only
    their index entries are kept. Contigs that ``sizes`` lacks are an error, and so are positions before a contig's start or
    beyond its size, which the format cannot hold. Zoom levels are summed by executors, each from the one before: bins begin
    at ten mean spans and widen fourfold until a level fits one section; a level with over half of the records before it is
    left out. A file in a store is written here first, as its head is known last, and then copied.
    """
    from ..session import ship, written

    spark = coverage.sparkSession
    ship(spark)
    known = sizes if isinstance(sizes, dict) else {r.chr: r.size for r in sizes.collect()}
    names = sorted(known)
    number = {n: i for i, n in enumerate(names)}
    chrom, start, stop, value = (F.col(f"`{c}`") for c in coverage.columns[:4])
    rows = written(coverage.select(chrom.alias("chr"), start.cast("long").alias("start"), stop.cast("long").alias("stop"), value.cast("double").alias("value")), "coverage")
    target, path = path, local(path)
    remote = "://" in path
    if remote:
        handle, path = tempfile.mkstemp(suffix=".bw")
        os.close(handle)
    covered, low, high, total, squares, largest = 0, float("inf"), float("-inf"), 0.0, 0.0, 0
    zooms: list[tuple[int, int, int]] = []  # width, place of the records, place of the index

    def sections(df: DataFrame, packed: Callable[[pa.Table], tuple]) -> Iterator:
        return df.orderBy("chr", "start").mapInArrow(lambda b, items=_ITEMS: _sections(b, items, packed), _SECTION).toLocalIterator()

    with open(path, "wb") as f:

        def put(blocks: list[tuple[int, int, int, int, int]], s, data: bytes) -> None:
            nonlocal largest
            out = zlib.compress(data)
            blocks.append((number[s.chr], s.start, s.stop, f.tell(), len(out)))
            f.write(out)
            largest = max(largest, len(data))

        f.write(b"\0" * (64 + 24 * _ZOOMS))
        summary = f.tell()
        f.write(b"\0" * 40)
        contigs = f.tell()
        key = max([1, *(len(n.encode()) for n in names)])
        f.write(struct.pack("<IIIIQQ", CONTIG_MAGIC, max(1, len(names)), key, 8, len(names), 0) + struct.pack("<BBH", 1, 0, len(names)))
        for i, n in enumerate(names):
            f.write(n.encode().ljust(key, b"\0") + struct.pack("<II", i, known[n]))
        full = f.tell()
        f.write(b"\0" * 8)
        blocks: list[tuple[int, int, int, int, int]] = []
        records = 0
        for s in sections(rows, _intervals):
            if s.chr not in number:
                raise ValueError(f"no size is given for {s.chr}")
            if s.start < 0 or s.stop > known[s.chr]:
                raise ValueError(f"{s.chr}:{s.start}-{s.stop} is not within the contig's {known[s.chr]} bases")
            put(blocks, s, struct.pack("<IIIIIBBH", number[s.chr], s.start, s.stop, 0, 0, 1, 0, s.size) + bytes(s.packed))
            records, covered, total, squares = records + s.size, covered + s.covered, total + s.total, squares + s.squares
            low, high = min(low, s.low), max(high, s.high)
        index, count = f.tell(), len(blocks)
        f.write(_index(blocks, index))

        width, level = 10 * max(1, -(-covered // max(records, 1))), None
        while records > _ITEMS and covered and len(zooms) < _ZOOMS and width < 1 << 32:
            level = written(_binned(rows, width) if level is None else _wider(level), "zoom")
            n = level.count()
            if 2 * n <= records:
                place, blocks, records = f.tell(), [], n
                f.write(struct.pack("<I", n))
                for s in sections(level.drop("bin"), _summaries):
                    data = np.frombuffer(bytes(s.packed), "<u4").reshape(s.size, 8).copy()
                    data[:, 0] = number[s.chr]
                    put(blocks, s, data.tobytes())
                zooms.append((width, place, f.tell()))
                f.write(_index(blocks, f.tell()))
            width *= _WIDER
        f.write(struct.pack("<I", MAGIC))
        f.seek(full)
        f.write(struct.pack("<Q", count))
        f.seek(summary)
        f.write(struct.pack("<Qdddd", covered, low if count else 0, high if count else 0, total, squares))
        f.seek(0)
        f.write(struct.pack("<IHHQQQHHQQIQ", MAGIC, 4, len(zooms), contigs, full, index, 0, 0, 0, summary, max(largest, 1), 0))
        for width, place, at in zooms:
            f.write(struct.pack("<IIQQ", width, 0, place, at))
    if remote:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        place(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(True, True, place(f"file://{path}"), place(target))
    return target
