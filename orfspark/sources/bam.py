"""BAM as a Python data source: BGZF blocks and alignment records, decoded without native libraries; and a writer of parts.

A partition is a range of a file's bytes. It owns the blocks that begin in its range and the records that begin in those
blocks. Blocks are told by their headers; where the first record of a block lies is told by records that follow one another
without a fault from there on. Gzip files without block sizes are read as one partition.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .. import schema
from .files import created, expand, opened, size_of

#: The format's magic, the letters of CIGAR operations, those that advance on the reference, the start of a block
#: and the empty block that ends a file.
MAGIC = b"BAM\x01"
CIGAR = "MIDNSHP=X"
ADVANCES = frozenset((0, 2, 3, 7, 8))
BLOCK_MAGIC = b"\x1f\x8b\x08\x04"
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_UNMAPPED = 0x4
_BATCH = 50_000
#: Bytes of a partition; records in a row that show where records begin; bytes of a block's content when writing.
SPLIT, ENOUGH, CONTENT = 32 << 20, 8, 60_000
#: A record of more bytes than this is taken for a fault.
_LARGEST = 1 << 26


@dataclass
class _Part(InputPartition):
    path: str
    begin: int
    end: int | None  # None: the whole file, as a stream
    names: list[str]


class _Blocks:
    """The content of blocks from one on, as far as asked for."""

    def __init__(self, file, at: int):
        self.file, self.next = file, at
        self.data = bytearray()
        self.starts: list[tuple[int, int]] = []  # place in the file, place in the content

    def more(self) -> bool:
        """Read one block; False at the end of the file."""
        self.file.seek(self.next)
        head = self.file.read(18)
        size = _block_size(head)
        if size is None:
            if head:
                raise ValueError(f"no block begins at byte {self.next}")
            return False
        body = self.file.read(size - 18)
        self.starts.append((self.next, len(self.data)))
        extra = struct.unpack_from("<H", head, 10)[0]
        self.data += zlib.decompress((head + body)[12 + extra : -8], -15)
        self.next += size
        return True

    def upto(self, n: int) -> bool:
        """Whether there are n bytes of content."""
        while len(self.data) < n:
            if not self.more():
                return False
        return True


def _block_size(head: bytes) -> int | None:
    """The size of the block that begins with these 18 bytes; None where none does."""
    if len(head) < 18 or head[:4] != BLOCK_MAGIC or head[12:14] != b"BC" or head[14:16] != b"\x02\x00":
        return None
    return struct.unpack_from("<H", head, 16)[0] + 1


def _first_block(file, begin: int, end: int) -> int | None:
    """Where the first block from ``begin`` on begins, if before ``end``: a header whose next block has one too."""
    file.seek(begin)
    data = file.read(end - begin + (1 << 16) + 18)
    at = data.find(BLOCK_MAGIC)
    while 0 <= at < end - begin:
        size = _block_size(data[at : at + 18])
        if size and (at + size >= len(data) or _block_size(data[at + size : at + size + 18])):
            return begin + at
        at = data.find(BLOCK_MAGIC, at + 1)
    return None


def _record_size(data: bytes | bytearray, at: int, contigs: int) -> int | None:
    """Bytes of the record that may begin at ``at``, its own size included; None where none can. Needs its first 36 bytes."""
    size, ref, pos, name, _, _, ops, _, length, other, mate = struct.unpack_from("<iiiBBHHHiii", data, at)
    if not 32 <= size <= _LARGEST or not -1 <= ref < contigs or not -1 <= other < contigs or pos < -1 or mate < -1 or not name or length < 0:
        return None
    if 32 + name + 4 * ops + (length + 1) // 2 + length > size:
        return None
    text = data[at + 36 : at + 36 + name]
    if len(text) == name and (text[-1] or any(not 33 <= c <= 126 for c in text[:-1])):
        return None
    return size + 4


def _first_record(blocks: _Blocks, contigs: int) -> int | None:
    """Where in the content the first record begins: so many follow one another from there, or as many as the file has."""

    def fits(at: int) -> bool:
        for _ in range(ENOUGH):
            if not blocks.upto(at + 36):
                return at == len(blocks.data)
            size = _record_size(blocks.data, at, contigs)
            if size is None:
                return False
            at += size
        return True

    at = 0
    while blocks.upto(at + 36):
        if _record_size(blocks.data, at, contigs) is not None and fits(at):
            return at
        at += 1
    return None


def _row(body: bytes | bytearray, names: Sequence[str]) -> tuple[str, str, int, int] | None:
    """(qname, rname, pos, end) of a record; positions are 1-based, end inclusive; None if it is unmapped."""
    ref, pos, name_size, _, _, ops, flag, _ = struct.unpack_from("<iiBBHHHi", body)
    if flag & _UNMAPPED or ref < 0:
        return None
    at = 32 + name_size
    span = sum(op >> 4 for op in struct.unpack_from(f"<{ops}I", body, at) if op & 15 in ADVANCES)
    return bytes(body[32 : at - 1]).decode(), names[ref], pos + 1, pos + max(span, 1)


def _taker(stream):
    def take(n: int) -> bytes:
        data = stream.read(n)
        if len(data) != n:
            raise EOFError("the BAM stream ends within a record")
        return data

    return take


def contigs(stream) -> list[str]:
    """The names of the references in an uncompressed BAM stream, which is then at its first record."""
    take = _taker(stream)
    if take(4) != MAGIC:
        raise ValueError("not a BAM stream")
    take(struct.unpack("<i", take(4))[0])
    names = []
    for _ in range(struct.unpack("<i", take(4))[0]):
        size = struct.unpack("<i", take(4))[0]
        names.append(take(size)[:-1].decode())
        take(4)
    return names


def records(stream) -> Iterator[tuple[str, str, int, int]]:
    """(qname, rname, pos, end) of the mapped records of an uncompressed BAM stream."""
    names, take = contigs(stream), _taker(stream)
    while head := stream.read(4):
        row = _row(take(struct.unpack("<i", head)[0]), names)
        if row:
            yield row


def records_of_range(file, begin: int, end: int, names: Sequence[str]) -> Iterator[tuple[str, str, int, int]]:
    """The mapped records that begin in the blocks which begin in [begin, end)."""
    first = _first_block(file, begin, end)
    if first is None:
        return
    blocks = _Blocks(file, first)
    if first == 0:
        at = 0
        while not blocks.upto(at + 8):
            raise EOFError("the BAM file ends within its header")
        at = 8 + struct.unpack_from("<i", blocks.data, 4)[0] + 4
        for _ in names:
            blocks.upto(at + 4)
            at += 8 + struct.unpack_from("<i", blocks.data, at)[0]
    else:
        at = _first_record(blocks, len(names))
    while at is not None and blocks.upto(at + 36):
        # the block in which the record begins
        while len(blocks.starts) > 1 and blocks.starts[1][1] <= at:
            blocks.starts.pop(0)
        if blocks.starts[0][0] >= end:
            return
        size = struct.unpack_from("<i", blocks.data, at)[0] + 4
        if not blocks.upto(at + size):
            raise EOFError("the BAM file ends within a record")
        row = _row(blocks.data[at + 4 : at + size], names)
        if row:
            yield row
        at += size
        if at > 1 << 22:
            # let go of what has been read
            drop = blocks.starts[0][1]
            del blocks.data[:drop]
            blocks.starts = [(p, c - drop) for p, c in blocks.starts]
            at -= drop


class BamReader(DataSourceReader):
    def __init__(self, paths: str, split: int):
        self.paths, self.split = paths, split

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path in expand(self.paths):
            with opened(path) as f:
                ranged = _block_size(f.read(18)) is not None
                f.seek(0)
                with gzip.open(f) as stream:
                    names = contigs(stream)
            size = size_of(path)
            out += [_Part(path, at, min(at + self.split, size), names) for at in range(0, size, self.split)] if ranged else [_Part(path, 0, None, names)]
        return out

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        names = schema.READS.fieldNames()
        columns: tuple[list, ...] = ([], [], [], [])
        types = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        with opened(partition.path) as raw:
            found = records(gzip.open(raw)) if partition.end is None else records_of_range(raw, partition.begin, partition.end, partition.names)
            for r in found:
                for c, v in zip(columns, r, strict=True):
                    c.append(v)
                if len(columns[0]) == _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
                    columns = ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


class BamSource(DataSource):
    """``spark.read.format("bam").option("split", bytes).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> StructType:
        return schema.READS

    def reader(self, schema: StructType) -> DataSourceReader:
        return BamReader(self.options["path"], int(self.options.get("split", SPLIT)))


def read_bam(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """reads(qname, rname, pos, end) of one BAM file, several (comma-separated) or a glob; partitions of about ``split`` bytes."""
    from ..session import ship

    ship(spark)
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("split", split).load(path)


def write_bam(path: str, references: Sequence[tuple[str, int]], rows: Iterable[tuple[str, str, int, int]]) -> None:
    """A BAM file from (qname, rname, pos, end), each one match."""
    number = {n: i for i, (n, _) in enumerate(references)}
    with created(path) as f:
        held = bytearray(MAGIC + struct.pack("<ii", 0, len(references)))

        def flush(least: int) -> None:
            while len(held) >= least and held:
                part = bytes(held[:CONTENT])
                del held[:CONTENT]
                deflate = zlib.compressobj(wbits=-15)
                body = deflate.compress(part) + deflate.flush()
                f.write(BLOCK_MAGIC + b"\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))

        for n, size in references:
            held += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
        for qname, rname, pos, end in rows:
            name = qname.encode() + b"\0"
            body = struct.pack("<iiBBHHHiiii", number[rname], pos - 1, len(name), 60, 0, 1, 0, 0, -1, -1, 0) + name + struct.pack("<I", (end - pos + 1) << 4)
            held += struct.pack("<i", len(body)) + body
            flush(CONTENT)
        flush(1)
        f.write(END)


def write_bam_parts(reads: DataFrame, references: Sequence[tuple[str, int]], folder: str) -> str:
    """``reads(qname, rname, pos, end)`` as one BAM file per partition under a folder that all executors see; a glob of them.

    A task that is run again writes its file again.
    """
    from pyspark import TaskContext

    from ..session import ship

    ship(reads.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.bam"
        write_bam(path, references, (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    reads.select("qname", "rname", "pos", "end").mapInArrow(write, "path string").collect()  # one path a partition
    return f"{folder}/part-*.bam"
