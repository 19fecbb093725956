"""Arrow batch helpers for ``mapInArrow`` functions."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one vectorised step takes; a longer text is a step of its own.
STEP_BYTES = 600_000


#: Fixed values of glibc's mallopt: the options for the sizes from which memory is mapped by itself and kept at the heap's end.
_MMAP_THRESHOLD, _TRIM_THRESHOLD = -3, -1
_MAPPED = 16 << 20


@cache
def _lean() -> Callable[[], object]:
    """Have this worker's arrays come from one heap, very large ones mapped by themselves; the call that gives back what is free."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        c = ctypes.CDLL(None)
        c.mallopt(_MMAP_THRESHOLD, _MAPPED)
        c.mallopt(_TRIM_THRESHOLD, 2 * _MAPPED)
        trim = c.malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda: None
    return lambda: trim(0)


def steps(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each one's ``text`` column holds about ``limit`` bytes; at least one row each, in order."""
    release = _lean()
    try:
        yield from _steps(batches, text, limit)
    finally:
        release()


def _steps(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
        if not len(column):
            continue
        lengths = pc.binary_length(column).to_numpy(zero_copy_only=False)
        begin, total = 0, 0
        for i, size in enumerate(lengths):
            if total and total + size > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += int(size)
        yield batch.slice(begin)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
