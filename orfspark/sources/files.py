"""Files of the binary formats: local ones, or in a store that Arrow knows by its URI (hdfs, s3, gs). And Spark's parts as one file."""

from __future__ import annotations

import fnmatch
import glob
from typing import BinaryIO

from pyspark.sql import SparkSession


def _remote(path: str) -> bool:
    return "://" in path


def local(path: str) -> str:
    """A local path without ``file:`` and the slashes after it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return path


def _listed(pattern: str) -> list[str]:
    from pyarrow import fs

    folder, _, name = pattern.rpartition("/")
    store, base = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(base))
    return sorted(f"{folder}/{f.base_name}" for f in found if f.is_file and fnmatch.fnmatch(f.base_name, name))


def expand(paths: str) -> list[str]:
    """Files named by comma-separated paths or globs, in order. In a store a glob may stand in the last part of a path."""
    found = []
    for p in map(local, map(str.strip, paths.split(","))):
        pattern = any(c in p for c in "*?[")
        found += [p] if not pattern else _listed(p) if _remote(p) else sorted(glob.glob(p))
    if not found:
        raise FileNotFoundError(paths)
    return found


def opened(path: str) -> BinaryIO:
    """A file to read, with ``seek``."""
    path = local(path)
    if not _remote(path):
        return open(path, "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def created(path: str) -> BinaryIO:
    """A new file, written from its start to its end."""
    path = local(path)
    if not _remote(path):
        return open(path, "wb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_output_stream(name)


def size_of(path: str) -> int:
    with opened(path) as f:
        return f.seek(0, 2) if not _remote(path) else f.size()


def as_one_file(spark: SparkSession, folder: str, path: str, head: str = "") -> None:
    """``head`` and then the parts that Spark wrote under ``folder``, in order, as the one file ``path``; the folder goes.

    Bytes are copied from stream to stream in the store's own client, a buffer at a time; nothing is parsed.
    """
    context = spark.sparkContext
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path
    source, target = place(folder), place(path)
    store, onto = source.getFileSystem(conf), target.getFileSystem(conf)
    parts = sorted(str(s.getPath()) for s in store.listStatus(source) if s.getPath().getName().startswith("part-"))
    onto.delete(target, True)
    out = onto.create(target)
    try:
        out.write(bytearray(head.encode()))
        for part in parts:
            data = store.open(place(part))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, out, 1 << 16, False)
            finally:
                data.close()
    finally:
        out.close()
    store.delete(source, True)
