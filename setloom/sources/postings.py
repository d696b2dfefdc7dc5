"""Data source of binary posting lists: 32-bit little-endian words, a length and that many ids, again and again.

spark.dataSource.register(PostingsSource); spark.read.format("postings").load(path) -> (set_id, id). Each file is read by
one task, list by list, so memory holds one buffer and not a file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def place(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class PostingsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "postings"

    def schema(self) -> str:
        return "set_id long, id long"

    def reader(self, schema) -> DataSourceReader:
        return PostingsReader(self.options["path"])


class PostingsFile(InputPartition):
    def __init__(self, number: int, path: str):
        self.number, self.path = number, path


class PostingsReader(DataSourceReader):
    """Lists of the n-th file are numbered from n * 2**32."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        where, path = place(self.path)
        info = where.get_file_info(path)
        files = [path] if info.is_file else sorted(f.path for f in where.get_file_info(pafs.FileSelector(path)) if f.is_file)
        return [PostingsFile(i, f) for i, f in enumerate(files)]

    def read(self, partition: PostingsFile) -> Iterator[tuple[int, int]]:
        where, _ = place(self.path)
        with where.open_input_stream(partition.path) as stream:
            number = partition.number << 32
            while head := stream.read(4):
                (n,) = struct.unpack("<I", head)
                while n:
                    raw = stream.read(4 * min(n, 1 << 16))
                    if not raw:
                        raise ValueError("posting list cut short")
                    for (i,) in struct.iter_unpack("<I", raw):
                        yield number, i
                    n -= len(raw) // 4
                number += 1
