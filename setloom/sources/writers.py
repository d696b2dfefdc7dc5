"""Writers: frames as Parquet, ordered by position so that range reads skip row groups.

codec is any that Parquet has; level is zstd's, 1 to 22.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def ordered(df: DataFrame, path: str, by: list[str], mode: str, codec: str, level: int) -> None:
    rows = df.repartitionByRange(by[0]).sortWithinPartitions(*by)
    rows.write.mode(mode).option("compression", codec).option("parquet.compression.codec.zstd.level", level).parquet(path)


def write_set(a: DataFrame, path: str, mode: str = "errorifexists", codec: str = "zstd", level: int = 3) -> None:
    ordered(a.select("id"), path, ["id"], mode, codec, level)


def write_vector(v: DataFrame, path: str, mode: str = "errorifexists", codec: str = "zstd", level: int = 3) -> None:
    ordered(v, path, ["idx"], mode, codec, level)


def write_links(links: DataFrame, path: str, mode: str = "errorifexists", codec: str = "zstd", level: int = 3) -> None:
    ordered(links, path, ["src", "dst"], mode, codec, level)


def write_collection(kv: DataFrame, path: str, mode: str = "errorifexists", codec: str = "zstd", level: int = 3) -> None:
    """(key, val BINARY)."""
    ordered(kv, path, ["key"], mode, codec, level)


def write_packed(p: DataFrame, path: str, mode: str = "errorifexists", codec: str = "zstd", level: int = 3) -> None:
    ordered(p, path, ["bucket"], mode, codec, level)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, mode: str = "errorifexists") -> None:
    """A table that joins on key without a shuffle."""
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def stored_size(path: str, df: DataFrame) -> int:
    """Bytes of the files a frame is read from, by Catalyst's statistics."""
    return int(str(df.sparkSession.read.parquet(path)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
