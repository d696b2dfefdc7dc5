"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: With this set, Spark drops an execution's shuffle files as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A word is a run of anything but ASCII white space. Java's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; extra columns of any name are left out.

    An exactly equal name wins over one that differs in case; of several equal names the first counts; a column that is
    not there is null.
    """
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    lower = [n.lower() for n in names]
    out = []
    for name, kind in types.items():
        at = names.index(name) if name in names else lower.index(name.lower()) if name.lower() in lower else None
        value = F.lit(None) if at is None else F.col(f"_{at}")
        out.append(value.cast(kind).alias(name))
    return plain.select(*out)


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that df does not have."""
    have = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        name = base
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, one of our own in local mode only, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='setloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: lineage is cut, a lost executor costs nothing that is written.

    The shuffle files of the write go with it, as only the written rows are read from then on.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the files of materialized frames that nothing reads any more, and lets Spark drop shuffles nobody holds."""
    for df in frames:
        delete_path(df.sparkSession, df.written_to)
    if frames:
        tidy(frames[0].sparkSession)


def tidy(spark: SparkSession) -> None:
    """Shuffle files of ended queries go once the driver has collected what refers to them; collects now."""
    spark._jvm.System.gc()


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size: file sizes where it reads files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, mb: float = 16.0, least: int = 1) -> int:
    """A number of partitions so that each holds about mb of df's input; as many as there are cores where its size is unknown."""
    size = input_bytes(df)
    return max(least, math.ceil(size / (mb * 1e6)) if size < 1 << 60 else df.sparkSession.sparkContext.defaultParallelism)


def crc(column: str | Column) -> Column:
    """Unsigned crc32 of the value as text; a null counts as an empty text."""
    return F.crc32(F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit("")))


def word_count(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
