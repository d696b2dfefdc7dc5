"""Constructors and checks of the frames all operators take and give.

A set frame has distinct non-null ids from 0 below 2**48 - 1; a vector frame has one row for each index, NULL for an
unassigned element; a collection has rows (set_id, id).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAST_ID = (1 << 48) - 2


def set_of(spark: SparkSession, ids: Iterable[int]) -> DataFrame:
    """Set frame of a list; repeats collapse."""
    return spark.createDataFrame([(int(i),) for i in ids], "id long").distinct()


def as_set(df: DataFrame, column: str | Column = "id") -> DataFrame:
    """Set frame of a column; NULL is no member."""
    c = F.col(column) if isinstance(column, str) else column
    return df.select(c.cast("long").alias("id")).filter("id IS NOT NULL").distinct()


def checked(ids: DataFrame) -> DataFrame:
    """The same set; a row outside the address space ends the query."""
    bad = (F.col("id") < 0) | (F.col("id") > LAST_ID) | F.col("id").isNull()
    return ids.select(F.when(bad, F.raise_error(F.lit("id outside the address space"))).otherwise(F.col("id")).alias("id"))


def full_set(spark: SparkSession, size: int) -> DataFrame:
    return spark.range(size).select("id")


def empty_set(spark: SparkSession) -> DataFrame:
    return spark.range(0).select("id")


def collection(df: DataFrame, key: str | Column, member: str | Column) -> DataFrame:
    """Posting lists: rows (set_id, id) of key and member."""
    k, m = (F.col(x) if isinstance(x, str) else x for x in (key, member))
    return df.select(k.alias("set_id"), m.cast("long").alias("id")).filter("set_id IS NOT NULL AND id IS NOT NULL").distinct()


def vector(df: DataFrame, idx: str | Column, value: str | Column) -> DataFrame:
    i, v = (F.col(x) if isinstance(x, str) else x for x in (idx, value))
    return df.select(i.cast("long").alias("idx"), v.alias("value"))


def vector_of(spark: SparkSession, values: list, kind: str = "long", offset: int = 0) -> DataFrame:
    """Vector frame of a list from an offset on; None is unassigned."""
    return spark.createDataFrame([(offset + i, v) for i, v in enumerate(values)], f"idx long, value {kind}")


def edges(df: DataFrame, src: str, dst: str) -> DataFrame:
    return df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).filter("src IS NOT NULL AND dst IS NOT NULL")


def size_of(v: DataFrame) -> DataFrame:
    """One row: size, one past the last index."""
    return v.agg((F.coalesce(F.max("idx"), F.lit(-1)) + 1).alias("size"))


def extend(v: DataFrame, more: DataFrame) -> DataFrame:
    """Elements of `more` (pos, value; pos from 0) behind the last of v."""
    return v.unionByName(more.select((size_of(v).scalar() + F.col("pos")).alias("idx"), "value"))


def push_back(v: DataFrame, *values) -> DataFrame:
    kind = v.schema["value"].dataType.simpleString()
    return extend(v, v.sparkSession.createDataFrame([(i, x) for i, x in enumerate(values)], f"pos long, value {kind}"))


def push_back_null(v: DataFrame, count: int) -> DataFrame:
    kind = v.schema["value"].dataType.simpleString()
    return extend(v, v.sparkSession.range(count).select(F.col("id").alias("pos"), F.lit(None).cast(kind).alias("value")))


def push_ascending(v: DataFrame, more: DataFrame) -> DataFrame:
    """Rows (idx, value) behind v's last index; an index that does not ascend ends the query."""
    idx = F.when(F.col("idx") < size_of(v).scalar(), F.raise_error(F.lit("index does not ascend"))).otherwise(F.col("idx"))
    return v.unionByName(more.select(idx.cast("long").alias("idx"), "value"))
