"""First, last, next and sampled members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rank import BLOCK, block_of


def find_first(a: DataFrame, start: int = 0) -> DataFrame:
    return a.filter(F.col("id") >= start).agg(F.min("id").alias("first"))


def find_last(a: DataFrame, upto: int | None = None) -> DataFrame:
    return (a if upto is None else a.filter(F.col("id") <= upto)).agg(F.max("id").alias("last"))


def dynamic_range(a: DataFrame) -> DataFrame:
    return a.agg(F.min("id").alias("first"), F.max("id").alias("last"))


def get_first(a: DataFrame) -> DataFrame:
    """0 stands for no member."""
    return a.agg(F.coalesce(F.min("id"), F.lit(0)).cast("long").alias("first"))


def with_next(a: DataFrame) -> DataFrame:
    """(id, next): the member after each, NULL after the last. Windows hold a block of ids each."""
    blocks = a.groupBy(block_of().alias("block")).agg(F.min("id").alias("head")).withColumn("_s", F.expr(f"block div {BLOCK}L"))
    supers = blocks.groupBy("_s").agg(F.min("head").alias("low")).withColumn("above", F.min("low").over(Window.orderBy("_s").rowsBetween(1, Window.unboundedFollowing)))
    later = Window.partitionBy("_s").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    heads = blocks.withColumn("near", F.min("head").over(later)).join(supers.select("_s", "above"), "_s").select(F.col("block").alias("_k"), F.coalesce("near", "above").alias("after"))
    inside = a.withColumn("_b", block_of()).withColumn("n", F.lead("id").over(Window.partitionBy("_b").orderBy("id")))
    return inside.join(heads, F.col("_b") == F.col("_k")).select("id", F.coalesce("n", "after").alias("next"))


def get_next(a: DataFrame, zero_for_none: bool = True) -> DataFrame:
    out = with_next(a)
    return out.select("id", F.coalesce("next", F.lit(0)).cast("long").alias("next")) if zero_for_none else out


def extract_next(a: DataFrame) -> DataFrame:
    """The set without its first member."""
    return a.join(a.agg(F.min("id").alias("id")), "id", "left_anti")


def go_to(a: DataFrame, pos: int) -> DataFrame:
    return a.filter(F.col("id") >= pos).orderBy("id")


def visit(a: DataFrame, function, schema: str, left: int | None = None, right: int | None = None) -> DataFrame:
    """A function over batches of members, of those in [left, right] if told: the surface for user code."""
    if left is not None and right is not None:
        a = a.filter(F.col("id").between(min(left, right), max(left, right)))
    return a.mapInPandas(function, schema)


def sample(a: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """Exactly n members, all if there are no more; the same for the same seed. A top-n, so no full sort."""
    return a.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)
