"""Predicates on vector frames (idx, value): each gives the set frame of the matching indexes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

V = F.col


def where(v: DataFrame, condition: Column) -> DataFrame:
    return v.filter(condition).select(F.col("idx").alias("id"))


def find_eq(v: DataFrame, x) -> DataFrame:
    return where(v, F.col("value") == F.lit(x))


def find_first(v: DataFrame, x) -> DataFrame:
    """One row: the first index with the value, NULL if none."""
    return find_eq(v, x).agg(F.min("id").alias("first"))


def find_in(v: DataFrame, values: Sequence) -> DataFrame:
    return where(v, F.col("value").isin(list(values)))


def find_in_frame(v: DataFrame, keys: DataFrame) -> DataFrame:
    """Values given as a frame (value) of any size."""
    return v.join(keys.select("value").distinct(), "value", "left_semi").select(F.col("idx").alias("id"))


def find_gt(v: DataFrame, x) -> DataFrame:
    return where(v, F.col("value") > x)


def find_ge(v: DataFrame, x) -> DataFrame:
    return where(v, F.col("value") >= x)


def find_lt(v: DataFrame, x) -> DataFrame:
    return where(v, F.col("value") < x)


def find_le(v: DataFrame, x) -> DataFrame:
    return where(v, F.col("value") <= x)


def find_range(v: DataFrame, a, b) -> DataFrame:
    """Closed range; reversed bounds are swapped."""
    return where(v, F.col("value").between(min(a, b), max(a, b)))


def find_range_open(v: DataFrame, a, b) -> DataFrame:
    return where(v, (F.col("value") > min(a, b)) & (F.col("value") < max(a, b)))


def find_zero(v: DataFrame, null_correct: bool = True) -> DataFrame:
    """Without the correction an unassigned element reads as 0."""
    return where(v, (F.col("value") if null_correct else F.coalesce("value", F.lit(0))) == 0)


def find_nonzero(v: DataFrame) -> DataFrame:
    return where(v, F.col("value") != 0)


def find_nonnegative(v: DataFrame) -> DataFrame:
    """Unassigned elements are in: they read as 0."""
    return where(v, F.col("value").isNull() | (F.col("value") >= 0))


def invert_result(v: DataFrame, found: DataFrame) -> DataFrame:
    """Assigned elements that are not found."""
    return where(v, F.col("value").isNotNull()).join(found, "id", "left_anti")


def masked(v: DataFrame, mask: DataFrame) -> DataFrame:
    """The vector under a mask set: searches on it see the mask's indexes alone."""
    return v.join(mask.select(F.col("id").alias("idx")), "idx", "left_semi")


def find_prefix(v: DataFrame, prefix: str) -> DataFrame:
    return where(v, F.col("value").startswith(prefix))


def bulk(v: DataFrame, keys: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """(value, id) for each key of a frame (value): all searches in one join. The empty text is not searched for."""
    seen = v if mask is None else masked(v, mask)
    wanted = keys.select("value").filter("value <> ''").distinct()
    return seen.join(wanted, "value").select("value", F.col("idx").alias("id"))


def bulk_counts(v: DataFrame, keys: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    found = bulk(v, keys, mask).groupBy("value").agg(F.count("*").alias("n"))
    return keys.select("value").distinct().join(found, "value", "left").select("value", F.coalesce("n", F.lit(0)).cast("long").alias("cnt"))


def bulk_or(v: DataFrame, keys: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    return bulk(v, keys, mask).select("id").distinct()


def bulk_limit(v: DataFrame, keys: DataFrame, limit: int, mask: DataFrame | None = None) -> DataFrame:
    """The first `limit` indexes of each key, exactly."""
    ranks = Window.partitionBy("value").orderBy("id")
    return bulk(v, keys, mask).withColumn("_n", F.row_number().over(ranks)).filter(F.col("_n") <= limit).select("value", "id")


def binary_find(v: DataFrame, x) -> DataFrame:
    """In a sorted vector: found, and the index of the value or else where it would go in."""
    hit = F.min(F.when(F.col("value") == x, F.col("idx")))
    below = F.count(F.when(F.col("value") < x, 1))
    return v.agg(hit.alias("hit"), below.alias("below")).select(F.col("hit").isNotNull().alias("found"), F.coalesce("hit", "below").cast("long").alias("pos"))


def lower_bound(v: DataFrame, x) -> DataFrame:
    """In a sorted vector: the first index whose value is not below x, the size if none; exact tells if it is x."""
    at = F.min(F.when(F.col("value") >= x, F.col("idx")))
    return v.agg(at.alias("at"), F.max("idx").alias("top"), F.count(F.when(F.col("value") == x, 1)).alias("n")).select(F.coalesce("at", F.col("top") + 1, F.lit(0)).cast("long").alias("pos"), (F.col("n") > 0).alias("exact"))
