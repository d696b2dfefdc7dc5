"""Sorting and dense numbering of values of any type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import checkpointed


def sorted_vector(v: DataFrame) -> DataFrame:
    """Values in order; a distributed sort by ranges."""
    return v.orderBy(F.col("value").asc_nulls_last(), "idx")


def ordered_index(values: DataFrame, column: str, name: str = "idx") -> DataFrame:
    """Distinct values of any type that Spark can sort, with their place in order, from 0.

    Spark cuts the values into ranges of about equal size, whatever prefix they share; the ranges' sizes give each its
    first place. The ranges are checkpointed, so that their numbers are the same wherever they are read.
    """
    ranged = values.select(F.col(column)).repartitionByRange(F.col(column)).withColumn("_p", F.spark_partition_id())
    ranged = checkpointed(ranged)
    starts = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("n")).withColumn("before", starts)  # a row for each range
    sizes = sizes.select(F.col("_p").alias("_of"), "before")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(column)) - 1
    out = ranged.join(sizes, F.col("_p") == F.col("_of"))
    return out.select((F.col("before") + place).cast("long").alias(name), F.col(column))


def cumulative_pick(counts: DataFrame, percent: float) -> DataFrame:
    """(value, cnt) most frequent first, ties by value: the target is percent of the number of values that occur more than
    once, one less for each pick, and the picks stop with the first whose count reaches what is left of the target.

    The result is at most the target long, so a top-n bounds what is ranked.
    """
    total = counts.filter("cnt > 1").agg(F.floor(F.count("*") * percent / 100).cast("long").alias("target"))
    most = total.first()["target"]
    order = Window.orderBy(F.desc("cnt"), "value")
    top = counts.filter("cnt > 1").orderBy(F.desc("cnt"), "value").limit(max(most, 1))
    ranked = top.withColumn("rn", F.row_number().over(order))
    hit = F.min(F.when(F.col("cnt") >= F.lit(most) - (F.col("rn") - 1), F.col("rn"))).over(Window.partitionBy())
    return ranked.withColumn("stop", hit).filter(F.col("rn") <= F.coalesce("stop", F.lit(most))).select("value", "cnt", F.col("rn").cast("long").alias("rn"))
