"""Operators over many sets at once: one shuffle by id answers all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sets import ordered, tagged


def agg_or(sets: DataFrame) -> DataFrame:
    """Union of a collection (set_id, id)."""
    return sets.select("id").distinct()


def agg_and(sets: DataFrame, n_sets: int | None = None) -> DataFrame:
    """Intersection of a collection; n_sets: how many sets there are, counted if not told."""
    hits = sets.distinct().groupBy("id").agg(F.count("*").alias("n"))
    if n_sets is not None:
        return hits.filter(F.col("n") == n_sets).select("id")
    return hits.filter(F.col("n") == sets.agg(F.count_distinct("set_id")).scalar()).select("id")


def agg_and_sub(group0: list[DataFrame], group1: list[DataFrame]) -> DataFrame:
    """Members of all sets of group0 and of none of group1."""
    n = len(group0)
    hits = tagged(*group0, *group1).distinct().groupBy("id").agg(F.count(F.when(F.col("ord") < n, 1)).alias("a"), F.count(F.when(F.col("ord") >= n, 1)).alias("s"))
    return hits.filter((F.col("a") == n) & (F.col("s") == 0)).select("id")


def first_and_sub(group0: list[DataFrame], group1: list[DataFrame]) -> DataFrame:
    return agg_and_sub(group0, group1).agg(F.min("id").alias("first"))


def shift_right_and(*sets: DataFrame) -> DataFrame:
    """Ends of runs: ids e such that e - (N - 1) + k is in the k-th set for every k."""
    n = len(sets)
    starts = tagged(*sets).select((F.col("id") - F.col("ord")).alias("start"), "ord").distinct()
    return starts.groupBy("start").agg(F.count("*").alias("n")).filter(F.col("n") == n).select((F.col("start") + n - 1).alias("id"))


def pipeline(sets: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (qid, id): each query's AND-SUB over the shared sets.

    sets: (set_id, id). queries: (qid, set_id, grp), grp 0 for AND, 1 for SUB. A query with no AND set has no result.
    """
    needs = queries.filter("grp = 0").groupBy("qid").agg(F.count_distinct("set_id").alias("need"))
    hits = queries.distinct().join(sets.distinct(), "set_id").groupBy("qid", "id").agg(F.count(F.when(F.col("grp") == 0, 1)).alias("a"), F.count(F.when(F.col("grp") == 1, 1)).alias("s"))
    return hits.join(needs, "qid").filter("a = need AND s = 0").select("qid", "id")


def pipeline_counts(sets: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, cnt) for every query, 0 where nothing is found."""
    counts = pipeline(sets, queries).groupBy("qid").agg(F.count("*").alias("n"))
    return queries.select("qid").distinct().join(counts, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).cast("long").alias("cnt"))


def pipeline_or(sets: DataFrame, queries: DataFrame) -> DataFrame:
    return pipeline(sets, queries).select("id").distinct()


def with_range(sets: DataFrame, left: int, right: int) -> DataFrame:
    """The collection cut to [left, right] before any shuffle."""
    return sets.filter(F.col("id").between(*ordered(left, right)))


def limit_per_query(found: DataFrame, limit: int) -> DataFrame:
    """The first `limit` ids of each query, exactly."""
    return found.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("id"))).filter(F.col("_n") <= limit).drop("_n")
