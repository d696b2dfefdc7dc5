"""Counts, distances and similarities of sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sets import ordered, tagged


def count(a: DataFrame) -> DataFrame:
    return a.agg(F.count("*").alias("cnt"))


def count_range(a: DataFrame, left: int, right: int) -> DataFrame:
    return count(a.filter(F.col("id").between(*ordered(left, right))))


def any_member(a: DataFrame) -> DataFrame:
    return a.limit(1).agg((F.count("*") > 0).alias("any"))


def any_range(a: DataFrame, left: int, right: int) -> DataFrame:
    return any_member(a.filter(F.col("id").between(*ordered(left, right))))


def all_one_range(a: DataFrame, left: int, right: int) -> DataFrame:
    """One row: does a hold all of [left, right]?"""
    left, right = ordered(left, right)
    return count_range(a, left, right).select((F.col("cnt") == right - left + 1).alias("all"))


def distances(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of all counts of a pair: cnt_and, cnt_or, cnt_xor, sub_ab, sub_ba, cnt_a, cnt_b; one aggregation by id."""
    rows = tagged(a, b).groupBy("id").agg(F.max(F.when(F.col("ord") == 0, 1).otherwise(0)).alias("a"), F.max("ord").alias("b"))
    n = lambda c: F.count(F.when(c, 1))
    x, y = F.col("a") == 1, F.col("b") == 1
    return rows.agg(n(x & y).alias("cnt_and"), F.count("*").alias("cnt_or"), n(~(x & y)).alias("cnt_xor"), n(x & ~y).alias("sub_ab"), n(~x & y).alias("sub_ba"), n(x).alias("cnt_a"), n(y).alias("cnt_b"))


def distances_any(a: DataFrame, b: DataFrame) -> DataFrame:
    """Which of the counts are not zero."""
    return distances(a, b).select(*[(F.col(c) > 0).alias(c.replace("cnt_", "any_").replace("sub_", "any_sub_")) for c in ("cnt_and", "cnt_or", "cnt_xor", "sub_ab", "sub_ba")])


def jaccard(n_and: Column, n_or: Column) -> Column:
    return F.when(n_or == 0, F.lit(0.0)).otherwise(n_and / n_or)


def dice(n_and: Column, n_a: Column, n_b: Column) -> Column:
    return F.when(n_a + n_b == 0, F.lit(0.0)).otherwise(2 * n_and / (n_a + n_b))


def pair_counts(sets: DataFrame) -> DataFrame:
    """(s1, s2, cnt_and, cnt_or) of all pairs s1 < s2 of a collection of few sets, pairs without common members included.

    The pairs that share ids come from the ids, so work grows with how many sets an id is in.
    """
    own = sets.distinct()
    sizes = own.groupBy("set_id").agg(F.count("*").alias("n"))
    l, r = own.select(F.col("set_id").alias("s1"), "id"), own.select(F.col("set_id").alias("s2"), "id")
    both = l.join(r, "id").filter("s1 < s2").groupBy("s1", "s2").agg(F.count("*").alias("n_and"))
    n1, n2 = sizes.select(F.col("set_id").alias("s1"), F.col("n").alias("n1")), sizes.select(F.col("set_id").alias("s2"), F.col("n").alias("n2"))
    pairs = n1.join(n2, F.col("s1") < F.col("s2"))
    out = pairs.join(both, ["s1", "s2"], "left").withColumn("cnt_and", F.coalesce("n_and", F.lit(0)).cast("long"))
    return out.select("s1", "s2", "cnt_and", (F.col("n1") + F.col("n2") - F.col("cnt_and")).cast("long").alias("cnt_or"))


def jaccard_batch(sets: DataFrame) -> DataFrame:
    """Pairs by falling similarity."""
    return pair_counts(sets).withColumn("similarity", jaccard(F.col("cnt_and"), F.col("cnt_or"))).orderBy(F.desc("similarity"), "s1", "s2")


def and_matrix(sets: DataFrame) -> DataFrame:
    """Triangular matrix of common counts, each set's own size on the diagonal."""
    diagonal = sets.distinct().groupBy("set_id").agg(F.count("*").alias("cnt")).select(F.col("set_id").alias("s1"), F.col("set_id").alias("s2"), "cnt")
    return diagonal.unionByName(pair_counts(sets).select("s1", "s2", F.col("cnt_and").alias("cnt")))


def count_intervals(a: DataFrame) -> DataFrame:
    """One row: runs of equal bits over the whole address space; 1 for the empty set."""
    from .intervals import LAST, islands

    i = islands(a).agg(F.count("*").alias("n"), F.coalesce(F.max(F.when(F.col("start") == 0, 1)), F.lit(0)).alias("zero"), F.coalesce(F.max(F.when(F.col("stop") == LAST, 1)), F.lit(0)).alias("last"))
    return i.select((2 * F.col("n") + 1 - F.col("zero") - F.col("last")).cast("long").alias("intervals"))


def value_counts(v: DataFrame) -> DataFrame:
    """(value, cnt) of a vector's assigned elements."""
    return v.filter("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("cnt"))


def count_notnull(v: DataFrame, left: int, right: int) -> DataFrame:
    return v.filter(F.col("idx").between(*ordered(left, right))).agg(F.count("value").alias("cnt"))


def octet_statistics(v: DataFrame) -> DataFrame:
    """(pos, ch, cnt): how often each character stands at each position."""
    chars = v.filter("value IS NOT NULL AND value <> ''").select(F.posexplode(F.split("value", "")).alias("pos", "ch")).filter("ch <> ''")
    return chars.groupBy(F.col("pos").cast("long").alias("pos"), "ch").agg(F.count("*").alias("cnt"))
