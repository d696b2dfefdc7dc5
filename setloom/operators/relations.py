"""Relations: images of sets, links, posting lists of foreign keys, positional joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def image(a: DataFrame, f: DataFrame, nullable: bool = True) -> DataFrame:
    """Image of a set under f (idx, value); under a relation that is not nullable an unassigned element maps to 0."""
    hit = f.join(a.select(F.col("id").alias("idx")), "idx", "left_semi")
    value = F.col("value") if nullable else F.coalesce("value", F.lit(0))
    return hit.select(value.cast("long").alias("id")).filter("id IS NOT NULL").distinct()


def image_of(f: DataFrame, n: int) -> DataFrame:
    """One row (mapped, value) for one id."""
    m = f.filter(F.col("idx") == n).agg(F.max("value").alias("value"))
    return m.select(F.col("value").isNotNull().alias("mapped"), "value")


def targets(links: DataFrame, n: int) -> DataFrame:
    return links.filter(F.col("src") == n).select(F.col("dst").alias("id")).distinct()


def hop(a: DataFrame, links: DataFrame) -> DataFrame:
    """All targets of a set's members."""
    return links.join(a.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()


def hops(a: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """Everything within k steps, the start included."""
    seen = a
    for _ in range(k):
        seen = seen.unionByName(hop(seen, links)).distinct()
    return seen


def add_links(links: DataFrame, src: int, targets_: DataFrame) -> DataFrame:
    return links.unionByName(targets_.select(F.lit(src).cast("long").alias("src"), F.col("id").alias("dst")))


def posting_counts(df: DataFrame, key: str, row: str | Column = "id") -> DataFrame:
    """Length of each foreign key's posting list."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count_distinct(F.col(row) if isinstance(row, str) else row).alias("cnt"))


def lookup(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, val) of the keys asked; a missing key ends the query."""
    found = keys.select("key").join(kv.withColumn("_is", F.lit(True)), "key", "left")
    key = F.when(F.col("_is").isNull(), F.raise_error(F.lit("no such key"))).otherwise(F.col("key"))
    return found.select(key.alias("key"), "val")


def equal_frames(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: do two frames of the same columns hold the same rows, each as often? Matrices and collections."""
    columns = a.columns
    both = a.withColumn("_side", F.lit(1)).unionByName(b.select(*columns).withColumn("_side", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("_side").alias("_n")).filter("_n <> 0").agg((F.count("*") == 0).alias("equal"))


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """(idx, a, b) of two vectors' common indexes."""
    return a.select("idx", F.col("value").alias("a")).join(b.select("idx", F.col("value").alias("b")), "idx")


def inverse_matches(a: DataFrame, b: DataFrame, t) -> DataFrame:
    """Indexes where one vector reaches t while the other falls to -t."""
    return aligned(a, b).filter((F.col("a") >= t) & (F.col("b") <= -t)).select(F.col("idx").alias("id"))


def nearest_before(probes: DataFrame, members: DataFrame) -> DataFrame:
    """(probe, found): the largest member up to each probe, NULL if none: the as-of form of a reverse search.

    Both sides meet in blocks of 65,536 ids; a block without an earlier member takes the last one of the blocks before.
    """
    from pyspark.sql import Window

    block = F.expr("id div 65536L")
    own = members.select("id", F.col("id").alias("m")).unionByName(probes.select("id").distinct().withColumn("m", F.lit(None).cast("long"))).withColumn("_b", block)
    run = Window.partitionBy("_b").orderBy("id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = own.withColumn("found", F.max("m").over(run))
    tops = own.groupBy("_b").agg(F.max("m").alias("top")).withColumn("_s", F.expr("_b div 65536L"))
    supers = tops.groupBy("_s").agg(F.max("top").alias("stop")).withColumn("below", F.max("stop").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("near", F.max("top").over(before)).join(supers.select("_s", "below"), "_s").select(F.col("_b").alias("_k"), F.coalesce("near", "below").alias("prior"))
    out = inside.filter("m IS NULL").join(tops, F.col("_b") == F.col("_k"))
    return out.select(F.col("id").alias("probe"), F.coalesce("found", "prior").alias("found"))
