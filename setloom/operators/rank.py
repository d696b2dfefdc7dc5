"""Rank and select over ids, with no window over all rows.

Ids are counted by block of 65,536 and blocks summed by group of 65,536 blocks: the group table has at most 65,536 rows
in a 48-bit address space, a group at most 65,536 blocks, a block at most 65,536 ids. Each of the three windows is so
bounded, whatever the set's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def block_of(column: str = "id") -> Column:
    return F.expr(f"{column} div {BLOCK}L")


def count_blocks(a: DataFrame) -> DataFrame:
    return a.groupBy(block_of().alias("block")).agg(F.count("*").alias("cnt"))


def block_offsets(a: DataFrame, column: str = "id") -> DataFrame:
    """block, before: how many rows lie in earlier blocks."""
    blocks = a.groupBy(block_of(column).alias("block")).agg(F.count("*").alias("cnt")).withColumn("super", F.expr(f"block div {BLOCK}L"))
    earlier = Window.orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    supers = blocks.groupBy("super").agg(F.sum("cnt").alias("all")).withColumn("skip", F.coalesce(F.sum("all").over(earlier), F.lit(0)))
    inside = Window.partitionBy("super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("part", F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
    return blocks.join(supers.select("super", "skip"), "super").select("block", (F.col("skip") + F.col("part")).alias("before"))


def with_rank(a: DataFrame, column: str = "id", name: str = "rank") -> DataFrame:
    """a with each row's rank by the column, from 1; columns besides stay. The column is unique and not negative."""
    off = block_offsets(a, column).withColumnRenamed("block", "_block")
    rows = a.withColumn("_b", block_of(column)).join(off, F.col("_b") == F.col("_block"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(column))
    return rows.withColumn(name, (F.col("before") + place).cast("long")).drop("_b", "_block", "before")


def rank_index(a: DataFrame) -> DataFrame:
    """block, cnt, upto: members of the block, and of it and all before."""
    return count_blocks(a).join(block_offsets(a), "block").select("block", "cnt", (F.col("before") + F.col("cnt")).cast("long").alias("upto"))


def count_to(a: DataFrame, n: int) -> DataFrame:
    """One row: members up to n."""
    return a.filter(F.col("id") <= n).agg(F.count("*").alias("rank"))


def ranks(a: DataFrame, probes: DataFrame) -> DataFrame:
    """Rows (probe, rank, member, corrected, rank_test) for many probes at once.

    Members and probes are one frame cut in blocks; a probe's rank is its block's offset and its place in the block.
    """
    p = probes.select(F.col("id").alias("probe")).distinct()
    off = block_offsets(a)
    both = a.select("id", F.lit(1).alias("m")).unionByName(p.select(F.col("probe").alias("id"), F.lit(0).alias("m"))).withColumn("_b", block_of())
    run = Window.partitionBy("_b").orderBy("id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("inside", F.sum("m").over(run)).withColumn("member", F.max("m").over(Window.partitionBy("_b", "id"))).filter("m = 0")
    blocks = p.select(F.expr(f"probe div {BLOCK}L").alias("_b")).distinct()
    heads = off.withColumn("ends", F.col("before"))
    total = count_blocks(a).join(heads, "block").select("block", "before", (F.col("before") + F.col("cnt")).alias("upto"))
    # a probe's block may hold no member: its offset is the end of the last block before
    line = total.select(F.col("block").alias("_b"), "upto", F.lit(0).alias("asked")).unionByName(blocks.select("_b", F.lit(None).cast("long").alias("upto"), F.lit(1).alias("asked")))
    line = line.withColumn("_s", F.expr(f"_b div {BLOCK}L"))
    last_of_super = line.groupBy("_s").agg(F.max("upto").alias("top"))
    fill = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    last_of_super = last_of_super.withColumn("below", F.coalesce(F.max("top").over(fill), F.lit(0))).select("_s", "below")
    within = Window.partitionBy("_s").orderBy("_b").rangeBetween(Window.unboundedPreceding, -1)
    line = line.withColumn("seen", F.max("upto").over(within)).filter("asked = 1").join(last_of_super, "_s").select(F.col("_b").alias("_k"), F.coalesce("seen", "below").alias("before"))
    out = inside.join(line, F.col("_b") == F.col("_k")).withColumn("rank", (F.col("before") + F.col("inside")).cast("long"))
    return out.select(F.col("id").alias("probe"), "rank", (F.col("member") == 1).alias("member"), (F.col("rank") - F.col("member")).cast("long").alias("corrected"), (F.col("rank") * F.col("member")).cast("long").alias("rank_test"))


def select(a: DataFrame, r: int) -> DataFrame:
    """The r-th member, from 1; no row for 0 or beyond the last."""
    return with_rank(a).filter(F.col("rank") == r).select("id")


def select_many(a: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (rank, id) for the ranks asked."""
    return with_rank(a).join(wanted, "rank").select("rank", "id")


def find_rank(a: DataFrame, r: int, start: int = 0) -> DataFrame:
    """The r-th member at or after start."""
    return select(a.filter(F.col("id") >= start), r)


def skip(a: DataFrame, n: int) -> DataFrame:
    """Members but the n first."""
    return with_rank(a).filter(F.col("rank") > n).select("id")


def range_split(a: DataFrame, size: int) -> DataFrame:
    """(start, stop) of ranges of `size` members: the first starts at the first member, each other behind the one before.

    Size 0 is one range over all.
    """
    if size <= 0:
        return a.agg(F.min("id").alias("start"), F.max("id").alias("stop")).filter("start IS NOT NULL")
    groups = with_rank(a).groupBy(F.expr(f"(rank - 1) div {size}L").alias("g")).agg(F.min("id").alias("low"), F.max("id").alias("stop"))
    before = groups.select((F.col("g") + 1).alias("g"), (F.col("stop") + 1).alias("after"))
    return groups.join(before, "g", "left").select(F.coalesce("after", "low").alias("start"), "stop")


def compress(a: DataFrame, source: DataFrame) -> DataFrame:
    """Members of a that are in source, named by their rank there from 0."""
    return with_rank(source).join(a, "id", "left_semi").select((F.col("rank") - 1).alias("id"))


def decompress(ranks_: DataFrame, source: DataFrame) -> DataFrame:
    """Inverse: ranks from 0 back to source's members."""
    named = with_rank(source).select((F.col("rank") - 1).alias("r"), "id")
    return named.join(ranks_.select(F.col("id").alias("r")), "r", "left_semi").select("id")


compress_by_source = compress


def as_vector(a: DataFrame) -> DataFrame:
    """Members in order as a vector frame."""
    return with_rank(a).select((F.col("rank") - 1).alias("idx"), F.col("id").alias("value"))


def resolve(v: DataFrame) -> DataFrame:
    """(idx, addr) of assigned elements: their dense addresses from 0."""
    return with_rank(v.filter("value IS NOT NULL").select("idx"), "idx", "r").select("idx", (F.col("r") - 1).alias("addr"))


def resolve_range(v: DataFrame, left: int, right: int) -> DataFrame:
    """One row: first and last dense address of the assigned elements in [left, right], NULL if none."""
    left, right = (left, right) if left <= right else (right, left)
    return resolve(v).filter(F.col("idx").between(left, right)).agg(F.min("addr").alias("first"), F.max("addr").alias("last"))
