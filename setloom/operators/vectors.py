"""Element access, combination and rewriting of vector frames (idx, value). NULL is an unassigned element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bit_of, signed_code, signed_value
from .sets import ordered


def get(v: DataFrame, default=0) -> DataFrame:
    """Every element, an unassigned one as the default: 0 or the empty text."""
    return v.withColumn("value", F.coalesce("value", F.lit(default)))


def try_get(v: DataFrame) -> DataFrame:
    return v.withColumn("assigned", F.col("value").isNotNull())


def at(v: DataFrame, n: int) -> DataFrame:
    """One row (value); an index past the end ends the query."""
    found = v.agg(F.max("idx").alias("top"), F.max(F.when(F.col("idx") == n, F.struct("value"))).alias("m"))
    return found.select(F.when(F.coalesce("top", F.lit(-1)) < n, F.raise_error(F.lit("index past the end"))).otherwise(F.col("m.value")).alias("value"))


def decode(v: DataFrame, start: int, n: int) -> DataFrame:
    """n elements from start on, in order."""
    return v.filter(F.col("idx").between(start, start + n - 1)).orderBy("idx")


def gather(v: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pos, idx, value) for rows (pos, idx): repeats and order are kept, an index past the end is NULL."""
    return wanted.join(v, "idx", "left").select("pos", "idx", "value")


def slice_of(v: DataFrame, bit: int) -> DataFrame:
    """Set of the indexes whose code has the bit."""
    return v.filter(bit_of("value", bit) == 1).select(F.col("idx").alias("id"))


def substring(v: DataFrame, start: int, stop: int) -> DataFrame:
    return v.withColumn("value", F.substring("value", start + 1, stop - start + 1))


def drop_nulls(v: DataFrame) -> DataFrame:
    return v.filter("value IS NOT NULL")


def fill_nulls(v: DataFrame, size: int) -> DataFrame:
    """Dense vector of a given size."""
    return v.sparkSession.range(size).select(F.col("id").alias("idx")).join(v, "idx", "left")


def super_block_arrays(a: DataFrame) -> DataFrame:
    """(block, ids) for each block of 2**24 ids, ids in order."""
    return a.groupBy(F.expr("id div 16777216L").alias("block")).agg(F.sort_array(F.collect_list("id")).alias("ids"))


def rewrite(v: DataFrame, condition: Column, value) -> DataFrame:
    kind = v.schema["value"].dataType
    to = value if isinstance(value, Column) else F.lit(value)
    return v.withColumn("value", F.when(condition, to.cast(kind)).otherwise(F.col("value")))


def assign(v: DataFrame, changes: DataFrame) -> DataFrame:
    """Elements of `changes` (idx, value) in place of v's, new indexes added."""
    return v.join(changes.select("idx"), "idx", "left_anti").unionByName(changes.select(*v.columns))


def set_null(v: DataFrame, n: int) -> DataFrame:
    return rewrite(v, F.col("idx") == n, None)


def clear_element(v: DataFrame, n: int, to_null: bool = False) -> DataFrame:
    zero = F.when(F.col("value").isNotNull(), F.lit(0)) if not to_null else F.lit(None)
    return rewrite(v, F.col("idx") == n, zero)


def with_mask(v: DataFrame, mask: DataFrame, name: str = "_in") -> DataFrame:
    m = mask.select(F.col("id").alias("_mask"))
    return v.join(m, F.col("idx") == F.col("_mask"), "left").withColumn(name, F.col("_mask").isNotNull()).drop("_mask")


def set_null_mask(v: DataFrame, mask: DataFrame) -> DataFrame:
    return rewrite(with_mask(v, mask), F.col("_in"), None).drop("_in")


def clear_mask(v: DataFrame, mask: DataFrame) -> DataFrame:
    """Masked elements become 0; unassigned ones stay so."""
    return rewrite(with_mask(v, mask), F.col("_in") & F.col("value").isNotNull(), 0).drop("_in")


def filter_mask(v: DataFrame, mask: DataFrame) -> DataFrame:
    """Elements outside the mask become unassigned."""
    return rewrite(with_mask(v, mask), ~F.col("_in"), None).drop("_in")


def subtract_mask(v: DataFrame, mask: DataFrame) -> DataFrame:
    return set_null_mask(v, mask)


def erase_mask(v: DataFrame, mask: DataFrame) -> DataFrame:
    """Masked elements go from a vector that stores no NULLs."""
    return v.join(mask.select(F.col("id").alias("idx")), "idx", "left_anti")


def clear_range(v: DataFrame, left: int, right: int, to_null: bool = False) -> DataFrame:
    inside = F.col("idx").between(*ordered(left, right))
    return rewrite(v, inside if to_null else inside & F.col("value").isNotNull(), None if to_null else 0)


def keep_range(v: DataFrame, left: int, right: int) -> DataFrame:
    return rewrite(v, ~F.col("idx").between(*ordered(left, right)), None)


copy_range = keep_range


def cut_range(v: DataFrame, left: int, right: int) -> DataFrame:
    """The range alone, of a vector that stores no NULLs."""
    return v.filter(F.col("idx").between(*ordered(left, right)))


def increment(v: DataFrame, deltas: DataFrame) -> DataFrame:
    """Values plus the summed deltas (idx, delta); an unassigned or new element counts from 0."""
    sums = deltas.groupBy("idx").agg(F.sum("delta").alias("delta"))
    both = v.join(sums, "idx", "full_outer")
    return both.select("idx", F.when(F.col("delta").isNull(), F.col("value")).otherwise(F.coalesce("value", F.lit(0)) + F.col("delta")).cast("long").alias("value"))


def increment_not_null(v: DataFrame, by) -> DataFrame:
    """Assigned elements plus a number."""
    return v.withColumn("value", F.col("value") + F.lit(by))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(idx, a, b, in_a, in_b) over the indexes of both."""
    l, r = a.select("idx", F.col("value").alias("a"), F.lit(True).alias("in_a")), b.select("idx", F.col("value").alias("b"), F.lit(True).alias("in_b"))
    return l.join(r, "idx", "full_outer")


def join_or(a: DataFrame, b: DataFrame) -> DataFrame:
    """Elementwise OR of the codes; an element is assigned if either is."""
    code = F.coalesce(signed_code("a"), F.lit(0)).bitwiseOR(F.coalesce(signed_code("b"), F.lit(0)))
    return paired(a, b).select("idx", F.when(F.col("a").isNotNull() | F.col("b").isNotNull(), signed_value(code)).alias("value"))


def merge_disjoint(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of vectors assigned on disjoint indexes: text and float vectors."""
    return paired(a, b).select("idx", F.coalesce("a", "b").alias("value"))


def merge_not_null(a: DataFrame, b: DataFrame) -> DataFrame:
    """OR of two vectors assigned on the same indexes."""
    rows = paired(a, b).filter("a IS NOT NULL AND b IS NOT NULL")
    return rows.select("idx", signed_value(signed_code("a").bitwiseOR(signed_code("b"))).alias("value"))


def mismatch(a: DataFrame, b: DataFrame, use_null: bool = True) -> DataFrame:
    """Set of the indexes where two vectors differ.

    use_null: a value differs, or one alone is unassigned. Otherwise only indexes assigned on at least one side count,
    and an unassigned element reads as 0; an index past one vector's end differs if it is assigned in the other.
    """
    rows = paired(a, b)
    either = F.col("a").isNotNull() | F.col("b").isNotNull()
    tail = F.col("in_a").isNull() | F.col("in_b").isNull()
    if use_null:
        differ = ~F.col("a").eqNullSafe(F.col("b")) | tail
    else:
        differ = either & (~F.col("a").eqNullSafe(F.col("b")) | tail)
    return rows.filter(differ).select(F.col("idx").alias("id"))


def first_mismatch(a: DataFrame, b: DataFrame, use_null: bool = True) -> DataFrame:
    return mismatch(a, b, use_null).agg(F.min("id").alias("first_mismatch"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    return mismatch(a, b).agg((F.count("*") == 0).alias("equal"))


def visit(v: DataFrame, function, schema: str, mask: DataFrame | None = None) -> DataFrame:
    """A function over batches of rows, of masked rows if there is a mask: the surface for user code."""
    from .search import masked

    return (v if mask is None else masked(v, mask)).mapInPandas(function, schema)
