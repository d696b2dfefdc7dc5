"""Set algebra. Each operator is one join or one aggregation on id; Spark broadcasts a side only below its threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered(a: int, b: int) -> tuple[int, int]:
    """Bounds of a closed range in order; reversed bounds are swapped."""
    return (a, b) if a <= b else (b, a)


def bit_and(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "id", "left_semi")


def bit_or(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.distinct()


def bit_sub(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "id", "left_anti")


def tagged(*sets: DataFrame) -> DataFrame:
    """Rows (id, ord) of all sets: one aggregation by id then answers any question about all of them."""
    out = None
    for k, s in enumerate(sets):
        rows = s.select("id", F.lit(k).alias("ord"))
        out = rows if out is None else out.unionByName(rows)
    return out


def bit_xor(a: DataFrame, b: DataFrame) -> DataFrame:
    return tagged(a, b).groupBy("id").agg(F.count("*").alias("n")).filter("n = 1").select("id")


def bit_or_and(t: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """t with the common members of a and b."""
    return bit_or(t, bit_and(a, b))


def invert(a: DataFrame, size: int) -> DataFrame:
    """Members of [0, size) that a lacks."""
    return a.sparkSession.range(size).join(a, "id", "left_anti")


#: Operations by code.
OPERATIONS = {"AND": bit_and, "OR": bit_or, "SUB": bit_sub, "XOR": bit_xor}


def combine(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    return OPERATIONS[op.upper()](a, b)


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return bit_or(a, b)


def combine_or(a: DataFrame, ids: DataFrame) -> DataFrame:
    """Set with a sequence of ids, repeats allowed."""
    return bit_or(a, ids.select("id"))


def combine_xor(a: DataFrame, ids: DataFrame) -> DataFrame:
    """Each id of the sequence toggles its membership, as often as it occurs."""
    return a.unionByName(ids.select("id")).groupBy("id").agg((F.count("*") % 2).alias("odd")).filter("odd = 1").select("id")


def combine_sub(a: DataFrame, ids: DataFrame) -> DataFrame:
    return bit_sub(a, ids)


def combine_and(a: DataFrame, ids: DataFrame) -> DataFrame:
    return bit_and(a, ids)


def keep(a: DataFrame, ids: DataFrame) -> DataFrame:
    return bit_and(a, ids)


def clear(a: DataFrame, ids: DataFrame) -> DataFrame:
    return bit_sub(a, ids)


def first_mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the smallest id in one set alone, NULL for equal sets."""
    return bit_xor(a, b).agg(F.min("id").alias("first_mismatch"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: 1 if the first mismatch is in a, -1 if in b, 0 for equal sets."""
    one = tagged(a, b).groupBy("id").agg(F.count("*").alias("n"), F.min("ord").alias("ord")).filter("n = 1")
    first = one.agg(F.min(F.struct("id", "ord")).alias("m"))
    return first.select(F.coalesce(F.when(F.col("m.ord") == 0, 1).when(F.col("m.ord") == 1, -1), F.lit(0)).alias("cmp"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    return bit_xor(a, b).agg((F.count("*") == 0).alias("equal"))


def keep_range(a: DataFrame, left: int, right: int) -> DataFrame:
    return a.filter(F.col("id").between(*ordered(left, right)))


copy_range = keep_range


def clear_range(a: DataFrame, left: int, right: int) -> DataFrame:
    return a.filter(~F.col("id").between(*ordered(left, right)))


def set_range(a: DataFrame, left: int, right: int, value: bool = True) -> DataFrame:
    left, right = ordered(left, right)
    return bit_or(a, a.sparkSession.range(left, right + 1)) if value else clear_range(a, left, right)


def set_bit(a: DataFrame, n: int, value: bool = True) -> DataFrame:
    return set_range(a, n, n, value)


def set_bit_and(a: DataFrame, n: int, value: bool) -> DataFrame:
    return a if value else clear_range(a, n, n)


def set_bit_conditional(a: DataFrame, n: int, value: bool, condition: bool) -> DataFrame:
    """Bit n becomes value only where it is condition now."""
    if value == condition:
        return a
    return set_bit(a, n, value)


def flip(a: DataFrame, n: int) -> DataFrame:
    return bit_xor(a, a.sparkSession.range(n, n + 1))


def increment(a: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Bit n flipped, and one row: carry, true if it was set."""
    return flip(a, n), a.filter(F.col("id") == n).agg((F.count("*") > 0).alias("carry"))


def resize(a: DataFrame, size: int) -> DataFrame:
    return a.filter(F.col("id") < size)


def swap(a: DataFrame, x: int, y: int) -> DataFrame:
    """Membership of two ids exchanged."""
    c = F.col("id")
    return a.select(F.when(c == x, F.lit(y).cast("long")).when(c == y, F.lit(x).cast("long")).otherwise(c).alias("id"))


def test(a: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (id, member) for the ids asked."""
    return ids.join(a.select(F.col("id").alias("_m")), F.col("id") == F.col("_m"), "left").select("id", F.col("_m").isNotNull().alias("member"))
