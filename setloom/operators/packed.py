"""Packed sets (bucket, bitmap): 32,768 ids a bucket in 4,096 bytes, by Spark's bitmap functions.

Buckets of Spark's functions begin at value 1, so ids are packed as id + 1, which keeps id 0 with its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET = 32_768


def pack(a: DataFrame) -> DataFrame:
    v = F.col("id") + 1
    return a.groupBy(F.bitmap_bucket_number(v).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("bitmap"))


def unpack(p: DataFrame) -> DataFrame:
    """Members again: a bitmap is cut into bytes once, and those that hold a bit are exploded."""
    rows = p.select("bucket", F.posexplode(F.regexp_extract_all(F.hex("bitmap"), F.lit("(..)"), F.lit(1))).alias("at", "digits")).filter("digits <> '00'")
    rows = rows.select("bucket", "at", F.conv("digits", 16, 10).cast("int").alias("byte"))
    bits = rows.select("bucket", "at", "byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit")).filter(F.expr("getbit(byte, bit)") == 1)
    return bits.select(((F.col("bucket") - 1) * BUCKET + F.col("at") * 8 + F.col("bit")).cast("long").alias("id"))


def packed_count(p: DataFrame) -> DataFrame:
    return p.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).cast("long").alias("cnt"))


def packed_or(*packs: DataFrame) -> DataFrame:
    out = packs[0]
    for p in packs[1:]:
        out = out.unionByName(p)
    return out.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def packed_and(*packs: DataFrame) -> DataFrame:
    """Buckets that any set lacks are empty in the intersection."""
    out = packs[0]
    for p in packs[1:]:
        out = out.unionByName(p)
    return out.groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("n")).filter(F.col("n") == len(packs)).drop("n")


def bytewise(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """XOR or SUB of packed sets: no such aggregate exists, so bitmaps of a bucket meet in an Arrow batch."""
    import numpy as np
    import pandas as pd

    both = a.join(b.withColumnRenamed("bitmap", "other"), "bucket", "full_outer" if op == "XOR" else "left")

    def run(frames):
        for frame in frames:
            empty = bytes(4096)
            x = [np.frombuffer(v if v is not None else empty, np.uint8) for v in frame["bitmap"]]
            y = [np.frombuffer(v if v is not None else empty, np.uint8) for v in frame["other"]]
            out = [(p ^ q if op == "XOR" else p & ~q) for p, q in zip(x, y)]
            yield pd.DataFrame({"bucket": frame["bucket"], "bitmap": [o.tobytes() for o in out]})

    return both.mapInPandas(run, "bucket long, bitmap binary")


def packed_xor(a: DataFrame, b: DataFrame) -> DataFrame:
    return bytewise(a, b, "XOR")


def packed_sub(a: DataFrame, b: DataFrame) -> DataFrame:
    return bytewise(a, b, "SUB")


def packed_op(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Set operation on stored packed sets, by code; COUNT_<op> gives one row (cnt)."""
    name = op.upper()
    if name.startswith("COUNT_"):
        return packed_count(packed_op(a, b, name[6:]))
    ops = {"AND": packed_and, "OR": packed_or, "XOR": packed_xor, "SUB": packed_sub, "SUB_AB": packed_sub, "SUB_BA": lambda x, y: packed_sub(y, x), "ASSIGN": lambda x, y: y, "A": lambda x, y: x, "B": lambda x, y: y}
    return ops[name](a, b)


def words(a: DataFrame, bits: int = 32) -> DataFrame:
    """(word, bits): the set as packed words of 8, 16, 32 or 64 bits; words without a bit have no row."""
    return a.groupBy(F.expr(f"id div {bits}L").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(id % {bits} AS INT))")).alias("bits"))


def from_words(w: DataFrame, bits: int = 32) -> DataFrame:
    """Inverse of words."""
    rows = w.select("word", "bits", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("b")).filter(F.expr("getbit(bits, b)") == 1)
    return rows.select((F.col("word") * bits + F.col("b")).cast("long").alias("id"))


def block_digest(a: DataFrame) -> DataFrame:
    """Blocks of 65,536 ids that hold a member."""
    return a.select(F.expr("id div 65536L").alias("block")).distinct()
