"""Positional rewrites: shift, insert, erase and swap, for sets, vectors and matrices alike.

Each is a projection of the position column; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import LAST


def moved(df: DataFrame, column: str, to: Column, where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.filter(where)
    return rows.withColumn(column, to.cast("long")).select(*df.columns)


def shift_right(a: DataFrame) -> DataFrame:
    return moved(a, "id", F.col("id") + 1, F.col("id") < LAST)


def shift_left(a: DataFrame) -> DataFrame:
    return moved(a, "id", F.col("id") - 1, F.col("id") > 0)


def carry_right(a: DataFrame) -> DataFrame:
    return a.filter(F.col("id") == LAST).agg((F.count("*") > 0).alias("carry"))


def carry_left(a: DataFrame) -> DataFrame:
    return a.filter(F.col("id") == 0).agg((F.count("*") > 0).alias("carry"))


def open_gap(df: DataFrame, column: str, n: int) -> DataFrame:
    """Positions from n on move up by one: insert a column into a matrix or make room in a vector."""
    c = F.col(column)
    return moved(df, column, F.when(c >= n, c + 1).otherwise(c))


def close_gap(df: DataFrame, column: str, n: int) -> DataFrame:
    """Position n goes and those behind move down: erase."""
    c = F.col(column)
    return moved(df, column, F.when(c > n, c - 1).otherwise(c), c != n)


def exchange(df: DataFrame, column: str, x: int, y: int) -> DataFrame:
    c = F.col(column)
    return moved(df, column, F.when(c == x, y).when(c == y, x).otherwise(c))


def insert_bit(a: DataFrame, n: int, value: bool = True) -> DataFrame:
    out = open_gap(a, "id", n)
    return out.unionByName(a.sparkSession.range(n, n + 1)) if value else out


def erase_bit(a: DataFrame, n: int) -> DataFrame:
    return close_gap(a, "id", n)


def insert_element(v: DataFrame, n: int, value) -> DataFrame:
    kind = v.schema["value"].dataType.simpleString()
    return open_gap(v, "idx", n).unionByName(v.sparkSession.createDataFrame([(n, value)], f"idx long, value {kind}"))


def erase_element(v: DataFrame, n: int) -> DataFrame:
    return close_gap(v, "idx", n)


def swap_elements(v: DataFrame, x: int, y: int) -> DataFrame:
    return exchange(v, "idx", x, y)


def insert_column(m: DataFrame, n: int) -> DataFrame:
    return open_gap(m, "id", n)


def erase_column(m: DataFrame, n: int) -> DataFrame:
    return close_gap(m, "id", n)


def swap_columns(m: DataFrame, x: int, y: int) -> DataFrame:
    return exchange(m, "id", x, y)


def clear_column(m: DataFrame, n: int) -> DataFrame:
    return m.filter(F.col("id") != n)


def matrix_row(m: DataFrame, row: int) -> DataFrame:
    return m.filter(F.col("row") == row).select("id")
