"""Readers: Parquet frames, link pairs, range indexes, reports, sequences, dictionaries, price bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frames import as_set, edges, vector


def read_set(spark: SparkSession, path: str, column: str = "id") -> DataFrame:
    return as_set(spark.read.parquet(path), column)


def read_vector(spark: SparkSession, path: str, idx: str = "idx", value: str = "value") -> DataFrame:
    return vector(spark.read.parquet(path), idx, value)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """(key, val BINARY) as write_collection wrote it."""
    return spark.read.parquet(path).select(F.col("key").cast("long").alias("key"), F.col("val").cast("binary").alias("val"))


def read_stored_links(spark: SparkSession, path: str) -> DataFrame:
    """Edges as write_links wrote them."""
    return edges(spark.read.parquet(path), "src", "dst")


def read_range(spark: SparkSession, path: str, left: int, right: int, column: str = "idx") -> DataFrame:
    """Only rows of a range; the bounds reach the Parquet scan."""
    left, right = (left, right) if left <= right else (right, left)
    return spark.read.parquet(path).filter(F.col(column).between(left, right))


def read_masked(spark: SparkSession, path: str, mask: DataFrame, column: str = "idx") -> DataFrame:
    """Only rows of a mask set."""
    return spark.read.parquet(path).join(mask.select(F.col("id").alias(column)), column, "left_semi")


def read_structure(spark: SparkSession, path: str):
    """The schema alone."""
    return spark.read.parquet(path).schema


def read_links(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Text of pairs id_from, id_to in any order."""
    return edges(spark.read.csv(path, sep=sep, schema="a long, b long"), "a", "b")


def read_range_index(spark: SparkSession, path: str) -> DataFrame:
    """Text of id_from, from, to, id_to -> (id_from, start, len, id_to); rows whose range is reversed go."""
    parts = F.split(F.trim("value"), r"[\s,]+")
    rows = spark.read.text(path).select(parts[0].alias("id_from"), parts[1].cast("long").alias("start"), parts[2].cast("long").alias("stop"), parts[3].alias("id_to"))
    return rows.filter("stop >= start").select("id_from", "start", (F.col("stop") - F.col("start")).alias("len"), "id_to")


def read_positions_report(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated id and position -> vector frame with the position as index."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema="name string, chromosome string, position long")
    name = F.regexp_extract("name", r"(\d+)", 1).cast("long")
    return rows.filter("position IS NOT NULL").select(F.col("position").alias("idx"), name.alias("value")).filter("value IS NOT NULL")


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """Sequence text with header lines -> (file, pos, letter), positions from 0 in each file.

    A file is read as one text: letters are numbered by their place in it.
    """
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.upper(F.regexp_replace(F.regexp_replace("value", r"(?m)^[>;].*$", ""), r"\s", "")).alias("s"))
    return rows.select("file", F.posexplode(F.split("s", "")).alias("pos", "letter")).filter("letter <> ''").select("file", F.col("pos").cast("long").alias("pos"), "letter")


def read_dictionary(spark: SparkSession, path: str, field: int = 1, sep: str = "|") -> DataFrame:
    """Distinct names of one field of a delimited file, with their place in sorted order as index."""
    from ..plans.ordering import ordered_index

    names = spark.read.text(path).select(F.split("value", rf"\{sep}")[field].alias("value")).filter("value IS NOT NULL AND value <> ''").distinct()
    return ordered_index(names, "value")


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Price bars with a header: time, open, high, low, close, volume -> also pct, a bar's change in whole percents."""
    rows = spark.read.csv(path, header=True, schema="time string, open float, high float, low float, close float, volume int")
    return rows.withColumn("pct", F.when(F.col("open") != 0, F.round((F.col("close") - F.col("open")) / F.col("open") * 100)).cast("int"))
