"""URL filters as a temporal list join.

A list is a table of dated entries that add or remove a domain or a path prefix. The entries of a value become validity
intervals, each open until the value's next entry, and a capture is held against the intervals that hold at its fetch
time. A capture's candidates are its host's suffixes and its path's prefixes, so the join is on equal values and only
then on time.

Defined results: a null or malformed url has an empty host and matches nothing; a null fetch time matches nothing; a url of
any length is matched whole; of a value's entries of one time the removal counts; of several values that match, the
longest is named, of equal lengths the greatest; repeated rows are judged each; extra columns stay, but for those named as
the results; an empty list lets all pass; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, pick

#: The list of the registered query: day, action, kind, value. A prefix ends with a slash.
ENTRIES = [
    ("2024-01-01", "add", "domain", "cheap-pills.example.com"),
    ("2024-07-01", "remove", "domain", "cheap-pills.example.com"),
    ("2024-10-01", "add", "domain", "cheap-pills.example.com"),
    ("2024-02-15", "add", "domain", "spam-farm.example.org"),
    ("2024-03-01", "add", "domain", "tionsh.example.net"),
    ("2024-04-01", "remove", "domain", "tionsh.example.net"),
    ("2024-05-01", "add", "prefix", "blog.tionble.example.com/de/"),
    ("2024-05-01", "add", "prefix", "www.ththhe.example.com/en/"),
    ("2024-09-01", "remove", "prefix", "www.ththhe.example.com/en/"),
    ("2024-06-15", "add", "domain", "thther.example.org"),
    ("2024-06-15", "remove", "domain", "thther.example.org"),
    ("2024-11-01", "add", "domain", "ththan.example.net"),
]

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """Lower case, without port and without dots at its end; the brackets of an IPv6 address stay."""
    return plain_host(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def plain_host(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"\.+$", "")


def candidates(url: Column) -> Column:
    """Values of a list that would match the url: suffixes of its host, and prefixes of host and path up to a slash."""
    name = host(url)
    path = F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))

    def suffixes(labels: Column) -> Column:
        return F.transform(labels, lambda _, i: F.concat(F.lit("domain "), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))

    def prefixes(parts: Column) -> Column:
        heads = F.slice(parts, 1, F.size(parts) - 1)
        return F.transform(heads, lambda _, i: F.concat(F.lit("prefix "), F.array_join(F.slice(parts, 1, i + 1), "/"), F.lit("/")))

    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.concat(once(F.split(name, r"\."), suffixes), once(F.split(F.concat(name, path), "/"), prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """at, action, kind, value -> key, valid_from, valid_to: the times a value is on the list; valid_to is not in, null is for ever."""
    key = F.concat_ws(" ", F.lower("kind"), F.when(F.lower("kind") == "domain", plain_host(F.col("value"))).otherwise(F.col("value")))
    rows = entries.filter("at IS NOT NULL AND action IS NOT NULL AND kind IS NOT NULL AND value IS NOT NULL")
    rows = rows.groupBy(key.alias("key"), "at").agg(F.min(F.when(F.lower("action") == "add", 1).otherwise(0)).alias("on"))
    rows = rows.withColumn("valid_to", F.lead("at").over(Window.partitionBy("key").orderBy("at")))
    return rows.filter(F.col("on") == 1).select("key", F.col("at").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (url, fetched, and any more) -> also host, n_active, matched, blocked.

    The list is joined as Spark sees fit: broadcast while its size is below the session's threshold, else shuffled, where
    adaptive execution splits a value that many captures share.
    """
    key, hits, value_, url_, at_ = fresh(captures, "key", "hits", "value", "url", "at")
    asked = captures.select("url", "fetched").filter("url IS NOT NULL AND fetched IS NOT NULL").distinct()
    asked = asked.select(F.col("url").alias(url_), F.col("fetched").alias(at_), F.explode(candidates(F.col("url"))).alias(key))
    active = intervals(entries).withColumnRenamed("key", "i_key")
    on = (F.col(key) == F.col("i_key")) & (F.col(at_) >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col(at_) < F.col("valid_to")))
    value = F.regexp_replace(F.col(key), "^[^ ]* ", "")  # the kind goes, the value may hold spaces
    found = asked.join(active, on).groupBy(url_, at_).agg(F.count("*").alias(hits), F.max(F.struct(F.length(value).alias("n"), value.alias("value"))).alias(value_))
    out = captures.join(found, (F.col("url") == F.col(url_)) & (F.col("fetched") == F.col(at_)), "left")
    keep = [c for c in captures.columns if c.lower() not in ("host", "n_active", "matched", "blocked")]
    return out.select(*keep, host(F.col("url")).alias("host"), F.coalesce(hits, F.lit(0)).cast("long").alias("n_active"), F.col(f"{value_}.value").alias("matched"), F.col(hits).isNotNull().alias("blocked"))


def entry_frame(spark: SparkSession, entries=ENTRIES) -> DataFrame:
    return spark.createDataFrame(list(entries), "at string, action string, kind string, value string").withColumn("at", F.to_date("at"))


def op3_urls(spark, sf_dir: str) -> DataFrame:
    """Every page judged by the list of the day it was fetched. Pages carry no time: page_id gives each a day of 2024."""
    pages = pick(spark.read.parquet(f"{sf_dir}/pages.parquet"), page_id="long", url="string")
    pages = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")))
    out = judge(pages, entry_frame(spark))
    return out.select("page_id", "url", F.col("fetched").cast("string").alias("fetched"), "host", "n_active", "matched", "blocked")


VALUES = ", ".join(f"(DATE '{d}', '{a}', '{k}', '{v}')" for d, a, k, v in ENTRIES)
ORACLE = rf"""
WITH entries(since, action, kind, value) AS (VALUES {VALUES}),
days AS (SELECT kind, value, since, min(CASE WHEN action = 'add' THEN 1 ELSE 0 END) AS up FROM entries GROUP BY kind, value, since),
spans AS (SELECT *, lead(since) OVER (PARTITION BY kind, value ORDER BY since) AS until FROM days),
active AS (SELECT kind, value, since, until FROM spans WHERE up = 1),
caps AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS day,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1)), '\.+$', '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT c.page_id, c.url, strftime(c.day, '%Y-%m-%d') AS fetched, c.host, count(a.value) AS n_active,
  max_by(a.value, lpad(CAST(length(a.value) AS VARCHAR), 6, '0') || a.value) AS matched, count(a.value) > 0 AS blocked
FROM caps c LEFT JOIN active a ON c.host <> '' AND c.day >= a.since AND (a.until IS NULL OR c.day < a.until)
  AND ((a.kind = 'domain' AND (c.host = a.value OR ends_with(c.host, '.' || a.value)))
    OR (a.kind = 'prefix' AND starts_with(c.host || c.path, a.value)))
GROUP BY c.page_id, c.url, c.day, c.host
"""
