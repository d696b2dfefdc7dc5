"""Conflict-constrained best-fit packing of documents into sequences of a fixed number of words.

Documents are cut into pieces of at most one capacity. Pieces are dealt by hash over shards of bounded size, so copies
and sources spread evenly; inside a shard best-fit-decreasing runs over bins kept in order of their residual. A bin
carries two bitmaps: the duplicate clusters it holds, and the sources that have filled their share of it. The successor
search goes on from the tightest bin that is large enough until one is compatible, and opens a new bin only if none is.

A source's share of a bin is SHARE of the capacity, or SLACK times the source's share of the shard's words where that is
more, so a shard of one source can fill its bins. A source is closed to a bin once its words there reach that share; the
piece that reaches it may go beyond.

Defined results: null or empty text is one piece of 0 words, which has no cluster and no source and goes to the fullest
bin; null source is a source of its own; null doc_id packs like any other; repeated rows are copies of one another and
so never share a bin; equal lengths go by doc_id, piece, cluster and source; a text longer than a capacity has its pieces
in several bins; columns of other names are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick, word_count
from .simhash import near_duplicates

CAPACITY = 2048
#: Share of a bin after which a source is closed to it, at least; times its share of the shard's words.
SHARE, SLACK = 0.5, 1.5
#: Pieces a shard holds on average; a shard is packed in one task's memory.
SHARD = 6000

SCHEMA = "doc_id long, piece long, start_word long, n_words long, bin_id long, bin_offset long, bin_words long"


def shares(lengths: list[int], sources: list, capacity: int, share: float) -> dict:
    """Words of each source after which it is closed to a bin."""
    words = Counter()
    for n, s in zip(lengths, sources):
        words[s] += n
    every = sum(words.values())
    return {s: capacity * min(1.0, max(share, SLACK * n / every if every else 0.0)) for s, n in words.items()}


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int, share: float) -> tuple[list[int], list[int]]:
    """The bin of each item; items come longest first. Also the words in each bin."""
    real = [c for n, c in zip(lengths, clusters) if n]
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in Counter(real).items() if n > 1)}
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    most = shares(lengths, sources, capacity, share)
    held: list[int] = []  # by bin: bitmap of clusters
    closed: list[int] = []  # by bin: bitmap of sources
    words: list[dict] = []  # by bin: words of each source
    used: list[int] = []
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    bins = []
    for n, source, cluster in zip(lengths, sources, clusters):
        c = cluster_bit.get(cluster, 0) if n else 0
        s = source_bit[source] if n else 0
        at = bisect_left(order, (n, -1))
        while at < len(order) and (held[order[at][1]] & c or closed[order[at][1]] & s):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(used)
            held.append(0)
            closed.append(0)
            words.append({})
            used.append(0)
        held[b] |= c
        words[b][source] = words[b].get(source, 0) + n
        if s and words[b][source] >= most[source]:
            closed[b] |= s
        used[b] += n
        bins.append(b)
        insort(order, (residual - n, b))
    return bins, used


def pack(items: DataFrame, capacity: int = CAPACITY, share: float = SHARE, shard: int = SHARD) -> DataFrame:
    """doc_id long, source string, cluster long, size long -> one row for each piece with its bin and its place there.

    Words start_word to start_word + n_words of the document lie at bin_offset in bin bin_id, which holds bin_words.
    """
    if capacity < 1 or not 0 < share <= 1:
        raise ValueError("capacity must be at least 1 and share above 0 and at most 1")
    cap = F.lit(capacity).cast("long")
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / cap).cast("long"))
    # equal rows are counted, so that each of them can be dealt to a shard of its own
    counted = items.groupBy("doc_id", "source", "cluster", "size").agg(F.count("*").alias("m"))
    counted = counted.select("doc_id", "source", "cluster", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("copy"))
    pieces = counted.select("doc_id", "source", "cluster", "size", "copy", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.withColumn("start_word", F.col("piece") * cap)
    pieces = pieces.withColumn("n_words", F.least(cap, F.col("size") - F.col("start_word"))).drop("size")
    pieces = materialize(pieces, "pack-pieces")
    shards = max(1, math.ceil(pieces.count() / shard))
    key = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.when(F.col("doc_id").isNull(), F.col("cluster")), "copy", "piece", F.lit(5))
    dealt = pieces.withColumn("shard", F.pmod(key, F.lit(shards)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_words", "doc_id", "piece", "cluster", "source"], ascending=[False, True, True, True, True], kind="mergesort", na_position="last")
        sources = [None if pd.isna(x) else x for x in pdf["source"]]
        bins, used = best_fit(pdf["n_words"].tolist(), sources, pdf["cluster"].tolist(), capacity, share)
        bin_of = pd.Series(bins, index=pdf.index, dtype="int64")
        base = int(pdf["shard"].iloc[0]) << 32
        n = pdf["n_words"]
        return pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "piece": pdf["piece"], "start_word": pdf["start_word"], "n_words": n, "bin_id": bin_of + base, "bin_offset": n.groupby(bin_of).cumsum() - n, "bin_words": [used[b] for b in bins]})

    return dealt.groupBy("shard").applyInPandas(one, SCHEMA)


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Documents packed by words; documents with equal texts are one duplicate cluster, as after near-deduplication."""
    docs = pick(docs, doc_id="long", source="string", text="string")
    text = F.coalesce(F.col("text"), F.lit(""))
    return pack(docs.select("doc_id", "source", F.xxhash64(text).alias("cluster"), word_count(text).alias("size")), **options)


def pack_apart(docs: DataFrame, **options) -> DataFrame:
    """Documents packed by words; documents whose fingerprints are linked (see simhash) are one duplicate cluster."""
    docs = pick(docs, doc_id="long", source="string", text="string")
    sizes = docs.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), word_count(F.col("text")).alias("size"))
    nodes = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("doc_id"), "text")
    linked = near_duplicates(nodes).groupBy("doc_id").agg(F.min("component_id").alias("cluster")).withColumnRenamed("doc_id", "c_node")
    items = sizes.join(linked, F.col("node") == F.col("c_node"))
    return pack(items.select("doc_id", "source", "cluster", "size"), **options)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with the bin it is packed into."""
    return pack_apart(spark.read.parquet(f"{sf_dir}/documents.parquet"))
