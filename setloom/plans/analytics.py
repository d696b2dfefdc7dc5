"""Histograms, k-mers, word search, clustering, range indexes and price scans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bound
from ..operators.metrics import jaccard, pair_counts
from ..operators.rank import range_split
from ..operators.sets import ordered
from ..storage import checkpointed


def flagship(lineitem: DataFrame, supplier: DataFrame, nation: int, year: int) -> DataFrame:
    """(l_suppkey, cnt): rows shipped in a year by a nation's suppliers, without returned ones.

    The date bounds and the flag reach the scan; the suppliers are a semi-join.
    """
    own = supplier.filter(F.col("s_nationkey") == nation).select(F.col("s_suppkey").alias("l_suppkey"))
    start, stop = f"{year}-01-01", f"{year + 1}-01-01"
    rows = lineitem.filter((F.col("l_shipdate") >= F.lit(start).cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit(stop).cast("timestamp_ntz")) & (F.col("l_returnflag") != "R"))
    return rows.join(own, "l_suppkey", "left_semi").groupBy("l_suppkey").agg(F.count("*").alias("cnt"))


def histogram_fixed(a: DataFrame, width: int, size: int) -> DataFrame:
    """(bin, cnt) for every bin of [0, size), empty ones too."""
    bins = a.sparkSession.range((size + width - 1) // width).select(F.col("id").alias("bin"))
    counts = a.filter(F.col("id") < size).groupBy(F.expr(f"id div {width}L").alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("cnt"))


def histogram_adaptive(a: DataFrame, per_bin: int) -> DataFrame:
    """Bins of equal population, (start, stop)."""
    return range_split(a, per_bin)


def kmers(docs: DataFrame, k: int, text: str | Column = "text", key: str = "doc_id") -> DataFrame:
    """(key, pos, kmer) of all substrings of k characters, by one split of each text into characters."""
    t = F.col(text) if isinstance(text, str) else text

    def grams(c: Column) -> Column:
        n = F.size(c) - k
        return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.array_join(F.slice(c, i + 1, k), ""))).otherwise(F.array().cast("array<string>"))

    chars = F.filter(F.split(F.coalesce(t, F.lit("")), ""), lambda x: x != "")
    return docs.select(key, F.posexplode(bound(chars, grams)).alias("pos", "kmer"))


#: Places a task counts k-mers of at a time; k-mers it holds before it adds up equal ones.
PLACES, ROWS = 1 << 23, 1 << 21


def ranked_windows(codes: np.ndarray, k: int, letters: int) -> np.ndarray:
    """For each window of k codes below letters a number that equal windows alone share."""
    n = len(codes) - k + 1
    bits = max(1, (letters - 1).bit_length())
    key, width = np.zeros(n, np.uint64), 0
    for i in range(k):
        if width + bits > 64:  # numbered anew, as what has been packed takes at most n values
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
            width = int(max(1, n - 1)).bit_length()
        key = (key << np.uint64(bits)) | codes[i : i + n]
        width += bits
    return key


def counted_kmers(points: np.ndarray, left: np.ndarray, k: int) -> pa.RecordBatch:
    """kmer, cnt of code points; left: how many of its text each still has, itself included."""
    at = np.flatnonzero(left[: max(0, len(points) - k + 1)] >= k)
    if not len(at):
        return pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64())], ["kmer", "cnt"])
    seen = np.flatnonzero(np.bincount(points))
    table = np.zeros(int(seen[-1]) + 1, np.uint64)
    table[seen] = np.arange(len(seen), dtype=np.uint64)
    bits = max(1, (len(seen) - 1).bit_length())
    key = ranked_windows(table[points], k, len(seen))[at]
    if k * bits <= 64:  # a window's number holds its letters
        key.sort()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        cnt, key = np.diff(first, append=len(key)), key[first]
        shifts = np.arange(k - 1, -1, -1, dtype=np.uint64) * np.uint64(bits)
        chars = seen[((key[:, None] >> shifts) & np.uint64((1 << bits) - 1)).astype(np.int64)]
    else:
        _, first, cnt = np.unique(key, return_index=True, return_counts=True)
        chars = points[at[first][:, None] + np.arange(k)]
    size = 1 + (chars >= 0x80).astype(np.int32) + (chars >= 0x800) + (chars >= 0x10000)
    data = chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    ends = np.concatenate([[0], np.cumsum(size.sum(axis=1))]).astype(np.int64)
    kmer = pa.LargeStringArray.from_buffers(len(cnt), pa.py_buffer(ends), pa.py_buffer(data)).cast(pa.string())
    return pa.RecordBatch.from_arrays([kmer, pa.array(cnt, pa.int64())], ["kmer", "cnt"])


def added_up(batches, rows: int):
    """kmer, cnt of one task -> the same with few rows a k-mer: equal ones are added up whenever so many rows are held."""

    def summed():
        table = pa.Table.from_batches(held).group_by("kmer").aggregate([("cnt", "sum")]).select(["kmer", "cnt_sum"])
        return table.rename_columns(["kmer", "cnt"]).combine_chunks().to_batches()

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            held = summed()
            n = sum(b.num_rows for b in held)
            if n >= rows // 2:  # mostly distinct: out, to keep memory bounded
                yield from held
                held, n = [], 0
    if held:
        yield from summed()


def kmer_counts(docs: DataFrame, k: int, text: str | Column = "text", key: str = "doc_id") -> DataFrame:
    """(kmer, cnt) of all substrings of k characters; a task counts those of millions of places before any becomes a row.

    Equal ones of all its places are added up in the task, so its rows follow the kinds of k-mers, not its share of the text.
    """

    def points_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of texts of UTF-8 in one row, and how many of its text each still has."""
        one = [np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for t in texts]
        sizes = np.array([len(p) for p in one], np.int64)
        points = np.concatenate(one)
        ends = np.cumsum(sizes).astype(np.int32 if len(points) < 1 << 31 else np.int64)
        left = np.repeat(ends, sizes)
        left -= np.arange(len(points), dtype=left.dtype)
        return points, left

    def run(batches):
        yield from added_up(blocks(batches), ROWS)

    def blocks(batches):
        held, n = [], 0
        for batch in batches:
            for value in batch.column(0):
                held.append(value.as_py())
                n += len(held[-1])
                if n >= PLACES:
                    yield from counted(held)
                    held, n = [], 0
        if held:
            yield from counted(held)

    def counted(texts: list[bytes]):
        points, left = points_of(texts)
        for start in range(0, len(points), PLACES):  # a text of any length; windows reach over the cut
            stop = start + PLACES + k - 1
            yield counted_kmers(points[start:stop], left[start:stop], k)

    t = F.col(text) if isinstance(text, str) else text
    some = docs.select(t.cast("string").cast("binary").alias("t")).filter(F.length("t") >= k)
    return some.mapInArrow(run, "kmer string, cnt long").groupBy("kmer").agg(F.sum("cnt").alias("cnt"))


def kmer_presence(docs: DataFrame, k: int, alphabet: str = "acgt", **where) -> DataFrame:
    """(code): k-mers over an alphabet as numbers, the first letter lowest."""
    bits = max(1, (len(alphabet) - 1).bit_length())
    grams = kmer_counts(docs, k, **where).select(F.lower("kmer").alias("kmer")).distinct()
    code = sum((F.shiftleft((F.instr(F.lit(alphabet), F.substring("kmer", i + 1, 1)) - 1).cast("long"), bits * i) for i in range(k)), F.lit(0).cast("long"))
    return grams.filter(F.col("kmer").rlike(f"^[{alphabet}]{{{k}}}$")).select(code.alias("id")).distinct()


def top_words(docs: DataFrame, k: int, n: int, **where) -> DataFrame:
    """The n most frequent k-mers, ties by text: a top-n, not a full sort."""
    return kmer_counts(docs, k, **where).orderBy(F.desc("cnt"), "kmer").limit(n)


def kmer_histogram(docs: DataFrame, k: int, **where) -> DataFrame:
    """(cnt, kinds): how many k-mers occur so often."""
    return kmer_counts(docs, k, **where).groupBy("cnt").agg(F.count("*").alias("kinds"))


def word_starts(docs: DataFrame, word: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, start) of every occurrence of a word, overlaps too: places whose letters are the word's, text by text."""

    def starts(chars):
        places = F.when(F.size(chars) >= len(word), F.sequence(F.lit(0), F.size(chars) - len(word))).otherwise(F.array().cast("array<int>"))

        def here(i):
            out = F.lit(True)
            for k, c in enumerate(word):
                out = out & (F.get(chars, i + k) == c)
            return out

        return F.filter(places, here)

    chars = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), ""), lambda x: x != "")
    return docs.select(key, F.explode(bound(chars, starts)).alias("start")).select(key, F.col("start").cast("long").alias("start"))


def cluster_leaders(sets: DataFrame, threshold: float) -> DataFrame:
    """(set_id, leader): leaders in order of set_id take every later set not yet taken that is similar enough.

    The pairs above the threshold decide; a set is a leader once no leader before it takes it. Each round settles all sets
    whose earlier neighbours are settled, so rounds are as many as the longest chain, not as the sets.
    """
    near = pair_counts(sets).filter(jaccard(F.col("cnt_and"), F.col("cnt_or")) >= threshold).select("s1", "s2")
    open_ = sets.select("set_id").distinct()
    state = open_.withColumn("leader", F.lit(None).cast(open_.schema["set_id"].dataType))
    while True:
        lead = state.filter("leader = set_id").select(F.col("set_id").alias("s1"), F.lit(1).alias("is_leader"))
        done = state.filter("leader IS NOT NULL").select(F.col("set_id").alias("s1"), F.lit(1).alias("is_done"))
        facts = near.join(lead, "s1", "left").join(done, "s1", "left").groupBy(F.col("s2").alias("set_id"))
        facts = facts.agg(F.min(F.when(F.col("is_leader") == 1, F.col("s1"))).alias("by"), F.count(F.when(F.col("is_done").isNull(), 1)).alias("waiting"), F.min(F.when(F.col("is_done").isNull(), F.col("s1"))).alias("first_open"))
        nxt = state.join(facts, "set_id", "left")
        # a leader takes the set if no set before that leader may still become one
        sure = F.col("by").isNotNull() & (F.col("first_open").isNull() | (F.col("by") < F.col("first_open")))
        free = F.col("by").isNull() & (F.coalesce("waiting", F.lit(0)) == 0)
        new = F.when(F.col("leader").isNotNull(), F.col("leader")).when(sure, F.col("by")).when(free, F.col("set_id"))
        state = nxt.select("set_id", new.alias("leader"))
        state = checkpointed(state)
        if state.filter("leader IS NULL").isEmpty():
            return state


def range_search(index: DataFrame, key: str) -> DataFrame:
    """(start, stop, id_to) of a range index's rows of one key."""
    return index.filter(F.col("id_from") == key).select("start", (F.col("start") + F.col("len")).alias("stop"), "id_to")


def scroll(v: DataFrame, left: int, right: int, step: int) -> DataFrame:
    """(page, cnt, total): a frame read page by page; all pages in one pass."""
    left, right = ordered(left, right)
    rows = v.filter(F.col("idx").between(left, right))
    return rows.groupBy(F.expr(f"(idx - {left}L) div {step}L").alias("page")).agg(F.count("value").alias("cnt"), F.sum("value").cast("long").alias("total"))


def arbitrage(ab: DataFrame, bc: DataFrame, ac: DataFrame, margin: float) -> DataFrame:
    """(idx, ratio) where a chain of two rates is off the direct rate by more than the margin."""
    rows = ab.select("idx", F.col("value").alias("ab")).join(bc.select("idx", F.col("value").alias("bc")), "idx").join(ac.select("idx", F.col("value").alias("ac")), "idx")
    return rows.filter("ac <> 0").withColumn("ratio", F.col("ab") * F.col("bc") / F.col("ac")).filter(F.abs(F.col("ratio") - 1) > margin).select("idx", "ratio")


def octet_codes(stat: DataFrame) -> DataFrame:
    """(pos, ch, code): characters of each position by falling frequency, codes from 1."""
    from pyspark.sql import Window

    code = F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("cnt"), "ch"))
    return stat.select("pos", "ch", code.cast("long").alias("code"))


def encode_text(key: str, codes: DataFrame) -> DataFrame:
    """One row (code, mappable): a search key in the codes of each position, mappable false if a character has none."""
    spark = codes.sparkSession
    chars = spark.createDataFrame([(i, c) for i, c in enumerate(key)], "pos long, ch string")
    rows = chars.join(codes, ["pos", "ch"], "left")
    return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("code", F.lit(0)).alias("c")))), lambda x: x["c"]).alias("code"), (F.count(F.when(F.col("code").isNull(), 1)) == 0).alias("mappable"))


def decode_text(code: list[int], codes: DataFrame) -> DataFrame:
    """One row (value): a text from its codes."""
    spark = codes.sparkSession
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(code)], "pos long, code long").join(codes, ["pos", "code"])
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "").alias("value"))
