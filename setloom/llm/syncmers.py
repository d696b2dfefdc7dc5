"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is cut into tokens of at most four characters inside its words. A k-mer of eight tokens is chosen if the smallest
of its seven two-token substrings lies at either edge: a rule that looks at the k-mer alone, so equal stretches of two
texts choose equal anchors wherever they stand, and any stretch of fourteen tokens has one. The fingerprint holds all
anchors of a text in their order, each with its distance from the one before, so it grows with the text.

Fingerprints are matched by position: two texts agree where two anchors follow one another at the same distance in both.
Likeness is the Jaccard index of these links.

Defined results: null or empty text, or one of white space, has the empty fingerprint; a text of fewer than SHORT + 1
tokens has all its pairs of tokens as anchors, or its only token; two empty fingerprints are wholly alike, an empty and another not at
all; a text of any length is used whole; rows of one doc_id follow their text's hash; null doc_ids come last; a lone
document is its own next; columns of other names are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, spread

TOKEN = r"[^\x20\x09-\x0D]{1,4}"
#: Tokens of a k-mer; its substrings have two.
KMER = 8
INNER = KMER - 1
#: Pairs of tokens below which a text is short: all its pairs are anchors.
SHORT = 3 * KMER
#: Bits of an anchor's hash; with its distance an anchor has nine hexadecimal digits.
BITS = 32
#: Input of a range of doc_id; ranges there are at most, as the driver knows their ends; beyond, ranges grow.
MB, MOST_RANGES = 2.0, 65_536


def bound(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda's variable is not computed again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def short_hash(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - BITS)


def anchors(text: Column) -> Column:
    """All anchors of a text in their order, as array<long>: distance from the one before, then BITS of hash."""

    def chosen(g: Column) -> Column:
        """(place, hash) of the k-mers whose smallest pair of tokens is their first or last; g: hashes of the pairs."""

        def one(x: Column, i: Column) -> Column:
            z = F.get(g, i + INNER - 1)
            inside = F.least(*[F.get(g, i + k) for k in range(1, INNER - 1)])
            edge = (x <= F.least(inside, z)) | (z <= F.least(inside, x))
            return F.when(edge, F.struct(i.alias("p"), short_hash(*[F.get(g, i + k) for k in range(0, INNER, 2)]).alias("h")))

        return F.filter(F.transform(F.slice(g, 1, F.greatest(F.size(g) - INNER + 1, F.lit(0))), one), lambda x: x.isNotNull())

    def spaced(a: Column) -> Column:
        step = lambda x, i: F.when(i == 0, x["p"]).otherwise(x["p"] - F.get(a, i - 1)["p"])
        return F.transform(a, lambda x, i: F.least(step(x, i), F.lit(15)).cast("long") * (1 << BITS) + x["h"])

    def of_pairs(g: Column) -> Column:
        every = F.transform(g, lambda x, i: F.struct(i.alias("p"), short_hash(x).alias("h")))
        return bound(F.when(F.size(g) >= SHORT, chosen(g)).otherwise(every), spaced)

    def of_tokens(t: Column) -> Column:
        n = F.size(t)
        pairs = F.zip_with(F.slice(t, 1, F.greatest(n - 1, F.lit(0))), F.slice(t, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        return F.when(n >= 2, bound(pairs, of_pairs)).otherwise(F.transform(t, lambda x: short_hash(x)))

    return bound(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), of_tokens)


def as_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 1 + BITS // 4, "0"))), "")


def links(a: Column) -> Column:
    """Of anchors, each two that follow one another with their distance; a lone anchor stands for itself."""
    n = F.size(a)
    tail = F.slice(a, 2, F.greatest(n - 1, F.lit(0)))
    both = F.zip_with(F.slice(a, 1, F.greatest(n - 1, F.lit(0))), tail, lambda x, y: F.xxhash64(x.bitwiseAND((1 << BITS) - 1), y))
    return F.when(n >= 2, both).otherwise(a)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two texts' links."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(every, F.lit(1)))


def place_key() -> Column:
    """Orders documents by descending doc_id, nulls last, then by their text's hash."""
    return F.struct(F.col("doc_id").isNull().cast("int").alias("o"), F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long"))).alias("i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))


def with_next(docs: DataFrame, add=None, ranges: int | None = None) -> DataFrame:
    """doc_id, text -> also next_<column> of the document that follows in descending doc_id; the last's is the first.

    Documents are dealt to ranges of (doc_id, hash of the text), cut by Spark's range partitioning of these keys alone, so
    neither a dense stretch of ids nor an id that many rows have makes a range large. Each range gets the head of the one
    that follows as one more row, so no row has to be looked up across ranges. add: columns computed for each row once it
    is in its range.
    """
    n = ranges or min(spread(docs, MB), MOST_RANGES)
    heads = docs.select(place_key().alias("k")).repartitionByRange(n, "k").groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k"))
    heads = sorted((r.k.o, r.k.i, r.k.h) for r in heads.collect())  # at most MOST_RANGES
    spark = docs.sparkSession
    step = max(1, math.isqrt(len(heads)))
    kind = "struct<o:int,i:long,h:long>"
    coarse = [heads[k] for k in range(0, len(heads), step)]
    fine = spark.createDataFrame([(k, heads[k * step : (k + 1) * step]) for k in range(len(coarse))], f"_c int, _fine array<{kind}>")
    tops = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(i).cast("long").alias("i"), F.lit(h).cast("long").alias("h")) for o, i, h in coarse]).cast(f"array<{kind}>")
    rows = docs.withColumn("_k", place_key())
    rows = rows.withColumn("_c", F.size(F.filter(tops, lambda b: b <= F.col("_k"))) - 1)
    rows = rows.join(F.broadcast(fine), "_c")  # as many keys as there are ranges
    rows = rows.withColumn("_range", (F.col("_c") * step + F.size(F.filter("_fine", lambda b: b <= F.col("_k"))) - 1).cast("long"))
    rows = rows.select(*docs.columns, "_k", "_range", F.lit(0).alias("_flag"))

    moves = [(o, i, h, (k - 1) % len(heads)) for k, (o, i, h) in enumerate(heads)]
    moves = spark.createDataFrame(moves, "_o int, _i long, _h long, _to long")
    keyed = docs.withColumn("_k", place_key())
    on = (F.col("_k.o") == F.col("_o")) & (F.col("_k.i") == F.col("_i")) & (F.col("_k.h") == F.col("_h"))
    extra = keyed.join(F.broadcast(moves), on).dropDuplicates(["_to"])  # a row for each range
    extra = extra.select(*docs.columns, "_k", F.col("_to").alias("_range"), F.lit(1).alias("_flag"))
    order = ["_flag", "_k"]
    both = rows.unionByName(extra).repartition("_range").sortWithinPartitions("_range", *order)
    both = both.withColumns(add or {})
    names = [c for c in both.columns if c not in ("_k", "_range", "_flag")]
    window = Window.partitionBy("_range").orderBy(*order)
    both = both.withColumns({f"next_{c}": F.lead(c).over(window) for c in names})
    return both.filter("_flag = 0").drop("_k", "_range", "_flag")


def op7_syncmers(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how alike they and the next document's are."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", text="string")
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return edited_rows(with_next(docs, {"fp": anchors(F.col("text"))}))


def edited_rows(rows: DataFrame) -> DataFrame:
    """Each text's last third replaced by the first characters of the next text, fingerprinted and compared."""
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    rows = rows.withColumns({"edited_sha256": F.sha2("edited", 256), "edited_fp": anchors(F.col("edited"))}).drop("edited")
    rows = rows.withColumns({"own": links(F.col("fp")), "new": links(F.col("edited_fp")), "other": links(F.col("next_fp"))})
    near = likeness(F.col("own"), F.col("new")), likeness(F.col("own"), F.col("other"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"), near[0].alias("near_edited"), near[1].alias("near_next"))
