"""Mixing sources to target weights along a time-varying curriculum.

Sizes are summed by (source, hash bucket); a window over that small table gives every bucket its offset in its source,
and a window inside a bucket gives every document its place on its source's token axis. A source that holds a third of
all rows is thereby dealt over all its buckets. Each source's weight schedule is integrated over training time, and the
inverse of that integral turns a place on the token axis into a training position.

Defined results: null source is a source of its own, last in order; null text has size 0; a document of size 0 takes no
words and keeps one copy; null doc_ids are dealt by size; of equal hashes the smaller doc_id, then size, goes first; a text
of any length counts whole, and may be the one that its source takes in part; repeated rows are each mixed as a row;
columns of other names are ignored or, in mix_documents, kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pick, spread, tidy, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Slope of each source's weight over training time, in the same order: below 0 early, above 0 late; -1 to 1.
SLOPES = (-0.5, 0.0, 0.5)
CAP = 3.0
#: Buckets at least; more where a bucket would hold over MB of the input.
BUCKETS, MB = 1024, 64.0


def targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, cap: float = CAP) -> DataFrame:
    """source, source_size -> rank, weight, slope, target. One row a source goes in and out.

    The excess of capped sources is reshared by weight until none is above its cap: sorted by cap / weight the capped
    sources come first, so one pass of prefix sums finds the common level.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)

    def cycle(values) -> Column:
        return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("rank") % len(values)).cast("int") + 1)

    most = F.col("source_size") * F.lit(float(cap))
    every = Window.partitionBy()
    by_level = Window.orderBy(F.col("_cap") / F.col("weight"), "rank")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = ranked.withColumns({"weight": cycle(weights), "slope": cycle(slopes), "_cap": most})
    out = out.withColumns({"_all": F.sum("source_size").over(every), "_used": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), "_w": F.sum("weight").over(rest)})
    out = out.withColumn("_level", (F.col("_all") - F.col("_used")) / F.col("_w"))
    open_level = F.when(F.col("_level") <= F.col("_cap") / F.col("weight"), F.struct((F.col("_cap") / F.col("weight")).alias("at"), F.col("rank"), F.col("_level").alias("level")))
    out = out.withColumn("_open", F.min(open_level).over(every))
    target = F.least(F.coalesce(F.col("_open.level") * F.col("weight"), F.col("_cap")), F.col("_cap"))
    return out.select("source", "rank", "source_size", "slope", target.alias("target"))


def position(q: Column, slope: Column) -> Column:
    """Inverse of t + slope * (t * t - t), the integral of a linear schedule 1 + slope * (2 t - 1) from 0 to t."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * q)
    return F.when(F.abs(slope) < 1e-9, q).otherwise((root - (1 - slope)) / (2 * slope))


def mix_plan(items: DataFrame, weights=WEIGHTS, slopes=SLOPES, cap: float = CAP, seed: int = 17) -> DataFrame:
    """doc_id, source, size -> also source_size, target, taken, copies, part, position.

    copies: whole copies the mix takes; part: words of one more, cut copy, at most one document a source has such;
    taken: words of both; position: of the first copy in training time, 0 to 1, null where nothing is taken.
    """
    extra_key = [F.col("k_size")] if "k_size" in items.columns else []
    keyed = items.select("doc_id", "source", "size", *extra_key, F.xxhash64(F.coalesce(F.col("doc_id"), -F.col("size")), F.lit(seed)).alias("_h"))
    keyed = materialize(keyed.withColumn("_b", F.pmod("_h", F.lit(spread(items, MB, BUCKETS))).cast("int")), "mix-items")
    sums = materialize(keyed.groupBy("source", "_b").agg(F.sum("size").alias("_n")), "mix-sums")
    aims = targets(sums.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, slopes, cap)
    earlier = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("o").join(aims.alias("a"), F.col("o.source").eqNullSafe(F.col("a.source")))
    offsets = offsets.select(F.col("o.source").alias("_source"), F.col("_b").alias("_bucket"), "_offset", "source_size", "slope", "target")
    # each (source, bucket) of the items has exactly one row in offsets, so the join keeps every row
    rows = keyed.join(offsets, keyed["source"].eqNullSafe(offsets["_source"]) & (keyed["_b"] == offsets["_bucket"]))
    inside = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_from", F.col("_offset") + F.sum("size").over(inside) - F.col("size"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    full = F.floor(ratio + F.lit(1e-12)).cast("long")
    spare = F.greatest(F.lit(0), F.round(F.col("target") - full * F.col("source_size"))).cast("long")
    rows = rows.withColumns({"_full": full, "_spare": spare})
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_spare") - F.col("_from")))
    rows = rows.withColumn("_extra", extra)
    whole = (F.col("size") > 0) & (F.col("_extra") == F.col("size"))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("_full") + whole.cast("long")).cast("int")
    rows = rows.withColumns({"copies": copies, "part": F.when(whole, F.lit(0)).otherwise(F.col("_extra")).cast("long"), "taken": F.col("_full") * F.col("size") + F.col("_extra")})
    share = F.when(F.col("target") > 0, F.least(F.lit(1.0), F.col("_from") / F.col("target"))).otherwise(F.lit(0.0))
    first = F.when(F.col("copies") + F.col("part") > 0, position(share, F.col("slope")))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "part", first.alias("position"), "slope", "_from", *extra_key)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with one row for every whole copy the mix takes, columns as they came, ranged by training position.

    Rows of equal doc_id, source and size are mixed as one item of their joint size, so each gets as many copies. A cut
    copy counts here as a copy if at least half of it is taken.
    """
    tidy(docs.sparkSession)  # every text is about to be shuffled twice: make room first
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    at = {n.lower(): i for i, n in reversed(list(enumerate(names)))}
    at |= {n: i for i, n in reversed(list(enumerate(names)))}
    if "doc_id" not in at or "text" not in at:
        raise ValueError("documents need doc_id and text")
    source = (F.col(f"c{at['source']}") if "source" in at else F.lit(None)).cast("string")
    size = word_count(F.col(f"c{at['text']}").cast("string"))
    rows = docs.toDF(*inner).select("*", F.col(f"c{at['doc_id']}").cast("long").alias("k_id"), source.alias("k_source"), size.alias("k_size"))
    items = rows.groupBy("k_id", "k_source", "k_size").agg(F.count("*").alias("m"))
    plan = mix_plan(items.select(F.col("k_id").alias("doc_id"), F.col("k_source").alias("source"), (F.col("k_size") * F.col("m")).alias("size"), "k_size"), **options)
    n = F.col("copies") + F.when(F.col("part") * 2 >= F.greatest(F.col("size"), F.lit(1)), 1).otherwise(0)
    plan = plan.select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("k_size").alias("p_size"), n.cast("int").alias("n"), "slope", "target", "source_size", "_from").filter("n > 0")
    on = F.col("k_id").eqNullSafe(F.col("p_id")) & F.col("k_source").eqNullSafe(F.col("p_source")) & (F.col("k_size") == F.col("p_size"))
    share = F.when(F.col("target") > 0, F.least(F.lit(1.0), (F.col("_from") + F.col("j") * F.col("source_size")) / F.col("target"))).otherwise(F.lit(0.0))
    out = rows.join(plan, on).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    out = out.withColumn("t", position(share, F.col("slope")))
    return out.orderBy("t", "k_id", "j").select(*[F.col(c).alias(n) for c, n in zip(inner, names)])


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words the mix takes of it, by training position."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", source="string", text="string")
    plan = mix_plan(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", "part", "position").orderBy("position", "doc_id")
