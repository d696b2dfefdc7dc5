"""Nearest neighbours by shifted Hilbert curves.

Vectors are projected several times, each projection is shifted and laid on a Hilbert curve, and Spark sorts each curve's
keys by range, which gives every vector its place on every curve. A query looks at the vectors within a window of places
either side of its own on each curve; what the windows of all curves find is merged and ranked by the true inner product.
Largest inner product becomes nearness by one more coordinate that brings all vectors to equal length.

The window is fitted on a bounded sample of queries, SAMPLE for each length of vector, whose true neighbours are found by
comparing them with all vectors: it is the smallest that holds a share RECALL of those neighbours on at least one curve.
Vectors with structure need narrow windows; on vectors without any (as in the test tables) the windows must be wide, and
the README says how much is then looked at. exact=True opens the windows to the whole curve.

Both sides of a window are cut into blocks of BLOCK places, so no group grows with the table or with the window.

Defined results: vectors that are null, empty, zero or hold a null or a non-finite component take no part, nor do rows
without vec_id; of several rows of one vec_id that of the smallest bytes counts; vectors of unlike length are never
compared; very long vectors are projected like any other; equal scores go by vec_id; columns of other names are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pick, release

NEAREST = 20
CURVES = 12
#: Coordinates of a projection and bits of each.
AXES, DEPTH = 6, 9
#: Share of the sample's true neighbours that the windows must hold, and queries of the sample.
RECALL, SAMPLE = 0.94, 256
#: Places of a curve in a block, and keys that one task sorts.
BLOCK, SORTED = 16_384, 1_000_000


def hilbert_key(x: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Places on the Hilbert curve of points given by non-negative integers below 2**depth, a row each (Skilling 2004)."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (depth - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (depth - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(depth - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray, longest: float, curve: int) -> np.ndarray:
    """Keys of vectors on one curve: lifted to equal length, projected, shifted, laid out."""
    dim = vectors.shape[1]
    lift = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
    full = np.hstack([vectors, lift[:, None]]) / longest
    rng = np.random.default_rng([dim, curve])
    axes = min(AXES, dim + 1)
    turn, _ = np.linalg.qr(rng.standard_normal((dim + 1, axes)))
    spread = 3.0 / math.sqrt(dim + 1)  # most coordinates of a projection are this small
    at = (full @ turn) / spread + rng.uniform(0, 0.4, axes)
    cells = np.clip((at + 1) / 2.4 * (1 << DEPTH), 0, (1 << DEPTH) - 1)
    return hilbert_key(cells)


def packed(vector: np.ndarray) -> bytes:
    """As floats where that loses nothing, else as doubles."""
    short = vector.astype(np.float32)
    return (short if (short == vector).all() else vector).tobytes()


def stacked(values, dim: int) -> np.ndarray:
    """Packed vectors of one length as a matrix of doubles."""
    out = np.zeros((len(values), dim))
    for kind in (np.float32, np.float64):
        at = [i for i, v in enumerate(values) if len(v) == dim * np.dtype(kind).itemsize]
        if at:
            out[at] = np.frombuffer(b"".join(values[i] for i in at), kind).reshape(-1, dim)
    return out


def usable(embeddings: DataFrame, is_query) -> DataFrame:
    """vec_id, embedding -> vec_id, dim, v, norm, asks: the vectors that take part."""
    rows = embeddings.filter("vec_id IS NOT NULL AND size(embedding) > 0").filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            flat = np.asarray(lists.flatten(), dtype=np.float64)
            ends = np.cumsum([0, *lists.value_lengths().to_pylist()])
            parts = [flat[a:b] for a, b in zip(ends, ends[1:])]
            norms = [float(np.linalg.norm(x)) for x in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int32()), pa.array([packed(x) for x in parts], pa.binary()), pa.array(norms, pa.float64())], ["vec_id", "dim", "v", "norm"])

    out = rows.select("vec_id", "embedding").mapInArrow(run, "vec_id long, dim int, v binary, norm double")
    out = out.groupBy("vec_id").agg(F.min(F.struct("v", "dim", "norm")).alias("m")).select("vec_id", "m.dim", "m.v", "m.norm")
    return out.withColumn("asks", F.coalesce(is_query, F.lit(False)))


def best(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, nearest: int, seen=None):
    """(query row, candidate rows, scores) of each query's best candidates; seen: of some queries' rows, which x they see."""
    for at in range(0, len(q), 64):
        lo, hi, mask = seen(at, min(at + 64, len(q))) if seen else (0, len(x), None)
        rough = q[at : at + 64] @ x[lo:hi].T
        if mask is not None:
            rough[~mask] = -np.inf
        for k, row in enumerate(rough, at):
            row[ids[lo:hi] == own[k]] = -np.inf
            least = -np.inf
            if len(row) > nearest:
                slack = 1e-9 * max(1.0, float(np.abs(row[np.isfinite(row)]).max(initial=0)))
                least = np.partition(row, len(row) - nearest)[len(row) - nearest] - slack
            near = np.flatnonzero((row >= least) & (row > -np.inf)) + lo
            scores = (x[near] * q[k]).sum(axis=1)  # the same sum for equal vectors, wherever they stand
            order = np.lexsort((ids[near], -scores))[:nearest]
            yield k, near[order], scores[order]


FOUND = "query_id long, vec_id long, score double"


def found_frame(own: np.ndarray, ids: np.ndarray, results) -> pd.DataFrame:
    out = {"query_id": [np.zeros(0, np.int64)], "vec_id": [np.zeros(0, np.int64)], "score": [np.zeros(0)]}
    for k, near, scores in results:
        out["query_id"].append(np.full(len(near), own[k]))
        out["vec_id"].append(ids[near])
        out["score"].append(scores)
    return pd.DataFrame({k: np.concatenate(v) for k, v in out.items()})


def ranked(found: DataFrame, nearest: int) -> DataFrame:
    ranks = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= nearest)


def places(rows: DataFrame, curves: int) -> DataFrame:
    """usable() vectors -> also places: a vector's place on each curve, from 0."""
    longest = {r.dim: (r.m, r.n) for r in rows.groupBy("dim").agg(F.max("norm").alias("m"), F.count("*").alias("n")).collect()}  # a row for each length of vector

    def keys(frames):
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                x, ids = stacked(part["v"].tolist(), dim), part["vec_id"].to_numpy()
                for c in range(curves):
                    yield pd.DataFrame({"dim": np.full(len(ids), dim, np.int32), "curve": np.full(len(ids), c, np.int32), "key": curve_keys(x, longest[dim][0], c), "vec_id": ids})

    order = ["dim", "curve", "key", "vec_id"]
    keyed = materialize(rows.select("vec_id", "dim", "v").mapInPandas(keys, "dim int, curve int, key long, vec_id long"), "hilbert-keys")
    parts = max(1, math.ceil(sum(n for _, n in longest.values()) * curves / SORTED))

    def number(frames):
        """Counts the rows of each curve in this range of keys."""
        upto: dict = {}
        part = TaskContext.get().partitionId()
        for frame in frames:
            at = frame.groupby(["dim", "curve"]).cumcount()
            before = [upto.get(k, 0) for k in zip(frame["dim"], frame["curve"])]
            for k, n in frame.groupby(["dim", "curve"]).size().items():
                upto[k] = upto.get(k, 0) + int(n)
            yield pd.DataFrame({"dim": frame["dim"], "curve": frame["curve"], "part": np.int32(part), "at": at.to_numpy() + np.array(before, np.int64), "vec_id": frame["vec_id"]})

    inside = materialize(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(number, "dim int, curve int, part int, at long, vec_id long"), "hilbert-numbers")
    release(keyed)
    before = Window.partitionBy("dim", "curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = inside.groupBy("dim", "curve", "part").agg(F.count("*").alias("n"))  # a row for each curve and range
    starts = starts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    of = inside.join(starts, ["dim", "curve", "part"]).groupBy("vec_id").agg(*[F.max(F.when(F.col("curve") == c, F.col("at") + F.col("start"))).alias(f"p{c}") for c in range(curves)])
    out = rows.join(of, "vec_id").select("vec_id", "dim", "v", "asks", F.array(*[f"p{c}" for c in range(curves)]).alias("places"))
    out = materialize(out, "hilbert-places")
    release(inside)
    return out


def fitted_widths(placed: DataFrame, nearest: int, recall: float, sample: int) -> dict[int, int]:
    """By length of vector: places either side that hold a share recall of the sample's true neighbours on some curve."""
    by_hash = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id")
    asked = placed.filter("asks").withColumn("k", F.row_number().over(by_hash)).filter(F.col("k") <= sample).select("vec_id", "dim", "v", "places").collect()
    by_dim: dict = {}
    for r in asked:
        by_dim.setdefault(r.dim, []).append((r.vec_id, bytes(r.v)))
    spark = placed.sparkSession
    held = spark.sparkContext.broadcast({d: (np.array([i for i, _ in rows]), stacked([v for _, v in rows], d)) for d, rows in by_dim.items()})  # sample queries a length

    def truth(frames):
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                if dim in held.value:
                    own, q = held.value[dim]
                    ids = part["vec_id"].to_numpy()
                    yield found_frame(own, ids, best(q, own, stacked(part["v"].tolist(), dim), ids, nearest))

    true = ranked(placed.select("vec_id", "dim", "v").mapInPandas(truth, FOUND), nearest).select("query_id", "vec_id")
    mine = spark.createDataFrame([(r.vec_id, r.places) for r in asked], "query_id long, own array<long>")
    apart = F.array_min(F.zip_with("places", "own", lambda a, b: F.abs(a - b)))
    # nearest rows for each query of the sample
    rows = placed.select("vec_id", "dim", "places").join(F.broadcast(true.join(mine, "query_id")), "vec_id").select("dim", apart.alias("apart")).collect()
    apart_of: dict = {d: [] for d in by_dim}
    for r in rows:
        apart_of[r.dim].append(r.apart)
    return {d: max(nearest, int(np.quantile(x, recall, method="higher"))) if x else nearest for d, x in apart_of.items()}


def nearest_neighbours(embeddings: DataFrame, is_query, nearest: int = NEAREST, curves: int = CURVES, recall: float = RECALL, sample: int = SAMPLE, block: int = BLOCK, exact: bool = False) -> DataFrame:
    """vec_id, embedding -> query_id, rank, vec_id, score; is_query: a condition on vec_id."""
    rows = materialize(usable(embeddings, is_query), "hilbert-vectors")
    placed = places(rows, curves)
    release(rows)
    if exact:
        widths = {r.dim: r.n for r in placed.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    else:
        widths = fitted_widths(placed, nearest, recall, sample)
    out = ranked(window_search(placed, widths, nearest, 1 if exact else curves, block), nearest)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def window_search(placed: DataFrame, widths: dict[int, int], nearest: int, curves: int, block: int) -> DataFrame:
    """Each query's best in its window of each curve: query_id, vec_id, score."""
    width = F.element_at(F.create_map(*[F.lit(x) for d, w in widths.items() for x in (d, int(w))]), F.col("dim")) if widths else F.lit(None).cast("int")
    cells = placed.withColumn("w", width).filter("w IS NOT NULL").withColumn("places", F.slice("places", 1, curves))
    cells = cells.select("vec_id", "dim", "v", "asks", "w", F.posexplode("places").alias("curve", "at")).withColumn("b", F.floor(F.col("at") / block))
    others = F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col("at") - F.col("w")) / block), F.floor((F.col("at") + F.col("w")) / block)))
    among = cells.select("dim", "curve", others.alias("bq"), F.col("b").alias("bx"), "vec_id", "at", "v")
    asked = cells.filter("asks").select(F.col("dim").alias("q_dim"), F.col("curve").alias("q_curve"), F.col("b").alias("q_bq"), others.alias("q_bx"), F.col("vec_id").alias("query_id"), "at", "v")

    def search(queries: pd.DataFrame, among: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(among):
            return found_frame(np.zeros(0, np.int64), np.zeros(0, np.int64), [])
        dim = int(among["dim"].iloc[0])
        w = widths[dim]
        queries, among = queries.sort_values("at"), among.sort_values("at")
        q_at, x_at = queries["at"].to_numpy(), among["at"].to_numpy()
        own, ids = queries["query_id"].to_numpy(), among["vec_id"].to_numpy()

        def seen(a, b):
            lo, hi = np.searchsorted(x_at, q_at[a] - w), np.searchsorted(x_at, q_at[b - 1] + w, side="right")
            return lo, hi, np.abs(x_at[None, lo:hi] - q_at[a:b, None]) <= w

        return found_frame(own, ids, best(stacked(queries["v"].tolist(), dim), own, stacked(among["v"].tolist(), dim), ids, nearest, seen))

    return asked.groupBy("q_dim", "q_curve", "q_bq", "q_bx").cogroup(among.groupBy("dim", "curve", "bq", "bx")).applyInPandas(search, FOUND)


def op5_hilbert(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    rows = pick(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), vec_id="long", embedding="array<double>")
    return nearest_neighbours(rows, F.col("vec_id") % 20 == 0)
