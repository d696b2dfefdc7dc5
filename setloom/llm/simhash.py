"""SimHash near-duplicates by a binary trie self-join.

Fingerprints within k differing bits agree wholly on at least one of k + 1 bit blocks, so distinct fingerprints are
dealt by (block, value of the block). Inside a bucket the trie over the fingerprints is joined with itself: node pairs
go down together, differing bits add up, and a pair is dropped once it has more than k. A bucket above LIMIT is dealt
anew by blocks of its remaining bits, again and again, which loses no link. A bucket yields a spanning forest, never all
its pairs; components of the forests come from alternating large-star and small-star steps.

near_duplicates() and op4 link by that alone. keep_one(), the filter of a corpus, also takes texts whose sets of runs of
five words have a Jaccard index of 0.8 or more. Such sets share one of their first runs in any fixed order of all runs
(prefix filter), so texts are dealt by those; of buckets with the very same texts one stays. A bucket's text with the fewest
runs of its own before the common one is compared with all others first, as edited copies are alike to the text they
were made from; then neighbours that are not yet connected, then all pairs that are still not connected. Every step before the
comparison drops only what cannot be alike, so no link is lost.

Defined results: null or empty text has fingerprint zero and is linked like any other; null doc_ids never name a
component unless they are all it has; repeated rows are rows of one component; a text of any length counts whole; of rows
that could stay the one of the smallest doc_id does; extra columns are ignored or, in keep_one, kept; an empty table gives
an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick, release

SHINGLE = 3
BITS = 2
SEED = 42
#: Distinct fingerprints a bucket may hold before it is dealt anew.
LIMIT = 20_000
#: The filter of a corpus: words in a run, likeness of the sets of runs.
RUN, ALIKE = 5, 0.8
#: Runs that more texts than this have among their first ones come last in the order of runs.
HOT = 200
#: So many of these at most: the most frequent, as the driver sends them to all tasks.
MOST_HOT = 1 << 20
#: Runs a bin holds on average, in the counts by which pairs are sifted; pairs looked at at a time.
BIN, BLOCK = 4, 1 << 20
#: Rounds in which further hot runs are looked for in the texts that hold some, while there are new ones in so many times HOT.
ROUNDS, FURTHER = 8, 4
#: Orders in which a bucket is compared, its centre with all and then neighbours, before all its pairs are.
CHAINS = 2
#: Rows whose trie joins one task runs at a time.
CHUNK = 200_000
#: Bits at most, and for each node, of the bitmaps by which texts of some nodes are picked where they are read.
MOST_MARKS, MARKS = 1 << 26, 16

ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()


def majority(hashes: list[int]) -> int:
    """64 bits, each 1 if set in over half the hashes; as a signed integer."""
    total, half = np.zeros(64, np.int64), len(hashes) / 2
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((total > half).astype(np.uint8), bitorder="little").view("<i8")[0])


def shingle_hashes(words: list[bytes], shingle: int) -> list[int]:
    """Of all runs of so many words, joined by spaces; of fewer words, of the whole; of none, nothing."""
    joined, n, digest = b" ".join(words), len(words), xxhash.xxh64_intdigest
    if n <= shingle:
        return [digest(joined, SEED)] if n else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - shingle] + 1)).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(words_of(text), shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text -> doc_id, fp long."""

    def run(batches):
        for batch in batches:
            fps = pa.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), fps], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def trie_forest(bucket: np.ndarray, fps: np.ndarray, errors: int) -> np.ndarray:
    """For rows sorted by (bucket, fp as unsigned), fps distinct in a bucket: the index of each row's root.

    All buckets' tries go down together, a bit a level. A node is a range of rows; a pair of nodes is [a0, a1), [b0, b1)
    and its differing bits so far.
    """
    n = len(fps)
    root = np.arange(n)
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    lo, hi = edge[:-1], edge[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    fps = fps.astype(np.uint64)

    def hook(i, j):
        while len(i):
            ri, rj = root[i], root[j]
            low = np.minimum(ri, rj)
            np.minimum.at(root, ri, low)
            np.minimum.at(root, rj, low)
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root[:] = up
            open_ = root[i] != root[j]
            i, j = i[open_], j[open_]

    def split(level, *ranges):
        """First row of each range whose bit at this level is 1; the rows of a range share all bits above."""
        ones = np.concatenate(([0], np.cumsum((fps >> np.uint64(63 - level)) & np.uint64(1)).astype(np.int64)))
        return [x1 - (ones[x1] - ones[x0]) for x0, x1 in ranges]

    stack = [(0, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        level, a0, a1, b0, b1, err = stack.pop()
        if not len(a0):
            continue
        if len(a0) > 1 << 20:  # bounded memory: one half after the other
            m = len(a0) // 2
            stack.append((level, *(x[m:] for x in (a0, a1, b0, b1, err))))
            stack.append((level, *(x[:m] for x in (a0, a1, b0, b1, err))))
            continue
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            apart = np.bitwise_count(fps[i] ^ fps[j]).astype(np.int64)
            near = (apart <= errors) & (i != j)
            i, j = i[near], j[near]
            hook(i, j)
            a0, a1, b0, b1, err = (x[~leaf] for x in (a0, a1, b0, b1, err))
        if not len(a0) or level > 63:
            continue
        am, bm = split(level, (a0, a1), (b0, b1))
        same = (a0 == b0) & (a1 == b1)
        kids = [(a0, am, b0, bm, err, None), (am, a1, bm, b1, err, None), (a0, am, bm, b1, err + 1, None), (am, a1, b0, bm, err + 1, ~same)]
        out = []
        for k0, k1, l0, l1, e, only in kids:
            keep = (k1 > k0) & (l1 > l0) & (e <= errors)
            if only is not None:
                keep &= only
            out.append([x[keep] for x in (k0, k1, l0, l1, e)])
        nxt = [np.concatenate(xs) for xs in zip(*out)]
        alone = (nxt[0] == nxt[2]) & (nxt[1] - nxt[0] == 1) & (nxt[3] - nxt[2] == 1)
        stack.append((level + 1, *(x[~alone] for x in nxt)))
    return root


def bit_blocks(n: int, parts: int, at: list[int] | None = None) -> list[list[int]]:
    at = at if at is not None else list(range(n))
    size = -(-len(at) // parts)
    return [b for b in (at[i : i + size] for i in range(0, len(at), size)) if b]


def forests(fps: DataFrame, errors: int = BITS, limit: int = LIMIT) -> DataFrame:
    """Distinct fps (fp, id) -> edges (a, b) of ids, a < b, that connect what lies within errors bits."""

    def masks(blocks):
        return [sum(1 << b for b in block) for block in blocks]

    def signed(mask):
        return mask - (1 << 64) if mask >> 63 else mask

    def dealt(rows, blocks, path):
        """Rows with their key for each block; path: the key so far."""
        keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("v")) for k, m in enumerate(masks(blocks))])
        out = rows.withColumn("_d", F.explode(keys))
        return out.withColumn("path", F.xxhash64(F.col(path) if path else F.lit(0), "_d.k", "_d.v")).withColumn("block", F.col("_d.k")).drop("_d")

    def run(batches):
        def done(parts):
            table = pa.Table.from_batches(parts)
            bucket, fp, ids = (table.column(c).to_numpy() for c in ("path", "fp", "id"))
            fp = fp.view(np.uint64)
            order = np.lexsort((fp, bucket))
            bucket, fp, ids = bucket[order], fp[order], ids[order]
            root = trie_forest(bucket, fp, errors)
            far = np.flatnonzero(root != np.arange(len(root)))
            a, b = ids[far], ids[root[far]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        held, n = [], 0
        for batch in batches:  # sorted by path, so a bucket is cut only where held ends
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                table = pa.Table.from_batches(held).combine_chunks()
                path = table.column("path").to_numpy()
                cut = int(np.searchsorted(path, path[-1]))
                if cut:
                    yield done(table.slice(0, cut).to_batches())
                    table = table.slice(cut)
                held, n = table.to_batches(), table.num_rows
        if n:
            yield done(held)

    blocks = bit_blocks(64, errors + 1)
    level = materialize(dealt(fps, blocks, None), "simhash-level")
    used = {k: block for k, block in enumerate(blocks)}
    found = None
    depth = 0
    while True:
        sizes = level.groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
        hot = materialize(sizes.select(F.col("path").alias("hot")), "simhash-hot") if depth < 3 else None
        if hot is not None and hot.isEmpty():
            hot = None
        small = level if hot is None else level.join(hot, level["path"] == hot["hot"], "left_anti")
        edges = small.select("path", "fp", "id").repartition("path").sortWithinPartitions("path").mapInArrow(run, "a long, b long")
        found = edges if found is None else found.unionByName(edges)
        if hot is None:
            return found
        # a hot bucket shares its block's bits: deal it anew by blocks of the bits that are left
        big = level.join(hot, level["path"] == hot["hot"], "left_semi")
        parts, named = [], {}
        for k, block in used.items():
            left = [b for b in range(64) if b not in block]
            finer = bit_blocks(64, errors + 1, left)
            rows = big.filter(F.col("block") == k).select("fp", "id", "path")
            for j, sub in enumerate(finer):
                named[k * (errors + 1) + j] = block + sub
            out = dealt(rows.withColumnRenamed("path", "old"), finer, "old").drop("old")
            parts.append(out.withColumn("block", F.lit(k * (errors + 1)) + F.col("block")))
        nxt = parts[0]
        for p in parts[1:]:
            nxt = nxt.unionByName(p)
        level, used, depth = materialize(nxt, "simhash-level"), named, depth + 1


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (id, root): the smallest id each id reaches. Ids without an edge do not appear.

    Alternating large-star and small-star steps; each is one grouped pass over the edges, and the edges shrink to stars.
    """

    def stars(frame: DataFrame) -> bool:
        """Has no node two parents, or a parent and a child? A step would leave such edges as they are."""
        ends = frame.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(frame.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty()

    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    while not stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "cc-large")
        release(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("w")), F.struct(F.col("v").alias("u"), F.col("m").alias("w")))).alias("e"))
        small = small.select(F.col("e.u").alias("u"), F.col("e.w").alias("v")).filter("u <> v").distinct()
        small = materialize(small, "cc-small")
        release(large)
        edges = small
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()


def near_duplicates(docs: DataFrame, errors: int = BITS, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """doc_id, text -> doc_id, fp long, component_id long; a row for each row of docs."""
    rows = materialize(fingerprints(docs, shingle), "simhash-fp")
    reps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "simhash-reps")
    roots = components(forests(reps.filter("id IS NOT NULL").select("fp", "id"), errors, limit))
    named = reps.join(roots, "id", "left").select(F.col("fp").alias("r_fp"), F.coalesce("root", "id").alias("component_id"))
    named = materialize(named, "simhash-named")
    return rows.join(named, F.col("fp") == F.col("r_fp")).select("doc_id", "fp", "component_id")


def run_set(text: str | None, run: int = RUN) -> np.ndarray:
    """Hashes of a text's distinct runs of words, ascending."""
    return np.unique(np.array(shingle_hashes(words_of(text), run), np.uint64))


def first_runs(runs: np.ndarray, least: float, hot: np.ndarray | None = None) -> np.ndarray:
    """So many of the runs that a set alike by least shares one; in the order of hashes, hot ones (ascending) last."""
    many = len(runs) - math.ceil(least * len(runs) - 1e-9) + 1 if len(runs) else 0
    if hot is not None and len(runs):
        at = held_in(runs, hot)
        runs = np.concatenate([runs[~at], runs[at]])
    return runs[:many]


def added_runs(runs: np.ndarray, least: float, hot: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """Of a text's runs, ascending: those that become first ones as hot ones come last, and were none while only those before did."""
    first, old = first_runs(runs, least, hot), np.sort(first_runs(runs, least, before))
    return first[~held_in(first, old) & ~held_in(first, hot)]


def held_in(runs: np.ndarray, sorted_runs: np.ndarray) -> np.ndarray:
    if not len(sorted_runs):
        return np.zeros(len(runs), bool)
    return sorted_runs[np.minimum(np.searchsorted(sorted_runs, runs), len(sorted_runs) - 1)] == runs


def bins_of(runs: np.ndarray) -> bytes:
    """Counts of runs by their lowest bits; 255 stands for more."""
    size = 1 << max(6, (len(runs) // BIN).bit_length())
    return np.minimum(np.bincount((runs & np.uint64(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8).tobytes()


def most_alike(x: bytes, nx: int, y: bytes, ny: int) -> float:
    """A bound from above on the Jaccard index of two sets by their bins: they differ at least by what their bins do."""
    x, y = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    size = min(len(x), len(y))
    apart = max(abs(nx - ny), int(np.abs(x.reshape(-1, size).sum(axis=0) - y.reshape(-1, size).sum(axis=0)).sum()))
    return (nx + ny - apart) / (nx + ny + apart)


def jaccard(x: bytes, y: bytes) -> float:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def may_be_alike(n1, at1, n2, at2, least: float):
    """Can sets of n1 and n2 runs be alike if their first common run stands at these places?"""
    both = np.minimum(np.minimum(n1, n2), 1 + np.minimum(n1 - at1 - 1, n2 - at2 - 1))
    return both * (1 + least) >= least * (n1 + n2) - 1e-6


def bucket_pairs(buckets: DataFrame, least: float, chain: int | None) -> DataFrame:
    """bucket: array of (node, n, at, comp) -> distinct pairs (a, b) of different components: the centre with each (chain 0), neighbours in the chain-th order, or all."""

    def run(batches):
        for batch in batches:
            for bucket in batch.column(0):
                node, n, at, comp = (c.to_numpy(zero_copy_only=False) for c in bucket.values.flatten())
                n, at = n.astype(np.int64), at.astype(np.int64)
                with np.errstate(over="ignore"):
                    mixed = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(7 * (chain or 0))
                order = np.argsort(n, kind="stable") if chain is None else np.argsort(mixed.astype(np.uint32), kind="stable")
                node, n, at, comp = node[order], n[order], at[order], comp[order]
                if chain == 0:  # the fewest runs of its own before the common one: of edited copies the least edited
                    ends = [(np.full(len(node), np.lexsort((node, n, at))[0]), np.arange(len(node)))]
                elif chain is not None:
                    ends = [(np.arange(len(node) - 1), np.arange(1, len(node)))]
                else:  # a set's partners that are not smaller follow it, up to a size
                    stop = np.searchsorted(n, n / least + 1e-6, side="right")
                    ends = blocks_of(np.arange(len(node)) + 1, stop)
                for i, j in ends:
                    keep = may_be_alike(n[i], at[i], n[j], at[j], least) & (comp[i] != comp[j])
                    a, b = node[i[keep]], node[j[keep]]
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def blocks_of(start, stop):
        sizes = np.maximum(stop - start, 0)
        low = 0
        while low < len(sizes):
            high = max(low + 1, int(np.searchsorted(np.cumsum(sizes[low:]), BLOCK, side="right")) + low)
            part = sizes[low:high]
            i = np.repeat(np.arange(low, high), part)
            yield i, np.arange(len(i)) - np.repeat(np.cumsum(part) - part, part) + start[i]
            low = high

    return buckets.mapInArrow(run, "a long, b long").distinct()


def compared(pairs: DataFrame, sets: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) of nodes those alike: sifted by bins, then the sets of runs of those left are made and compared."""

    def sides(frame, columns):
        x, y = (frame.select(F.col("node").alias(n), *[F.col(c).alias(n + c) for c in columns]) for n in ("a", "b"))
        return pairs.join(x, "a").join(y, "b")

    def sift(batches):
        for batch in batches:
            keep = [most_alike(*r) >= least - 1e-9 for r in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def runs(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([run_set(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["node", "runs"])

    def full(batches):
        for batch in batches:
            keep = [jaccard(x, y) >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sifted = materialize(sides(sets, ["bins", "n"]).select("a", "b", "abins", "an", "bbins", "bn").mapInArrow(sift, "a long, b long"), "simhash-sifted")
    pairs = sifted
    made = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("e_id")).distinct(), texts)
    made = materialize(made.mapInArrow(runs, "node long, runs binary"), "simhash-runs")
    found = materialize(sides(made, ["runs"]).select("a", "b", "aruns", "bruns").mapInArrow(full, "a long, b long"), "simhash-alike")
    release(sifted, made)
    return found


def marked(nodes: DataFrame):
    """One column of nodes, read twice -> a bitmap of bounded size in which their lowest bits are set, as a broadcast.

    It picks texts where they are read, so no text is shuffled for that. Some nodes that were not asked for pass too.
    """
    bits = min(MOST_MARKS, 1 << max(15, (MARKS * nodes.count()).bit_length()))
    at = nodes.select(F.col(nodes.columns[0]).bitwiseAND(F.lit(bits - 1)).alias("at"))
    pages = at.select(F.shiftright("at", 15).alias("page"), F.col("at").bitwiseAND(F.lit(32767)).alias("bit")).repartition("page")
    out = np.zeros(bits // 8, np.uint8)
    for row in pages.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("b")).collect():  # pages of 4,096 bytes
        out[row.page * 4096 : (row.page + 1) * 4096] = np.frombuffer(row.b, np.uint8)
    return nodes.sparkSession.sparkContext.broadcast(out)


def passing(batches, marks):
    """Of record batches whose first column is a node the rows that are marked, one for each node."""
    done: set = set()
    for batch in batches:
        node = batch.column(0).to_numpy(zero_copy_only=False)
        at = node & np.int64(8 * len(marks.value) - 1)
        here = np.flatnonzero((marks.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
        keep = []
        for i, n in zip(here.tolist(), node[here].tolist()):
            if n not in done:
                done.add(n)
                keep.append(i)
        if keep:
            yield batch.take(pa.array(keep, pa.int64()))


def texts_of(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """asked: one column of nodes -> node, text, each once; of some other nodes too."""
    marks = marked(asked)
    return texts.select("node", "text").mapInArrow(lambda batches: passing(batches, marks), "node long, text string").dropDuplicates(["node"])


def described(texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """node, text -> node, fp, key, n, bins, firsts: all that is known of a text without looking at others. n: its runs; key: of the set of them."""
    kinds = {"node": pa.int64(), "fp": pa.int64(), "key": pa.int64(), "n": pa.int32(), "bins": pa.binary(), "firsts": pa.list_(pa.int64())}

    def one(text):
        r = run_set(text)
        return majority(shingle_hashes(words_of(text), shingle)), xxhash.xxh64_intdigest(r.tobytes()) - (1 << 63), len(r), bins_of(r), first_runs(r, least).view(np.int64)

    def run(batches):
        for batch in batches:
            known: dict = {}
            nodes, rows = batch.column(0).to_pylist(), []
            for node, text in zip(nodes, batch.column(1)):
                if node not in known:
                    known[node] = one(text.as_py())
                rows.append(known[node])
            columns = zip(*rows) if rows else [[] for _ in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, list(kinds.values())[1:]))], list(kinds))

    return texts.select("node", "text").mapInArrow(run, "node long, fp long, key long, n int, bins binary, firsts array<long>")


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """r, count -> r: those of the highest counts, whole powers of two together, as many as fit. counts is materialized."""
    step = F.floor(F.log2("count"))
    least, held = 64, 0
    for row in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():  # 64 rows at most
        held += row.n
        if held > most:
            break
        least = row.step
    out = counts.filter(step >= least).select("r")
    out.written_to = counts.written_to
    return out


def has_hot(lists: pa.Array, hot: np.ndarray) -> np.ndarray:
    """For each list of runs: is one of them hot?"""
    at = held_in(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), hot)
    sums = np.concatenate([[0], np.cumsum(at)])
    ends = np.cumsum(np.fromiter((n or 0 for n in lists.value_lengths().to_pylist()), np.int64, len(lists)))
    return np.diff(sums[ends], prepend=0) > 0


def hot_runs(sets: DataFrame, texts: DataFrame, least: float):
    """node, firsts -> the hot runs, ascending, and the marks of the nodes that have one among their first ones, as broadcasts.

    With some runs moved to the end, others of the same passage become first ones of the texts that share it, so those are
    counted, until hardly any is hot: else a long passage deals its texts to one bucket after all. Only runs that come in
    place of hot ones count there, as all others are first ones of HOT texts at most. A run that has become a first one of a
    text stays one until it is hot, so each is made and counted once: a round reads the texts that a new hot run moves.
    """
    context = texts.sparkSession.sparkContext

    def taken(counts: DataFrame, room: int) -> tuple[np.ndarray, int]:
        """Hot ones of r, count, ascending, and how many nodes the most frequent has."""
        new = np.array([r.r for r in most_frequent(counts, room).toLocalIterator()], np.int64).view(np.uint64)
        return np.sort(new), counts.agg(F.max("count")).first()[0] or 0

    def counted(lists: DataFrame) -> DataFrame:
        return lists.select(F.explode("firsts").alias("r")).groupBy("r").agg(F.count("*").alias("count"))

    counts = materialize(counted(sets).filter(F.col("count") > HOT), "simhash-hot-runs")
    new, most = taken(counts, MOST_HOT)
    release(counts)
    hot, before, moved, added, counts = new, context.broadcast(new[:0]), [], [], None
    for last in [False] * ROUNDS + [True]:
        known, fresh = context.broadcast(np.sort(hot)), context.broadcast(new)

        def touched(batches, fresh=fresh):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(has_hot(batch.column(1), fresh.value)))], ["m_id"])

        lists = sets.select("node", "firsts")
        for a in added:
            lists = lists.unionByName(a)
        moved.append(materialize(lists.mapInArrow(touched, "m_id long"), "simhash-moved"))
        if last or most <= FURTHER * HOT or len(hot) >= MOST_HOT:
            break
        marks = marked(moved[-1])

        def others(batches, known=known, before=before, marks=marks):
            for batch in passing(batches, marks):
                runs = [added_runs(run_set(text.as_py()), least, known.value, before.value).view(np.int64) for text in batch.column(1)]
                rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.list_(pa.int64()))], ["node", "firsts"])
                yield rows.filter(pa.array([len(r) > 0 for r in runs], pa.bool_()))

        anew = texts.select("node", "text").mapInArrow(others, "node long, firsts array<long>").dropDuplicates(["node"])
        added.append(materialize(anew, "simhash-added"))
        every = counted(added[-1])
        if counts is not None:
            every = every.unionByName(counts.filter(F.col("count") <= HOT)).groupBy("r").agg(F.sum("count").alias("count"))
        old, counts = counts, materialize(every, "simhash-counts")
        release(*[] if old is None else [old])
        above = counts.filter(F.col("count") > HOT)
        above.written_to = counts.written_to
        new, most = taken(above, MOST_HOT - len(hot))
        if not len(new):
            break
        hot, before = np.concatenate([hot, new]), known
    nodes = moved[0]
    for m in moved[1:]:
        nodes = nodes.unionByName(m)
    marks = marked(nodes)
    release(*moved, *added, *[] if counts is None else [counts])
    return known, marks


def shared_runs(sets: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """node, n, firsts -> bucket: the nodes that have a run among their first ones, for every run that several have.

    Which runs count as hot changes the order only: any order that all texts share loses no link.

    Many runs are held by the very same nodes; of those the first in the order of runs stays, as it is the first that any
    two of its nodes share there.
    """
    known, marks = hot_runs(sets, texts, least)

    def stay(batches):
        for batch in batches:
            yield batch.filter(pa.array(~has_hot(batch.column(2), known.value)))

    def again(batches):
        for batch in passing(batches, marks):
            runs = [run_set(text.as_py()) for text in batch.column(1)]
            firsts = [first_runs(r, least, known.value).view(np.int64) for r in runs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in runs], pa.int32()), pa.array(firsts, pa.list_(pa.int64()))], ["node", "n", "firsts"])

    # without a hot run among its first ones a text's first runs stay as they are, so one that passes for another gives equal rows
    kind = "node long, n int, firsts array<long>"
    rows = sets.select("node", "n", "firsts").mapInArrow(stay, kind).unionByName(texts.select("node", "text").mapInArrow(again, kind))
    rows = rows.select("node", "n", F.posexplode("firsts").alias("at", "r"))
    # dealt before they are gathered, as rows are half as wide as sets of one; a set, as equal texts of several rows are one node
    members = rows.select("r", "node", "n", "at").repartition("r").groupBy("r").agg(F.collect_set(F.struct("node", "n", "at")).alias("m")).filter(F.size("m") > 1).select(F.sort_array("m").alias("m"))
    one = members.groupBy(F.xxhash64("m.node").alias("of"), F.size("m").alias("size")).agg(F.min_by("m", F.col("m")[0]["at"]).alias("m"))
    return materialize(one.select("m"), "simhash-buckets")


def alike(known: DataFrame, texts: DataFrame, sure: DataFrame, least: float = ALIKE) -> DataFrame:
    """known: described() for each node, released here; edges (a, b) of nodes known to be linked -> edges that with those connect every two alike nodes."""
    # equal sets of runs stand for one another
    one = known.filter("n > 0").groupBy("key").agg(F.min(F.struct("node", "n", "bins", "firsts")).alias("s")).select("key", "s.*")
    one = materialize(one, "simhash-sets")
    sets = one.select("node", "n", "bins", "firsts")
    same = known.filter("n > 0").select("key", F.col("node").alias("b")).join(one.select("key", F.col("node").alias("a")), "key").filter("a <> b").select("a", "b")
    same = materialize(same, "simhash-same")
    release(known)
    held = shared_runs(sets, texts, least)

    def buckets(roots: DataFrame) -> DataFrame:
        """Buckets with nodes of several components, each node with its component."""
        rows = held.withColumn("k", F.xxhash64("m")).select("k", F.explode("m").alias("m")).select("k", "m.*")
        rows = rows.join(roots, rows["node"] == roots["id"], "left").select("k", "node", "n", "at", F.coalesce("root", "node").alias("comp"))
        rows = rows.groupBy("k").agg(F.collect_list(F.struct("node", "n", "at", "comp")).alias("bucket"))
        return rows.filter(F.array_min("bucket.comp") < F.array_max("bucket.comp")).select("bucket")

    roots = materialize(components(sure.unionByName(same)), "simhash-roots")
    for order in range(CHAINS + 1):  # the last time all pairs of different components
        found = compared(bucket_pairs(buckets(roots), least, order if order < CHAINS else None), sets, texts, least)
        edges = roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(found)
        before, roots = roots, materialize(components(edges), "simhash-roots") if order < CHAINS else materialize(edges, "simhash-links")
        release(before, found)
    release(one, same, held)
    return roots


def near_copies(docs: DataFrame, errors: int = BITS, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """doc_id, text -> doc_id, node, component_id, kept: links of near_duplicates(), and of texts alike in their runs of words.

    A node is a text. kept: of the rows of a component's smallest doc_id, those of one text. Null doc_ids do not appear.
    """
    rows = docs.filter("doc_id IS NOT NULL").withColumn("node", node_of(F.col("text")))
    ids = materialize(rows.select("doc_id", "node"), "simhash-ids")
    every = materialize(described(rows, shingle, ALIKE), "simhash-every")
    nodes = materialize(every.groupBy("node").agg(F.first("fp").alias("fp")), "simhash-fp")
    reps = nodes.groupBy("fp").agg(F.min("node").alias("id"))
    equal = nodes.join(reps, "fp").filter("node <> id").select(F.col("id").alias("a"), F.col("node").alias("b"))
    sure = materialize(equal.unionByName(forests(reps, errors, limit)), "simhash-sure")
    links = alike(every, rows, sure)
    release(nodes)
    roots = materialize(components(sure.unionByName(links)), "simhash-roots")
    release(sure, links)
    named = ids.groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, F.col("node") == F.col("id"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = materialize(named, "simhash-named")
    first = named.groupBy("root").agg(F.min(F.struct("least", "node")).alias("m"))
    named = named.join(first, "root").select(F.col("node").alias("r_id"), F.col("m.least").alias("component_id"), F.col("m.node").alias("of"))
    found = ids.join(named, F.col("node") == F.col("r_id"))
    found = found.select("doc_id", "node", "component_id", ((F.col("doc_id") == F.col("component_id")) & (F.col("node") == F.col("of"))).alias("kept"))
    return found


def node_of(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id. Columns as they came.

    Rows of a null doc_id are kept apart from any group, one of each text. Rows of one doc_id and unlike texts are groups
    of their own.
    """
    names = docs.columns
    found = near_copies(pick(docs, doc_id="long", text="string"), **options)
    keep = materialize(found.filter("kept").select(F.col("doc_id").alias("k_id"), F.col("node").alias("k_node")).distinct(), "simhash-kept")
    inner = [f"c{i}" for i in range(len(names))]
    at = names.index("doc_id") if "doc_id" in names else [n.lower() for n in names].index("doc_id")
    text = names.index("text") if "text" in names else [n.lower() for n in names].index("text")
    rows = docs.toDF(*inner)
    rows = rows.withColumn("k", node_of(F.col(inner[text]).cast("string")))
    one = rows.join(keep, (rows[inner[at]].cast("long") == keep["k_id"]) & (rows["k"] == keep["k_node"]), "left_semi").dropDuplicates([inner[at], "k"])
    lost = rows.filter(rows[inner[at]].isNull()).dropDuplicates([inner[text]])
    return one.unionByName(lost).drop("k").toDF(*names)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest doc_id it reaches over links of at most two bits."""
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", text="string")
    out = near_duplicates(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
