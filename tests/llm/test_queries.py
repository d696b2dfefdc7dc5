"""The registered queries over the smallest tables against brute force."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from setloom.llm import hilbert, packing, simhash, syncmers, toxicity
from setloom.llm.common import pick
from setloom.llm.queries import QUERIES
from tests.llm.test_small import model_components, model_fingerprint, model_targets

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' ORDER BY 1").fetchall())


@pytest.fixture(scope="module")
def sources():
    return dict(duckdb.sql(f"SELECT doc_id, source FROM '{FOLDER}/documents.parquet'").fetchall())


def words(text):
    return (text or "").encode().split()


def by_doc(rows):
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


def model_packing(items, capacity, share, slack):
    """Best fit by a scan over all bins; items (n_words, doc_id, piece, source, cluster), longest first. Bins as sets of items."""
    words = {}
    for n, _, _, s, _ in items:
        words[s] = words.get(s, 0) + n
    most = {s: capacity * min(1.0, max(share, slack * n / max(1, sum(words.values())))) for s, n in words.items()}
    bins = []
    for item in sorted(items, key=lambda x: (-x[0], x[1], x[2])):
        n, _, _, s, c = item
        fits = []
        for k, held in enumerate(bins):
            left = capacity - sum(x[0] for x in held)
            closed = n and sum(x[0] for x in held if x[3] == s) >= most[s] and any(x[0] and x[3] == s for x in held)
            if left >= n and not closed and not (n and any(x[0] and x[4] == c for x in held)):
                fits.append((left, k))
        if fits:
            bins[min(fits)[1]].append(item)
        else:
            bins.append([item])
    return {frozenset(x[1:3] for x in b) for b in bins}


def test_op1(spark, texts, sources):
    rows = QUERIES["op1_packing"](spark, FOLDER).collect()
    placed, bins = {}, {}
    for r in rows:
        placed[r.doc_id] = placed.get(r.doc_id, 0) + r.n_words
        bins.setdefault(r.bin_id, []).append(r)
    assert placed == {i: len(words(t)) for i, t in texts.items()}
    cluster = model_components({i: model_fingerprint(t) for i, t in texts.items()})
    for b in bins.values():
        assert sum(r.n_words for r in b) == b[0].bin_words <= 2048
        assert len({cluster[r.doc_id] for r in b}) == len(b)
    assert sum(placed.values()) / (2048 * len(bins)) > 0.9
    items = [(min(2048, len(words(t)) - at), i, k, sources[i], cluster[i]) for i, t in texts.items() for k, at in enumerate(range(0, max(1, len(words(t))), 2048))]
    assert {frozenset((r.doc_id, r.piece) for r in b) for b in bins.values()} == model_packing(items, 2048, packing.SHARE, packing.SLACK)


def test_op2(spark, texts):
    rows = by_doc(QUERIES["op2_lattice"](spark, FOLDER).collect())
    assert rows.keys() == texts.keys()
    low = lambda t: t.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    train, ends = {}, 0
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            ends += 1
            for w in low(t):
                train[w] = train.get(w, 0) + 1
    n, v = sum(train.values()) + ends, len(train) + 1
    for i, r in rows.items():
        c = [*(train.get(w, 0) for w in low(texts[i])), ends]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(c), sum(x > 0 for x in c), n)
        assert math.isclose(r.base_score, sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c), rel_tol=1e-9)
    seen = [r for r in rows.values() if not r.held_out]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)


def test_op2_scores_held_out_texts_better_than_whole_tokens(spark):
    rows = [r for r in QUERIES["op2_lattice"](spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_op4(spark, texts):
    rows = by_doc(QUERIES["op4_simhash"](spark, FOLDER).collect())
    fps = {i: model_fingerprint(t) for i, t in texts.items()}
    comp = model_components(fps)
    assert {i: (r.fingerprint, r.component_id) for i, r in rows.items()} == {i: (f"{f:016x}", comp[i]) for i, f in fps.items()}


def true_nearest(folder):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{folder}/embeddings.parquet' ORDER BY 1").fetchall()
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        out[int(ids[q])] = ([int(ids[k]) for k in np.lexsort((ids, -scores)) if k != q][:20], dict(zip(ids.tolist(), scores.tolist())))
    return out


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.1"])
def test_op5(spark, folder):
    true, got = true_nearest(folder), {}
    for r in QUERIES["op5_hilbert"](spark, folder).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert got.keys() == true.keys()
    hit = 0
    for q, found in got.items():
        nearest, scores = true[q]
        assert sorted(found) == list(range(1, 21))
        ids = [found[k][0] for k in range(1, 21)]
        assert len(set(ids)) == 20 and q not in ids
        assert all(math.isclose(found[k][1], scores[found[k][0]], rel_tol=0, abs_tol=1e-12) for k in found)
        assert [(-found[k][1], found[k][0]) for k in range(1, 21)] == sorted((-s, i) for i, s in found.values())
        hit += len(set(ids) & set(nearest))
    assert hit / (20 * len(got)) >= 0.9


def test_op5_looks_at_windows_only(spark):
    """The share of the pairs of a query and a vector that the windows hold; on these vectors without structure it is large."""
    rows = pick(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), vec_id="long", embedding="array<double>")
    placed = hilbert.places(hilbert.usable(rows, F.col("vec_id") % 20 == 0), hilbert.CURVES)
    width = hilbert.fitted_widths(placed, 20, hilbert.RECALL, hilbert.SAMPLE)[64]
    every = {r.vec_id: np.array(r.places) for r in placed.select("vec_id", "places").collect()}
    at = np.stack(list(every.values()))
    assert all(sorted(at[:, c]) == list(range(len(at))) for c in range(hilbert.CURVES))
    seen = [(np.abs(at - p).min(axis=1) <= width).mean() for i, p in every.items() if i % 20 == 0]
    assert width < 0.08 * len(at) and np.mean(seen) < 0.85


def test_op6(spark):
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{FOLDER}/pages.parquet'").fetchall())
    rows = {r.page_id: r for r in QUERIES["op6_htmltext"](spark, FOLDER).collect()}
    assert rows.keys() == pages.keys()
    for i, page in pages.items():
        body = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(b for b in blocks if b)
        assert rows[i].text == want and rows[i].n_chars == len(want)


def test_op7(spark, texts):
    rows = by_doc(QUERIES["op7_syncmers"](spark, FOLDER).collect())
    order = sorted(texts, reverse=True)
    for i, j in zip(order, [*order[1:], order[0]]):
        n = len(texts[i])
        edited = texts[i][: n - n // 3] + texts[j][: n // 3]
        assert (rows[i].n_chars, rows[i].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
    def anchors(text):
        toks = [t.encode() for t in re.findall(r"[^\x20\x09-\x0D]{1,4}", text)]
        if len(toks) < 2:
            return [chain(t) >> 32 for t in toks]
        g = [chain(a, b) for a, b in zip(toks, toks[1:])]
        signed = [x - (1 << 64) if x >> 63 else x for x in g]
        if len(g) < syncmers.SHORT:
            found = [(p, chain(g[p]) >> 32) for p in range(len(g))]
        else:
            found = [(p, chain(*g[p : p + 7 : 2]) >> 32) for p in range(len(g) - 6) if min(signed[p : p + 7]) in (signed[p], signed[p + 6])]
        return [(min(15, p - (found[k - 1][0] if k else 0)) << 32) + h for k, (p, h) in enumerate(found)]

    def links(a):
        return {chain(x & 0xFFFFFFFF, y) for x, y in zip(a, a[1:])} if len(a) > 1 else set(a)

    def likeness(a, b):
        a, b = links(a), links(b)
        return len(a & b) / len(a | b) if a or b else 1.0

    for i, j in zip(order, [*order[1:], order[0]]):
        n = len(texts[i])
        own, new = anchors(texts[i]), anchors(texts[i][: n - n // 3] + texts[j][: n // 3])
        r = rows[i]
        assert (r.fingerprint, r.edited_fingerprint) == ("".join(f"{x:09x}" for x in own), "".join(f"{x:09x}" for x in new))
        assert math.isclose(r.near_edited, likeness(own, new)) and math.isclose(r.near_next, likeness(own, anchors(texts[j])))
    long_ = [rows[i] for i, t in texts.items() if len(t) > 300]
    near = sorted(r.near_edited for r in long_)
    assert near[0] > 0.05 and 0.4 < near[len(near) // 2] < 0.6
    assert sum(r.near_next for r in long_) / len(long_) < 0.05


def chain(*values):
    """XXH64 over values, each with the hash so far as its seed, as Spark has it; numbers as eight bytes."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else int(v).to_bytes(8, "little"), seed=h)
    return h


def test_op8(spark):
    rows = by_doc(QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.1").collect())
    labels = dict(duckdb.sql("SELECT doc_id, max(toxic) FROM '/root/testdata/sf0.1/labels.parquet' GROUP BY 1").fetchall())
    held = [(rows[i].predicted, y) for i, y in labels.items() if rows[i].held_out]
    assert len(held) > 500 and sum(p == y for p, y in held) / len(held) > 0.985
    assert sum(p > y for p, y in held) <= 3
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for i, r in rows.items())


def test_op9(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows, at = by_doc(QUERIES["op9_tokens"](spark, FOLDER).collect()), 0
    assert rows.keys() == texts.keys()
    for i in sorted(texts):
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op10(spark, texts, sources):
    rows = by_doc(QUERIES["op10_mixing"](spark, FOLDER).collect())
    sizes = {}
    for i, t in texts.items():
        sizes[sources[i]] = sizes.get(sources[i], 0) + len(words(t))
    want, taken = model_targets(sizes), dict.fromkeys(sizes, 0)
    for i, r in rows.items():
        assert r.size == len(words(texts[i])) and r.source_size == sizes[sources[i]] and 0 <= r.taken <= 3 * r.size
        assert math.isclose(r.target, want[sources[i]], rel_tol=1e-9)
        taken[sources[i]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert {i: r.taken for i, r in by_doc(QUERIES["op10_mixing"](spark, FOLDER).collect()).items()} == {i: r.taken for i, r in rows.items()}


def runs_of(text):
    w = [x.lower() for x in words(text)]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def model_copies(texts):
    """Components over all pairs: fingerprints within two bits, or runs of five words alike by 0.8."""
    ids = sorted(texts)
    fps, runs = {i: model_fingerprint(texts[i]) for i in ids}, {i: runs_of(texts[i]) for i in ids}
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            near = (fps[a] ^ fps[b]).bit_count() <= 2 or len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b])
            if near and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}


def test_near_copies_loses_no_pair_of_a_large_table(spark):
    """Every pair of the 0.1 tables alike by 0.8 and with a run that at most 500 texts hold is in one component."""
    texts = dict(duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.1/documents.parquet'").fetchall())
    one = {}
    for i in sorted(texts):
        one.setdefault(texts[i], i)
    runs = {i: set(simhash.run_set(t).tolist()) for t, i in one.items()}
    having, shared = {}, Counter()
    for i, rs in runs.items():
        for r in rs:
            having.setdefault(r, []).append(i)
    for ids in having.values():
        if 1 < len(ids) <= 500:
            shared.update((a, b) for k, a in enumerate(ids) for b in ids[:k])
    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(runs[a]) + len(runs[b]) - n)]
    docs = pick(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), doc_id="long", text="string")
    of = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert len(pairs) > 30 and all(of[a] == of[b] for a, b in pairs)


def test_near_copies_by_edits(spark):
    """Copies with a few words changed are one group, beside texts of the same words in another order."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = {}
    for g in range(12):
        base = list(rng.choice(vocabulary, 300))
        for c in range(6):
            copy = list(base)
            for at in rng.integers(0, 300, c):
                copy[at] = f"new{g}x{c}"
            texts[g * 10 + c] = " ".join(copy)
        texts[g * 10 + 6] = " ".join(rng.permutation(base))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got == {i: i // 10 * 10 if i % 10 < 6 else i for i in texts}


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frames[-1], FOLDER)
        out.write.parquet(str(tmp_path / name))
        frames.append(spark.read.parquet(str(tmp_path / name)))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "mixing", "packing"]
    assert all(f.columns == columns for f in frames[:-1])
    start, clean, single, mixed, packed = [f.collect() for f in frames]

    grammar = toxicity.learned(toxicity.training_rows(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")))
    assert {r.doc_id for r in clean} == {r.doc_id for r in start if grammar.score(r.text) < 0.5}
    comp = model_copies({r.doc_id: r.text for r in clean})
    assert sorted(r.doc_id for r in single) == sorted(set(comp.values()))
    size = {r.doc_id: len(words(r.text)) for r in single}
    source = {r.doc_id: r.source for r in single}
    sizes, got, copies = {}, {}, {}
    for i, n in size.items():
        sizes[source[i]] = sizes.get(source[i], 0) + n
    for r in mixed:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
        got[r.source] = got.get(r.source, 0) + size[r.doc_id]
    assert max(copies.values()) <= 3
    most = max(size.values())
    assert all(abs(got.get(s, 0) - t) <= most for s, t in model_targets(sizes).items())
    placed = {}
    for r in packed:
        placed[r.doc_id] = placed.get(r.doc_id, 0) + r.n_words
    assert placed == {i: size[i] * n for i, n in copies.items()}
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    key = lambda rows: sorted(map(tuple, rows))
    assert key(whole) == key(packed)
