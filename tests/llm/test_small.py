"""Every training-data operator on nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from setloom.llm import common, hilbert, htmltext, lattice, mixing, packing, simhash, syncmers, tokens, toxicity, urls

LONG = "lorem ipsum dolor sit amet " * 20_000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog again and again today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog again and again today", "en", "a"),
    (3, "", "en", "b"),
    (4, None, None, None),
    (5, LONG, "en", "a"),
    (6, "the QUICK brown fox", "de", "b"),
    (6, "the QUICK brown fox", "de", "b"),
    (None, "no id here at all my friend", None, "c"),
    (8, " \t\n ", "en", "c"),
    (9, "ein Wort über \U0001f600 und <|endoftext|> so weiter", "de", None),
    (10, "x" * 100_000, "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 1.5, "clash", 7, "TEXT") for r in TEXTS]
    return spark.createDataFrame(rows, f"{SCHEMA}, score double, fingerprint string, component_id int, _flag string").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def picked(docs):
    return common.pick(docs, doc_id="long", text="string", lang="string", source="string")


def test_pick_prefers_the_exact_name(spark):
    df = spark.createDataFrame([(1, 2)], "Text int, text int")
    assert common.pick(df, text="string", other="long").collect() == [("2", None)]


def model_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def model_components(fps):
    """Brute force: ids by the smallest id they reach."""
    out = {}
    rows = list(fps.items())
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(rows):
        for j, y in rows[:a]:
            if (x ^ y).bit_count() <= 2:
                ri, rj = root(i), root(j)
                parent[max(ri, rj)] = min(ri, rj)
    for i, _ in rows:
        out[i] = root(i)
    return out


def test_simhash(docs, none):
    got = simhash.near_duplicates(picked(docs)).collect()
    assert len(got) == len(TEXTS)
    want = {i: model_fingerprint(t) for i, t, *_ in TEXTS if i is not None}
    assert all(r.fp % (1 << 64) == want[r.doc_id] for r in got if r.doc_id is not None)
    comp = model_components(want)
    assert all(r.component_id == comp[r.doc_id] for r in got if r.doc_id is not None)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted([0, *{comp[i] for i in comp}])
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("limit", [5, 40, 20_000])
def test_simhash_links_against_brute_force(spark, limit):
    """Random fingerprints with dense groups; a low limit deals every bucket anew several times."""
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 1 << 64, 150, dtype=np.uint64)}
    for centre in list(fps)[:4]:
        for _ in range(60):
            x = centre
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    ids = dict(enumerate(sorted(fps)))
    want = model_components(ids)
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in ids.items()], "fp long, id long")
    roots = {r.id: r.root for r in simhash.components(simhash.forests(frame, 2, limit)).collect()}
    assert {i: roots.get(i, i) for i in ids} == want


def test_trie_forest_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    test_simhash_links_against_brute_force(spark, 20_000)


def alike_groups(texts, fps):
    """Components over all pairs, whatever their fingerprints of words."""
    runs = {i: set(simhash.run_set(t).tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and ((fps[a] ^ fps[b]).bit_count() <= 2 or len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b])):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in texts}


def test_near_copies_behind_a_text_of_the_same_words(spark):
    """P has B's words in another order and a smaller doc_id; B's edited copies are B's all the same."""
    rng = np.random.default_rng(8)
    texts = {}
    for g in range(10):
        base = [f"v{x}" for x in rng.integers(0, 400, 200)]
        texts[g * 10] = " ".join(rng.permutation(base))
        texts[g * 10 + 1] = " ".join(base)
        for c in (2, 3):
            copy = list(base)
            for k in range(4):
                copy[40 * k + 7 * c] = f"new{g}x{c}x{k}"
            texts[g * 10 + c] = " ".join(copy)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: i if i % 10 == 0 else i // 10 * 10 + 1 for i in texts}


@pytest.mark.parametrize("hot, most", [(3, 1 << 20), (200, 1 << 20), (3, 40)])
def test_near_copies_of_large_groups_against_all_pairs(spark, monkeypatch, hot, most):
    """Chains of edits, short texts against copies of other texts, and lines that many texts share; also with more hot runs than are sent."""
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "MOST_HOT", most)
    rng = np.random.default_rng(9)
    shared = " ".join(f"licence{k}" for k in range(12))
    texts = {}
    for size in (9, 25, 60, 150):
        base = [f"t{size}w{x}" for x in rng.integers(0, 300, size)]
        for _ in range(110):
            copy = list(base)
            for at in rng.integers(0, size, rng.integers(0, max(2, size // 25))):
                copy[at] = f"e{rng.integers(0, 10_000)}"
            if rng.random() < 0.3:
                base = copy
            texts[len(texts)] = " ".join(copy)
    for k in range(60):
        texts[len(texts)] = shared + " " + " ".join(f"own{x}" for x in rng.integers(0, 5_000, rng.integers(2, 60)))
    fps = {i: model_fingerprint(t) for i, t in texts.items()}
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == alike_groups(texts, fps)


def test_texts_of_many_nodes_are_picked_without_a_join(spark, monkeypatch):
    """A join shuffles all texts once the nodes are too many to send; what is marked may hold others, but misses none."""
    texts = spark.range(3000).select(F.xxhash64("id").alias("node"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    texts = texts.unionByName(texts)
    asked = texts.filter("pmod(node, 7) = 0").select(F.col("node").alias("e_id")).distinct()
    for most in (simhash.MOST_MARKS, 1 << 15):
        monkeypatch.setattr(simhash, "MOST_MARKS", most)
        got = simhash.texts_of(asked, texts)
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
        rows = {r.node: r.text for r in got.collect()}
        assert got.count() == len(rows) < 1000
        assert {r.e_id for r in asked.collect()} <= set(rows) and set(rows.items()) <= {(r.node, r.text) for r in texts.collect()}


def test_further_rounds_count_runs_that_come_in_place_of_hot_ones():
    rng = np.random.default_rng(5)
    runs = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    for hot in (runs[:0], runs[3:30], runs[::2], runs):
        before, after = simhash.first_runs(runs, 0.8), simhash.first_runs(runs, 0.8, hot)
        assert set(simhash.added_runs(runs, 0.8, hot)) == set(after) - set(before) - set(hot)
    assert len(simhash.added_runs(runs[:0], 0.8, runs)) == 0


def test_a_run_that_comes_in_place_of_a_hot_one_is_counted_once(spark, monkeypatch):
    """Over several rounds of hot runs each text's further runs are made once, and the hot runs are those of whole counts."""
    monkeypatch.setattr(simhash, "HOT", 20)
    monkeypatch.setattr(simhash, "FURTHER", 1)
    monkeypatch.setattr(simhash, "ROUNDS", 20)
    rng = np.random.default_rng(12)
    texts = []
    for size in (40, 90):
        for i in range(70):
            own = [f"o{size}x{i}x{x}" for x in range(rng.integers(10, 200))]
            texts.append(" ".join([f"p{size}x{x}" for x in range(size - rng.integers(0, size // 2))] + own))
    runs = [simhash.run_set(t) for t in texts]
    at_first = [simhash.first_runs(r, 0.8) for r in runs]
    hot, rounds = np.array([], np.uint64), 0
    while True:  # all further first runs of all texts are counted anew
        firsts = [np.setdiff1d(simhash.first_runs(r, 0.8, hot), np.union1d(f, hot)) for r, f in zip(runs, at_first)] if rounds else at_first
        each, n = np.unique(np.concatenate(firsts), return_counts=True)
        if not (n > 20).any():
            break
        hot, rounds = np.union1d(hot, each[n > 20]), rounds + 1
    made, materialize = [], simhash.materialize

    def kept(df, tag):
        out = materialize(df, tag)
        made.extend([(r.node, x) for r in out.collect() for x in r.firsts] if tag == "simhash-added" else [])
        return out

    monkeypatch.setattr(simhash, "materialize", kept)
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string").repartition(5)
    rows = rows.unionByName(rows.filter("node % 3 = 0"))
    sets = spark.createDataFrame([(i, simhash.first_runs(r, 0.8).view(np.int64).tolist()) for i, r in enumerate(runs)], "node long, firsts array<long>")
    got, _ = simhash.hot_runs(sets, rows, 0.8)
    assert 3 < rounds <= 20 and got.value.tolist() == hot.tolist()
    left = {(i, x) for i, (r, f) in enumerate(zip(runs, at_first)) for x in np.setdiff1d(simhash.first_runs(r, 0.8, hot), np.union1d(f, hot)).view(np.int64).tolist()}
    last = set(hot.view(np.int64).tolist())
    assert len(made) == len(set(made)) and {(i, x) for i, x in made if x not in last} == left


def test_pairs_of_near_copies_follow_their_number(spark, monkeypatch):
    """Edited copies of one text are compared with the text, not each with each, though all its runs are common."""
    monkeypatch.setattr(simhash, "HOT", 15)
    rng = np.random.default_rng(10)
    base, texts = [f"b{x}" for x in range(150)], {0: " ".join(f"b{x}" for x in range(150))}
    for i in range(1, 300):
        copy = list(base)
        for at in rng.choice(150, rng.integers(1, 8), replace=False):
            copy[at] = f"e{i}x{at}"
        texts[i] = " ".join(copy)
    asked, compared = [], simhash.compared
    monkeypatch.setattr(simhash, "compared", lambda pairs, *rest: asked.append(pairs.count()) or compared(pairs, *rest))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == alike_groups(texts, {i: model_fingerprint(t) for i, t in texts.items()})
    assert asked[0] > 0 and sum(asked) < 10 * len(texts)


def test_most_frequent_takes_whole_powers_of_two_that_fit(spark):
    counts = simhash.materialize(spark.createDataFrame([(r, c) for r, c in enumerate([5, 6, 7, 9, 12, 40, 41, 300])], "r long, count long"), "t")
    for most, want in [(0, []), (1, [7]), (2, [7]), (3, [5, 6, 7]), (5, [3, 4, 5, 6, 7]), (7, [3, 4, 5, 6, 7]), (8, list(range(8)))]:
        assert sorted(r.r for r in simhash.most_frequent(counts, most).collect()) == want


def test_components_of_stars_chains_and_rings(spark):
    edges = [(1, 2), (1, 3), (10, 11), (11, 12), (12, 13), (20, 21), (21, 22), (20, 22), (30, 31), (29, 31), (5, 5), (2, 1)]
    got = {r.id: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 13: 10, 20: 20, 21: 20, 22: 20, 29: 29, 30: 29, 31: 29}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_keep_one_keeps_unlike_texts_of_one_doc_id(spark):
    texts = [(1, "one text of a row " * 3), (1, "quite another text whose id is the same"), (1, "one text of a row " * 3), (2, "quite another text whose id is the same"), (3, "a third")]
    kept = simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([texts[0], texts[1], texts[4]])


def test_mixing(docs, none):
    items = picked(docs).select("doc_id", "source", common.word_count(F.col("text")).alias("size"))
    got = mixing.mix_plan(items).collect()
    again = mixing.mix_plan(items.repartition(5)).collect()
    key = lambda rows: sorted((r.doc_id or 0, r.size, r.taken, r.copies, r.position or 0) for r in rows)
    assert len(got) == len(TEXTS) and key(got) == key(again)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        s = by.setdefault(r.source, [r.source_size, r.target, 0])
        s[2] += r.taken
    for size, target, taken in by.values():
        assert abs(taken - target) <= 1 and target <= 3 * size + 1e-6
    assert mixing.mix_plan(none.select("doc_id", "source", F.lit(0).cast("long").alias("size"))).count() == 0
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and out.count() >= 3
    assert mixing.mix_documents(none).count() == 0


def model_targets(sizes, weights=(5, 2, 1), cap=3):
    """Reshares the excess round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, open_, rest = {}, set(names), sum(sizes.values())
    while open_:
        level = rest / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > cap * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            rest -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 500, "c": 3}, {"a": 5}, {"a": 1, "b": 1, "c": 1, "d": 1000, None: 7}, {"a": 0, "b": 4}, {"\U0001f600": 9, "￿": 90, "z": 900}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame).collect()}
    want = model_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in got)


def test_schedule_is_inverted(spark):
    for slope in (-0.5, 0.0, 0.7):
        q = [r.t + slope * (r.t * r.t - r.t) for r in spark.range(11).select(mixing.position(F.col("id") / 10, F.lit(slope)).alias("t")).collect()]
        assert np.allclose(q, np.arange(11) / 10)


def test_packing(docs, none):
    got = packing.pack_documents(docs, capacity=1000, share=0.5).collect()
    by_doc, bins = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.bin_id, []).append(r)
    assert by_doc.keys() == {i for i, *_ in TEXTS}
    sizes = {i: len((t or "").encode().split()) for i, t, *_ in TEXTS}
    for i, pieces in by_doc.items():
        assert sum(p.n_words for p in pieces) == sizes[i] * (2 if i == 6 else 1)
    text = {i: t or "" for i, t, *_ in TEXTS}
    for rows in bins.values():
        rows.sort(key=lambda r: (r.bin_offset, r.n_words))
        assert sum(r.n_words for r in rows) == rows[0].bin_words <= 1000
        at = 0
        for r in rows:
            assert r.bin_offset == at
            at += r.n_words
        texts = [text[r.doc_id] for r in rows if r.n_words]
        assert len(texts) == len(set(texts))
    assert packing.pack_documents(none).count() == packing.pack_apart(none).count() == 0


def test_packing_near_copies_apart(spark):
    base = [f"w{k}" for k in range(200)]
    rows = [(k, "a", " ".join([*base[:50], f"new{k % 2}", *base[51:]])) for k in range(4)] + [(10 + k, "b", f"other{k} " * 30) for k in range(20)]
    got = packing.pack_apart(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    linked = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")).collect()}
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(linked[r.doc_id])
    assert all(len(c) == len(set(c)) for c in bins.values()) and len(got) == 24


def test_packing_fills_bins_of_short_and_empty_texts(spark):
    short = spark.range(3000).selectExpr("id AS doc_id", "'a' AS source", "concat('w', id, ' x y z') AS text")
    empty = spark.range(3000).selectExpr("id + 5000 AS doc_id", "'b' AS source", "'' AS text")
    nameless = spark.range(500).selectExpr("CAST(NULL AS LONG) AS doc_id", "'c' AS source", "concat('n', id, ' p') AS text")
    got = packing.pack_documents(short.unionByName(empty).unionByName(nameless), shard=1000).collect()
    bins, shards = {}, {}
    for r in got:
        bins[r.bin_id] = bins.get(r.bin_id, 0) + r.n_words
        if r.doc_id is None:
            shards[r.bin_id >> 32] = shards.get(r.bin_id >> 32, 0) + 1
    assert len(got) == 6500 and all(bins.values())
    assert len(bins) <= 2 * len({b >> 32 for b in bins}) + 13_000 // 2048
    assert len(shards) > 3


def test_best_fit_takes_the_tightest_compatible_bin():
    bins, used = packing.best_fit([70, 60, 40, 30, 30, 0], list("abcada"), [1, 2, 3, 1, 4, 1], 100, 0.5)
    assert bins == [0, 1, 1, 2, 0, 0] and used == [100, 100, 30]


def test_best_fit_on_random_items_against_a_scan():
    rng = np.random.default_rng(1)
    n = sorted(rng.integers(0, 50, 300).tolist(), reverse=True)
    sources, clusters = rng.integers(0, 4, 300).tolist(), rng.integers(0, 40, 300).tolist()
    bins, _ = packing.best_fit(n, sources, clusters, 100, 0.3)
    most = packing.shares(n, sources, 100, 0.3)
    state = []
    for size, s, c, b in zip(n, sources, clusters, bins):
        fits = [(100 - u - size, k) for k, (u, ss, cc) in enumerate(state) if u + size <= 100 and not (size and (ss.get(s, 0) >= most[s] or c in cc))]
        assert b == (min(fits)[1] if fits else len(state))
        if b == len(state):
            state.append((0, {}, set()))
        u, ss, cc = state[b]
        state[b] = (u + size, ss | {s: ss.get(s, 0) + size}, cc | ({c} if size else set()))


def test_tokens_round_trip(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    got = tokens.read(tokens.write(picked(docs), common.new_path(spark, "t"), shards=7)).collect()
    assert len(got) == len(TEXTS)
    at = 0
    rows = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [1, 2, 3, 4, 5, 6, 6, 8, 9, 10, None]
    text = {i: t for i, t, *_ in TEXTS}
    for r in rows:
        ids = np.array([*library.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokens.read(tokens.write(none, common.new_path(spark, "t"))).count() == 0


@pytest.mark.parametrize("text", ["  a  b\n\n c's don't ''s 's\t\tx\r\n", "é ñ 12ab ab12 , ,, '", "漢字 x", "a b  c", "¿qué? «a» × 1² ½ … — ’s", "\x0b \x0c\x1c a", "a b  c"])
def test_pieces_are_cut_as_the_library_cuts(text):
    import public_tokenizers

    own = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY), "<u2")
    for t in (text, text * 3, text.upper()):
        assert own.encode_all([t, t])[1] == own.pack(own.tokenizer.encode(t, add_special_tokens=False).ids)


def test_encoder_beyond_its_memory(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokens, "MEMORY", 2)
    own = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY), "<u2")
    for t in ("one two three", "three four five", "five one six"):
        assert own.encode_all([t])[0] == own.pack(own.tokenizer.encode(t, add_special_tokens=False).ids)


def test_encoder_beyond_its_memory_calls_nothing_for_a_piece(monkeypatch):
    import sys

    import public_tokenizers

    monkeypatch.setattr(tokens, "MEMORY", 2)
    own = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY), "<u2")
    own.encode_all(["one two three"])
    text, calls = "four five six, 'seven' " * 500, []
    sys.setprofile(lambda frame, event, arg: event == "call" and calls.append(frame.f_code.co_name))
    try:
        got = own.encode_all([text])
    finally:
        sys.setprofile(None)
    assert got[0] == own.pack(own.tokenizer.encode(text, add_special_tokens=False).ids)
    assert len(calls) < 200 and len(own.known) < 10


def test_syncmers(docs, none):
    rows = picked(docs).withColumn("text", F.coalesce("text", F.lit(""))).select("doc_id", "text")
    rows = syncmers.with_next(rows, {"fp": syncmers.anchors(F.col("text"))}, ranges=6)
    nxt = [(r.doc_id, r.next_doc_id) for r in rows.select("doc_id", "next_doc_id").collect()]
    assert sorted(nxt, key=str) == sorted([(10, 9), (9, 8), (8, 6), (6, 6), (6, 5), (5, 4), (4, 3), (3, 2), (2, 1), (1, None), (None, 10)], key=str)
    got = {r.doc_id: r for r in syncmers.edited_rows(rows).collect()}
    text = {i: t or "" for i, t, *_ in TEXTS}
    after = {10: 9, 9: 8, 8: 6, 5: 4, 4: 3, 3: 2, 2: 1}
    import hashlib

    for i, j in after.items():
        n = len(text[i])
        edited = text[i][: n - n // 3] + text[j][: n // 3]
        assert (got[i].n_chars, got[i].edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[2].near_next == 1.0 and got[1].fingerprint == got[2].fingerprint
    assert got[3].fingerprint == "" and got[4].near_next == 1.0
    assert syncmers.edited_rows(syncmers.with_next(none.select("doc_id", "text"), {"fp": syncmers.anchors(F.col("text"))})).count() == 0


def test_next_of_many_rows_of_one_id_and_of_none(spark):
    """Rows of one doc_id, and rows without one, are dealt over several ranges and still follow one another once each."""
    rows = [(7, f"seven {k}") for k in range(300)] + [(None, f"none {k}") for k in range(200)] + [(k, f"own {k}") for k in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = syncmers.with_next(docs, ranges=40)
    ends = [(r.doc_id, r.text, r.next_doc_id, r.next_text) for r in got.collect()]
    follow = {(i, t): (j, u) for i, t, j, u in ends}
    assert len(ends) == len(follow) == 560 and len(set(follow.values())) == 560
    at, seen = (159, "own 159"), []
    for _ in range(560):
        seen.append(at[0])
        at = follow[at]
    assert at == (159, "own 159") and seen == [*range(159, 99, -1), *[7] * 300, *[None] * 200]


def test_anchors_hold_where_text_is_inserted(spark):
    """A word put in front or in the middle leaves all but a few links as they are."""
    base = " ".join(f"word{k * k % 97}x{k}" for k in range(200))
    texts = [base, "inserted " + base, base.replace("word0x97 ", "word0x97 inserted "), " ".join(f"other{k * k % 89}y{k}" for k in range(200))]
    a = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", syncmers.links(syncmers.anchors(F.col("text"))).alias("l"))
    own = a.filter("id = 0").select(F.col("l").alias("own"))
    near = {r.id: r.n for r in a.crossJoin(own).select("id", syncmers.likeness(F.col("own"), F.col("l")).alias("n")).collect()}
    assert near[0] == 1.0 and near[1] > 0.95 and near[2] > 0.9 and near[3] == 0.0


def test_lattice(docs, none):
    got = lattice.score_documents(picked(docs)).collect()
    assert len(got) == len(TEXTS)
    low = lambda t: (t or "").encode().translate(lattice.ASCII_LOWER).split()
    train = {}
    ends = 0
    for i, t, *_ in TEXTS:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            ends += 1
            for w in low(t):
                train[w] = train.get(w, 0) + 1
    n, v = sum(train.values()) + ends, len(train) + 1
    text = {i: t for i, t, *_ in TEXTS}
    for r in got:
        counts = [train.get(w, 0) for w in low(text[r.doc_id])] + [ends]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(counts), sum(c > 0 for c in counts), n)
        assert math.isclose(r.base_score, sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in counts), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    assert lattice.score_documents(none).count() == 0


def test_lattice_sums_all_segmentations():
    pieces = [b"a", b"ab", b"b", b"bc", b"c", b"abc"]
    rng = np.random.default_rng(0)
    logs = np.log(rng.uniform(0.01, 0.2, (4, len(pieces))))
    own = lattice.Lattice(pieces, logs)

    def brute(word, start=0):
        if start == len(word):
            return 1.0
        total = 0.0
        for k, p in enumerate(pieces):
            if word.startswith(p, start):
                total += math.exp(logs[lattice.place(start, start + len(p), len(word)), k]) * brute(word, start + len(p))
        return total

    words = [b"abc", b"abcabc", b"bca", b"c", b"aabbcc"]
    assert np.allclose(np.exp(own.log_weights(words)), [brute(w) for w in words])
    counts = np.zeros(logs.shape)
    for _, chars in own.groups(words):
        own.expected(chars, counts)
    assert math.isclose(counts[0].sum() + counts[1].sum(), len(words)) and math.isclose(counts[0].sum() + counts[3].sum(), len(words))


def test_scores_against_brute_force_segmentation(spark):
    """The model of one component spelt out, with all segmentations of each word added up one by one."""
    rows = [(k, f"the small town and the river {'unheard' if k % 10 == 4 else 'known'} of {k % 3}") for k in range(40)] + [(90, "")]
    got = lattice.score_documents(spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string"), rounds=0).collect()
    pieces, first = lattice.vocabulary()
    logs = lattice.normalised(np.exp(first - np.logaddexp.reduce(first))[None, :] * len(pieces) * np.array([[0.2], [0.8], [0.5], [0.5]]))
    where = {p: i for i, p in enumerate(pieces)}

    def segmentations(word, start=0):
        if start == len(word):
            return 1.0
        ends = [e for e in range(start + 1, len(word) + 1) if word[start:e] in where]
        return sum(math.exp(logs[lattice.place(start, e, len(word)), where[word[start:e]]]) * segmentations(word, e) for e in ends)

    train, ends = {}, 0
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            ends += 1
            for w in t.encode().split():
                train[w] = train.get(w, 0) + 1
    of = [sum(c == k for c in train.values()) for k in (1, 2, 3, 4)]
    off = [0.0, *lattice.discounts(of)]
    size = sum(train.values()) + ends + 1
    rest = (off[1] * of[0] + off[2] * of[1] + off[3] * (len(train) - of[0] - of[1])) / size

    def word_p(w):
        c = train.get(w, 0)
        seen = (c - off[min(c, 3)]) / size
        return seen + (rest + 1 / size) * (seen + (rest + 0.5 / size) * segmentations(w))

    end = (ends + (rest * size + 1) * (ends + 0.5) / size) / size
    text = dict(rows)
    for r in got:
        want = math.log10(end) + sum(math.log10(word_p(w)) for w in text[r.doc_id].encode().split())
        assert math.isclose(r.score, want, rel_tol=1e-9)


def test_lattice_probabilities_sum_to_one_at_most():
    pieces, first = lattice.vocabulary()
    logs = lattice.normalised(np.exp(first)[None, :] * np.ones((4, 1)))
    assert np.allclose(np.exp(np.logaddexp.reduce(logs[:2].ravel())), 1) and np.allclose(np.exp(np.logaddexp.reduce(logs[2:].ravel())), 1)


def test_hilbert_keys_are_a_curve():
    """Neighbours on the curve are neighbours in space."""
    depth, n = 3, 3
    grid = np.stack(np.meshgrid(*[np.arange(1 << depth)] * n), axis=-1).reshape(-1, n)
    order = np.argsort(hilbert.hilbert_key(grid, depth))
    assert len(set(hilbert.hilbert_key(grid, depth).tolist())) == len(grid)
    assert (np.abs(np.diff(grid[order], axis=0)).sum(axis=1) == 1).all()


def brute_nearest(vectors, query, nearest):
    q = vectors[query]
    scored = [(-float(np.dot(q, v)), i) for i, v in vectors.items() if i != query and len(v) == len(q)]
    return [i for _, i in sorted(scored)[:nearest]]


@pytest.mark.parametrize("exact", [False, True])
def test_hilbert_search(spark, exact):
    """Small blocks, so that windows and the whole curve span several; all that the windows find is ranked as brute force ranks it."""
    rng = np.random.default_rng(2)
    base = {i: rng.standard_normal(8).tolist() for i in range(0, 600, 2)}
    base |= {1001: base[20], 1003: base[20], 1005: [1.0, 2.0]}
    odd = [(2001, None), (2003, []), (2005, [0.0] * 8), (2007, [float("nan")] * 8), (2009, [None] * 8), (2011, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)]
    rows = spark.createDataFrame([*base.items(), *odd, (20, base[20])], "vec_id long, embedding array<double>")
    rows = rows.withColumns({c: F.lit(7) for c in ("v", "dim", "places", "score", "rank", "query_id")})
    got = {}
    for r in hilbert.nearest_neighbours(rows, F.col("vec_id") % 20 == 0, nearest=7, block=64, exact=exact).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == {i for i in base if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        found.sort()
        true = brute_nearest(base, q, 7)
        ids = [v for _, v, _ in found]
        hit += len(set(ids) & set(true))
        assert ids == [i for i in brute_nearest(base, q, 400) if i in ids] and (ids == true or not exact)
        assert [k for k, _, _ in found] == list(range(1, 8))
    assert hit >= 0.9 * 7 * len(got)
    assert hilbert.nearest_neighbours(rows.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in hilbert.nearest_neighbours(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1)]


def test_hilbert_windows_are_narrow_where_vectors_have_structure(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 24)) * 3
    rows = [(i, (centres[i % 40] + 0.2 * rng.standard_normal(24)).tolist()) for i in range(4000)]
    placed = hilbert.places(hilbert.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0), hilbert.CURVES)
    assert hilbert.fitted_widths(placed, 20, hilbert.RECALL, hilbert.SAMPLE)[24] <= 200


PAGE = "<html><head><title>t</title><script>var a='<p>';</script></head><body><div class='top'>Site name</div><nav><ul><li>x<li>y</ul></nav>{}<div class='fine-print'>All rights kept</div><footer>f</footer></body></html>"


def test_html(spark):
    bodies = [f"<div class='story'><h2>Head {k}</h2><p>Body {k} of  the\n story &amp; more.<p>Second {k}</div>" for k in range(6)]
    rows = [(k, f"http://h.example/{k}", PAGE.format(b)) for k, b in enumerate(bodies)]
    rows += [(100, None, None), (101, "http://h.example/e", ""), (102, "x", "no markup &lt;at&gt; all"), (103, "http://solo.example/", "<body><article><p>One<br>two<div class='comments'><p>c</div></article><aside>s</aside>"), (103, "http://solo.example/", "<p>long " + "w " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", htmltext.host_of(F.col("url")))
    pages = pages.withColumns({"slot": F.lit("clash"), "text": F.lit("clash"), "verdict": F.lit(1)})
    got = {}
    for r in htmltext.extract_pages(pages).collect():
        got.setdefault(r.page_id, []).append(r.text)
    for k in range(6):
        assert got[k] == [f"Head {k}\nBody {k} of the story & more.\nSecond {k}"]
    assert got[100] == got[101] == [""]
    assert got[102] == ["no markup <at> all"]
    assert sorted(got[103]) == sorted(["One two", ("long " + "w " * 100_000).strip()])
    assert htmltext.extract_pages(pages.limit(0)).count() == 0


def test_html_copies_on_a_host_are_not_template(spark):
    article = "<article><h1>Same head</h1><p>The very same story.</p></article>"
    rows = [(k, f"http://c.example/{k}", PAGE.format(article)) for k in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", htmltext.host_of(F.col("url")))
    assert {r.text for r in htmltext.extract_pages(pages).collect()} == {"Same head\nThe very same story."}


def test_html_wrapper_decides_inside_and_outside_of_an_article(spark):
    def words(k, n):
        return " ".join(f"w{k}x{i}" for i in range(n))

    inner = "<article><h1>Head {0}</h1><p>{1}</p><p>Read it first and subscribe today.</p><blockquote>Kept by the house</blockquote></article><div class='lead'>Lead {0} {2}</div><div class='end'>The end</div>"
    rows = [(k, inner.format(k, words(k, 40), words(100 + k, 6))) for k in range(6)]
    rows += [(10 + j, inner.format("same", words(50, 40) + f" edit{j}", words(150, 6))) for j in range(8)]  # near copies
    rows = [(k, f"http://w.example/{k}", PAGE.format(x)) for k, x in rows]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", htmltext.host_of(F.col("url")))
    got = {r.page_id: r.text for r in htmltext.extract_pages(pages).collect()}
    for k in range(6):
        assert got[k] == f"Head {k}\n{words(k, 40)}\nLead {k} {words(100 + k, 6)}"
    for j in range(8):
        assert got[10 + j] == f"Head same\n{words(50, 40)} edit{j}\nLead same {words(150, 6)}"


@pytest.mark.parametrize("name, out", [("ad", True), ("site-footer", True), ("left-sidebar", True), ("comment-list", True), ("cookieNotice", True), ("ad-slot-1", True), ("related posts", True), ("page-header", True), ("has-sidebar", False), ("sidebar-right", False), ("post-content", False), ("headline", False), ("address", False), ("shadow", False), ("entry", False)])
def test_names_of_blocks(name, out):
    assert htmltext.not_content(name) == out


def test_blocks_inside_and_outside_of_an_article():
    page = """<body class="has-sidebar no-js"><header><p>Head</p></header><div class="layout sidebar-right"><article><h1>Title &lt;1&gt;</h1>
    <p>One <b>bold</b> <i>word</i>.<p>Two<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><div class="share-box">Share</div><form>Name <input></form>
    <section id="comments"><article><p>A reader says</p></article></section><style>p{}</style></article><aside>Side</aside></div><div id="cookieNotice">Cookies</div></body>"""
    root = htmltext.parse(page)
    htmltext.skeleton(root)
    assert "\n".join(t for _, inside, t in htmltext.parts_of(root) if inside) == "Title <1>\nOne bold word.\nTwo\na\nb\nc\nd"


def test_tree_matching():
    a = ["r", [["x", []], ["y", [["z", []]]], ["w", []]]]
    b = ["r", [["y", [["z", []]]], ["w", []], ["v", []]]]
    assert htmltext.align(a, b) == {0: 0, 2: 1, 3: 2, 4: 3}
    assert htmltext.align(["q", []], b) == {}


def toxic_rows(n, start):
    rng = np.random.default_rng(start)
    plain = ["river", "stone", "walks", "under", "green", "paper", "seven", "lamps", "quiet", "water"]
    out = []
    for k in range(n):
        words = [plain[i] + str(int(rng.integers(0, 50)) or "") for i in rng.integers(0, 10, 40)]
        bad = k % 5 == 0
        if bad:
            words[int(rng.integers(0, 40))] = "blorg" + ["", "ish", "ed", "ful"][k // 5 % 4] if k % 10 else "skunkhead"
        out.append((start + k, " ".join(words) + ".", int(bad)))
    return out


def test_toxicity(spark):
    train, test = toxic_rows(300, 0), toxic_rows(100, 5000)
    docs = spark.createDataFrame([(i, t) for i, t, _ in train + test] + [(9001, None), (9002, ""), (9003, "quiet water " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in train] + [(77777, 1), (None, 1), (3, None), (0, 1), (0, 0)], "doc_id long, toxic int")
    grammar = toxicity.learned(toxicity.training_rows(docs, labels))
    got = {r.doc_id: r.score for r in toxicity.score(docs, grammar).collect()}
    assert len(got) == docs.count() and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.5) != y for i, _, y in test) == 0
    assert got[9001] == got[9002] == got[9003] < 0.5
    kept = toxicity.keep_clean(docs.withColumn("score", F.lit("clash")), labels)
    assert kept.columns == ["doc_id", "text", "score"]
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}
    none = toxicity.learned(toxicity.training_rows(docs, labels.limit(0)))
    assert toxicity.score(docs, none).count() == docs.count()
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_composed_machine_does_what_its_machines_do_in_turn():
    rng = np.random.default_rng(6)
    every = toxicity.machines()
    whole = toxicity.Grammar([]).forward
    for _ in range(400):
        letters = rng.choice([toxicity.OTHER, toxicity.INSULT, toxicity.INTENT, toxicity.HARM, toxicity.TARGET, toxicity.NEGATION, toxicity.REPORT], rng.integers(0, 15)).tolist()
        want = letters
        for name in toxicity.FORWARD:
            want, _ = every[name].run(want)
        assert whole.run(letters)[0] == want


@pytest.mark.parametrize("name, text", [("threat", "i will kill you"), ("report", "he said idiot"), ("negation", "not an idiot"), ("target_before", "you idiot"), ("target_after", "idiot, you")])
def test_each_machine_changes_the_score(name, text):
    stems = [("idiot", "word", 1.0)]
    assert toxicity.Grammar(stems).score(text) != toxicity.Grammar(stems, without=(name,)).score(text)


def test_toxic_ties(spark):
    """Equal texts have equal scores, and a label that contradicts another of the same text does not matter beyond the larger."""
    rows = [(k, "a blorg here" if k % 4 == 0 else f"fine text {k}") for k in range(80)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(80)] + [(4, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.learned(toxicity.training_rows(docs, labels))).collect()
    assert len({r.score for r in got if r.doc_id % 4 == 0}) == 1


def test_grammar_events():
    g = toxicity.Grammar([("idiot", "word", 1.0), ("blor", "prefix", 1.0), ("gram", "again", 1.0)])
    of = lambda t: dict(zip(toxicity.EVENTS, g.events(t)))
    assert of("What an idiot! Fine.")["plain"] == 1
    assert of("you idiot")["aimed"] == 1 and of("idiot, you")["aimed"] == 1
    assert of("you are not an idiot")["negated"] == 1
    assert of("he said idiot twice")["reported"] == 1
    assert of("i will kill you")["threat"] == 1
    assert sum(of("idiotic but blorful").values()) == 1
    assert sum(of("a gram, the gram.").values()) == 0 and sum(of("a gram and grammar. Grams").values()) == 2
    assert sum(of("subblor").values()) == 0 and sum(of(None).values()) == 0


def test_urls(spark):
    caps = spark.createDataFrame([
        (1, "http://a.Bad.example:80/x", "2024-01-31"), (2, "https://u@a.bad.example/x", "2024-02-01"), (3, "http://bad.example", "2024-02-15"), (4, "http://bad.example/", "2024-03-01"),
        (5, "http://notbad.example/", "2024-02-05"), (6, "http://ok.example/p/q?x=/p/r/", "2024-02-05"), (7, "http://ok.example/p/r/s", "2024-02-05"), (8, None, "2024-02-05"), (9, "nonsense", "2024-02-05"), (10, "http://bad.example", None),
        (2, "https://u@a.bad.example/x", "2024-02-01"), (11, "http://tie.example", "2024-02-05"),
    ], "id int, url string, fetched string").withColumn("matched", F.lit("clash")).withColumn("key", F.lit("clash"))
    entries = spark.createDataFrame([
        ("2024-02-01", "add", "domain", "BAD.example"), ("2024-03-01", "remove", "domain", "bad.example"), ("2024-02-01", "add", "prefix", "ok.example/p/r/"),
        ("2024-02-01", "add", "domain", "tie.example"), ("2024-02-01", "remove", "domain", "tie.example"), (None, "add", "domain", "ok.example"),
    ], "at string, action string, kind string, value string")
    odd = spark.createDataFrame([(1, "http://b.example.com.:80/x", "2024-02-05"), (2, "http://a.example.com/x y/z", "2024-02-05"), (3, "http://[2001:db8::1]:8080/q", "2024-02-05"), (4, "http://b.example.com/" + "p/" * 3000, "2024-02-05")], "id int, url string, fetched string")
    rules = spark.createDataFrame([("2024-01-01", "add", "domain", "b.example.com"), ("2024-01-01", "add", "prefix", "a.example.com/x y/"), ("2024-01-01", "add", "domain", "[2001:db8::1]")], "at string, action string, kind string, value string")
    assert {r.id: r.matched for r in urls.judge(odd, rules).collect()} == {1: "b.example.com", 2: "a.example.com/x y/", 3: "[2001:db8::1]", 4: "b.example.com"}
    got = sorted((r.id, r.blocked, r.matched, r.n_active) for r in urls.judge(caps, entries).collect())
    assert [g[0] for g in got if g[1]] == [2, 2, 3, 7]
    assert dict((g[0], g[2]) for g in got if g[1]) == {2: "bad.example", 3: "bad.example", 7: "ok.example/p/r/"}
    assert len(got) == 12
    assert urls.judge(caps, entries.limit(0)).filter("blocked").count() == 0
    assert urls.judge(caps.limit(0), entries).count() == 0
