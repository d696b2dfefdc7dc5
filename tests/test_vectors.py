"""Vector operators on NULLs, signs, uneven lengths; expressions; plans; sources."""

import struct

import pytest
from pyspark.sql import functions as F

from setloom import functions as fn
from setloom.operators import frames, search, vectors
from setloom.plans import analytics, ordering
from setloom.sources import postings, readers, writers
from setloom.streaming import postings as streamed

INTS = [0, None, 1, -1, -(1 << 31), (1 << 31) - 1]


def table(df):
    return {r.idx: r.value for r in df.collect()}


def ids(df):
    return {r.id for r in df.collect()}


def test_codes_round_trip(spark):
    v = frames.vector_of(spark, INTS)
    got = v.select("value", fn.signed_code("value").alias("c"), fn.signed_value(fn.signed_code("value")).alias("b")).collect()
    for r in got:
        assert r.b == r.value
        if r.value is not None:
            assert r.c == (2 * r.value if r.value >= 0 else 2 * (-r.value - 1) + 1)


def test_null_contract(spark):
    v = frames.vector_of(spark, INTS)
    assert ids(search.find_zero(v)) == {0}
    assert ids(search.find_zero(v, False)) == {0, 1}
    assert ids(search.find_nonnegative(v)) == {0, 1, 2, 5}
    assert ids(search.find_nonzero(v)) == {2, 3, 4, 5}
    assert ids(search.invert_result(v, search.find_gt(v, 0))) == {0, 3, 4}
    assert ids(search.find_range(v, 1, -1)) == {0, 2, 3}


def test_floats(spark):
    v = frames.vector_of(spark, [float("-inf"), -1.0, -0.0, 0.0, 1.0, float("inf"), float("nan"), None], "float")
    assert ids(search.find_gt(v, 0.0)) == {4, 5, 6}
    assert ids(search.find_le(v, 0.0)) == {0, 1, 2, 3}
    assert ids(search.find_range_open(v, 2.0, -2.0)) == {1, 2, 3, 4}


def test_float_parts_are_the_raw_bits_and_give_the_number_back(spark):
    raw = [0, 1 << 31, 1, 0x807FFFFF, 0x00800000, 0x3F800000, 0xC2280000, 0x7F7FFFFF, 0x7F800000, 0xFF800000, 0x7FC00000]
    values = [struct.unpack("<f", struct.pack("<I", r))[0] for r in raw]
    v = frames.vector_of(spark, [*values, None], "float")
    got = v.select("idx", fn.float_parts("value").alias("p"), "value").select("*", fn.float_of("p").alias("back"), (fn.float_of("p") == F.col("value")).alias("same")).orderBy("idx").collect()
    assert [r.p.sign << 31 | r.p.exponent << 23 | r.p.mantissa for r in got[:-1]] == raw
    assert [struct.pack("<f", r.back) for r in got[:-1]] == [struct.pack("<I", r) for r in raw]
    assert all(r.same for r in got[:-1]) and got[-1].p is None and got[-1].back is None


def test_float_parts_query_holds_for_zero(spark, tmp_path):
    from setloom.queries import QUERIES

    spark.createDataFrame([(1, 0.0), (2, -0.0), (3, 2.5), (4, None)], "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    assert {(r.idx, r.same) for r in QUERIES["float_parts"](spark, str(tmp_path)).collect()} == {(1, True), (2, True), (3, True)}


def test_mismatch_rules(spark):
    a = frames.vector_of(spark, [1, None, 3, None, 5, None])
    b = frames.vector_of(spark, [1, None, None, 4, 6, None, 7, None])
    assert ids(vectors.mismatch(a, b)) == {2, 3, 4, 6, 7}
    assert ids(vectors.mismatch(a, b, use_null=False)) == {2, 3, 4, 6}
    assert vectors.first_mismatch(a, b).first()[0] == 2
    assert vectors.equal(a, a).first()[0]


def test_rewrites(spark):
    v = frames.vector_of(spark, [1, None, 3, 4])
    mask = frames.set_of(spark, [1, 2])
    assert table(vectors.clear_mask(v, mask)) == {0: 1, 1: None, 2: 0, 3: 4}
    assert table(vectors.set_null_mask(v, mask)) == {0: 1, 1: None, 2: None, 3: 4}
    assert table(vectors.filter_mask(v, mask)) == {0: None, 1: None, 2: 3, 3: None}
    assert table(frames.push_back_null(frames.push_back(v, 9), 1)) == {0: 1, 1: None, 2: 3, 3: 4, 4: 9, 5: None}
    with pytest.raises(Exception, match="ascend"):
        frames.push_ascending(v, frames.vector_of(spark, [1], offset=2)).collect()
    with pytest.raises(Exception, match="past the end"):
        vectors.at(v, 4).collect()
    deltas = spark.createDataFrame([(1, 2), (1, 3), (9, 1)], "idx long, delta long")
    assert table(vectors.increment(v, deltas)) == {0: 1, 1: 5, 2: 3, 3: 4, 9: 1}


def test_clips(spark):
    for x in (0, 1, 5, 16, 17, 31, 32, 33, 48, 100, 1000):
        r = spark.range(1).select(fn.clip_high(F.lit(x), 3).alias("h"), fn.clip_low(F.lit(x), 4).alias("l")).first()
        assert r.h == (15 if x >> 4 else x)
        assert r.l == ((x >> 4 << 4) | (16 if ((x >> 5) != 0) != ((x & 15) != 0) else 0))


def test_kleene(spark):
    vals = [True, False, None]
    code = {True: 1, False: -1, None: 0}
    rows = spark.createDataFrame([(a, b) for a in vals for b in vals], "a boolean, b boolean")
    for r in rows.select("a", "b", fn.kleene(fn.kleene_and("a", "b")).alias("x"), fn.kleene(fn.kleene_or("a", "b")).alias("y"), fn.kleene(fn.kleene_not("a")).alias("z")).collect():
        assert (r.x, r.y, r.z) == (min(code[r.a], code[r.b]), max(code[r.a], code[r.b]), -code[r.a])


def test_texts(spark):
    v = frames.vector_of(spark, ["", "a", "ab", None, "abc", "é"], "string")
    assert ids(search.find_eq(v, "")) == {0}
    assert ids(search.find_prefix(v, "ab")) == {2, 4}
    assert {r.idx: r.o for r in v.select("idx", fn.octet("value", 1).alias("o")).collect()} == {0: 0, 1: 0, 2: 98, 3: 0, 4: 98, 5: 0xA9}
    pair = spark.createDataFrame([("abc", "abd"), ("", "a"), ("é", "è"), (None, None)], "a string, b string")
    assert [r[0] for r in pair.select(fn.common_prefix("a", "b")).collect()] == [2, 0, 1, 0]
    order = ordering.ordered_index(spark.createDataFrame([(x,) for x in ["b", "a", "ab", "é", ""]], "value string"), "value")
    assert {r.value: r.idx for r in order.collect()} == {x: i for i, x in enumerate(sorted(["b", "a", "ab", "é", ""], key=lambda s: s.encode()))}


@pytest.mark.parametrize("k, places", [(1, 1 << 23), (3, 7), (5, 1 << 23), (5, 40), (30, 50)])
def test_kmer_counts_against_brute_force(spark, monkeypatch, k, places):
    monkeypatch.setattr(analytics, "PLACES", places)
    texts = ["", None, "ab", "abcabcabcabc", "é€😀" * 15, "zzzzzzzzz", "a😀", "x" * 70, "".join(chr(0x4E00 + i * 7 % 900) for i in range(400)) * 2]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {}
    for t in texts:
        for i in range(len(t or "") - k + 1):
            want[t[i : i + k]] = want.get(t[i : i + k], 0) + 1
    rows = analytics.kmer_counts(docs, k).collect()
    assert len(rows) == len(want) and {r.kmer: r.cnt for r in rows} == want


def test_kmers_become_rows_only_when_counted():
    """One letter over and over: a place is no row."""
    import numpy as np

    left = np.arange(100_000, 0, -1)
    got = analytics.counted_kmers(np.full(100_000, 97, np.uint32), left, 5).to_pylist()
    assert got == [{"kmer": "aaaaa", "cnt": 99_996}]


def test_a_task_adds_up_the_kmers_of_all_its_places():
    """Rows that leave a task follow the kinds of its k-mers, not its share of the text."""
    import pyarrow as pa

    def batch(kmers, cnt):
        return pa.RecordBatch.from_arrays([pa.array(kmers, pa.string()), pa.array([cnt] * len(kmers), pa.int64())], ["kmer", "cnt"])

    few = list(analytics.added_up((batch(["ab", "bc", "\U0001f600"], i) for i in range(100)), 10))
    assert sorted((r["kmer"], r["cnt"]) for b in few for r in b.to_pylist()) == [("ab", 4950), ("bc", 4950), ("\U0001f600", 4950)]
    many = [b.num_rows for b in analytics.added_up((batch([f"{i}-{j}" for j in range(4)], 1) for i in range(100)), 10)]
    assert sum(many) == 400 and max(many) <= 13
    assert list(analytics.added_up(iter([]), 10)) == []


def test_kmer_histogram_makes_no_row_for_each_place(spark):
    docs = spark.createDataFrame([(1, "ababab"), (2, "abc"), (3, None)], "doc_id long, text string")
    got = analytics.kmer_histogram(docs, 2)
    assert "Generate" not in got._jdf.queryExecution().toString()
    assert {r.cnt: r.kinds for r in got.collect()} == {4: 1, 2: 1, 1: 1}


def test_leaders(spark):
    sets = {"a": {1, 2, 3}, "b": {1, 2, 3, 4}, "c": {3, 4, 5, 6}, "d": {1, 2, 3, 4}, "e": {9}}
    frame = spark.createDataFrame([(k, i) for k, s in sets.items() for i in s], "set_id string, id long")
    got = {r.set_id: r.leader for r in analytics.cluster_leaders(frame, 0.7).collect()}
    want, leaders = {}, []
    for k, s in sets.items():
        hit = next((l for l in leaders if len(sets[l] & s) / len(sets[l] | s) >= 0.7), None)
        want[k] = hit or k
        leaders += [] if hit else [k]
    assert got == want


def test_octet_codes_round_trip(spark):
    from setloom.operators.metrics import octet_statistics

    codes = analytics.octet_codes(octet_statistics(frames.vector_of(spark, ["abc", "abd", "xbc"], "string")))
    r = analytics.encode_text("abd", codes).first()
    assert r.mappable and analytics.decode_text(r.code, codes).first().value == "abd"
    assert not analytics.encode_text("zzz", codes).first().mappable


def test_sources(spark, tmp_path):
    lists = [[1, 5, 70_000], [], [3]]
    (tmp_path / "lists.bin").write_bytes(b"".join(struct.pack(f"<{len(x) + 1}I", len(x), *x) for x in lists))
    spark.dataSource.register(postings.PostingsSource)
    got = spark.read.format("postings").load(str(tmp_path / "lists.bin")).collect()
    assert sorted((r.set_id, r.id) for r in got) == [(0, 1), (0, 5), (0, 70_000), (2, 3)]
    (tmp_path / "range.txt").write_text("a 10 20 x\nb 5 4 y\na 30 31 z\n")
    index = readers.read_range_index(spark, str(tmp_path / "range.txt"))
    assert sorted(map(tuple, analytics.range_search(index, "a").collect())) == [(10, 20, "x"), (30, 31, "z")]
    (tmp_path / "seq.fa").write_text(">head\nACGT\nAC\n")
    seq = readers.read_sequence(spark, str(tmp_path / "seq.fa"))
    assert "".join(r.letter for r in seq.orderBy("pos").collect()) == "ACGTAC"
    (tmp_path / "names.txt").write_text("1|beta|x\n2|alpha|y\n3|beta|z\n")
    assert table(readers.read_dictionary(spark, str(tmp_path / "names.txt"))) == {0: "alpha", 1: "beta"}
    (tmp_path / "links.tsv").write_text("3\t4\n1\t2\n")
    assert readers.read_links(spark, str(tmp_path / "links.tsv")).count() == 2
    (tmp_path / "snp.tsv").write_text("rs12\t1\t500\nrs13\t1\t700\n")
    assert table(readers.read_positions_report(spark, str(tmp_path / "snp.tsv"))) == {500: 12, 700: 13}
    (tmp_path / "bars.csv").write_text("time,open,high,low,close,volume\nt,2,3,1,3,10\n")
    assert readers.read_bars(spark, str(tmp_path / "bars.csv")).first().pct == 50
    v = frames.vector_of(spark, [4, None, 6])
    writers.write_vector(v, str(tmp_path / "v"))
    assert table(readers.read_vector(spark, str(tmp_path / "v"))) == {0: 4, 1: None, 2: 6}
    assert table(readers.read_range(spark, str(tmp_path / "v"), 2, 1)) == {1: None, 2: 6}
    assert table(readers.read_masked(spark, str(tmp_path / "v"), frames.set_of(spark, [0]))) == {0: 4}
    assert writers.stored_size(str(tmp_path / "v"), v) > 0


def test_streamed_postings(spark, tmp_path):
    schema = "set_id string, id long"
    for k, part in enumerate([[("a", 1), ("b", 2)], [("a", 1), ("a", 40_000)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    streamed.start(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = streamed.current(spark, str(tmp_path / "out")).select("set_id", F.bitmap_count("bitmap").alias("n"))
    assert {r.set_id: r.n for r in got.groupBy("set_id").agg(F.sum("n").alias("n")).collect()} == {"a": 2, "b": 1}
