"""Set operators against Python's own sets, on random and on awkward inputs."""

import random

import numpy as np
import pytest

from setloom.operators import frames, intervals, metrics, multi, navigation, packed, position, rank, relations, sets

EDGES = [set(), {0}, {(1 << 48) - 2}, set(range(50)), {65535, 65536, 131072}, {1, 2, 3}, {0, 32767, 32768, 32769, 65535, 65536, 1 << 33, (1 << 33) + 1}]


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def ids(df):
    got = [r[0] for r in df.select("id").collect()]
    assert len(got) == len(set(got))
    return set(got)


def samples():
    rng = random.Random(5)
    return EDGES + [set(rng.sample(range(200_000), 300)), set(rng.sample(range(1 << 40), 200))]


@pytest.mark.parametrize("k", range(9))
def test_algebra(spark, k):
    a, b = samples()[k], samples()[(k + 3) % 9]
    x, y = frames.set_of(spark, a), frames.set_of(spark, b)
    assert ids(sets.bit_and(x, y)) == a & b
    assert ids(sets.bit_or(x, y)) == a | b
    assert ids(sets.bit_xor(x, y)) == a ^ b
    assert ids(sets.bit_sub(x, y)) == a - b
    first = min(a ^ b, default=None)
    assert sets.first_mismatch(x, y).first()[0] == first
    assert sets.compare(x, y).first()[0] == (0 if first is None else 1 if first in a else -1)
    d = metrics.distances(x, y).first()
    assert (d.cnt_and, d.cnt_or, d.cnt_xor, d.sub_ab, d.sub_ba, d.cnt_a, d.cnt_b) == (len(a & b), len(a | b), len(a ^ b), len(a - b), len(b - a), len(a), len(b))


@pytest.mark.parametrize("k", range(9))
def test_rank_and_runs(spark, k):
    a = samples()[k]
    x = frames.set_of(spark, a)
    order = sorted(a)
    assert rows(rank.with_rank(x)) == sorted((v, i + 1) for i, v in enumerate(order))
    probes = sorted({0, 1, 65535, 65536, 200_000, 1 << 41, *order[::7]})
    got = {r.probe: r for r in rank.ranks(x, frames.set_of(spark, probes)).collect()}
    for p in probes:
        upto = sum(v <= p for v in order)
        assert (got[p].rank, got[p].member, got[p].corrected) == (upto, p in a, upto - (p in a))
    before = {r.probe: r.found for r in relations.nearest_before(frames.set_of(spark, probes), x).collect()}
    assert before == {p: max((v for v in order if v <= p), default=None) for p in probes}
    assert rows(navigation.with_next(x)) == sorted(zip(order, [*order[1:], None])) if len(order) > 1 else True
    runs, start = [], None
    for i, v in enumerate(order):
        start = v if i == 0 or order[i - 1] != v - 1 else start
        if i + 1 == len(order) or order[i + 1] != v + 1:
            runs.append((start, v))
    assert rows(intervals.islands(x)) == runs
    assert ids(packed.unpack(packed.pack(x))) == a
    assert packed.packed_count(packed.pack(x)).first()[0] == len(a)


def test_count_intervals_of_known_words(spark):
    def of(bits):
        return metrics.count_intervals(frames.set_of(spark, [i for i, b in enumerate(bits) if b == "1"])).first()[0]

    assert of("") == 1
    assert of("10001111100000") == 4
    assert of("01110") == 3


def test_is_interval_flanks(spark):
    x = frames.set_of(spark, [1, 2, 3])
    assert intervals.is_interval(x, 1, 3).first()[0]
    assert not intervals.is_interval(frames.set_of(spark, [0, 1, 2, 3]), 1, 3).first()[0]


def test_range_split(spark):
    x = frames.set_of(spark, [5, 6, 9, 12, 70_000])
    assert rows(rank.range_split(x, 2)) == [(5, 6), (7, 12), (13, 70_000)]
    assert rows(rank.range_split(x, 0)) == [(5, 70_000)]
    assert rows(rank.range_split(frames.empty_set(spark), 2)) == []


def test_shift_right_and_finds_runs(spark):
    text = "ACACAC"
    at = {c: frames.set_of(spark, [i for i, x in enumerate(text) if x == c]) for c in "AC"}
    ends = ids(multi.shift_right_and(at["A"], at["C"], at["A"]))
    assert {e - 2 for e in ends} == {0, 2}


def test_positions(spark):
    a = {0, 3, 4, 9}
    x = frames.set_of(spark, a)
    assert ids(position.shift_right(x)) == {v + 1 for v in a}
    assert ids(position.shift_left(x)) == {v - 1 for v in a if v}
    assert position.carry_left(x).first()[0]
    assert ids(position.insert_bit(x, 4)) == {0, 3, 4, 5, 10}
    assert ids(position.erase_bit(x, 3)) == {0, 3, 8}
    assert ids(sets.swap(x, 3, 100)) == {0, 100, 4, 9}


def test_packed_operations(spark):
    a, b = {0, 1, 40_000, 99_999}, {1, 2, 40_000}
    x, y = packed.pack(frames.set_of(spark, a)), packed.pack(frames.set_of(spark, b))
    for op, want in (("AND", a & b), ("OR", a | b), ("XOR", a ^ b), ("SUB", a - b), ("SUB_BA", b - a)):
        assert ids(packed.unpack(packed.packed_op(x, y, op))) == want
        assert packed.packed_op(x, y, f"COUNT_{op}").first()[0] == len(want)
    for bits in (8, 16, 32, 64):
        assert ids(packed.from_words(packed.words(frames.set_of(spark, a), bits), bits)) == a


def test_address_space(spark):
    assert frames.checked(frames.set_of(spark, [0, (1 << 48) - 2])).count() == 2
    with pytest.raises(Exception, match="address space"):
        frames.checked(frames.set_of(spark, [-1])).collect()


def test_exact_sample(spark):
    x = frames.full_set(spark, 1000)
    one, two = ids(navigation.sample(x, 10)), ids(navigation.sample(x, 10))
    assert one == two and len(one) == 10
    assert ids(navigation.sample(x, 2000)) == set(range(1000))


def test_layout_against_brute_force_in_one_stream(spark):
    """Groups of one run, large groups, NULL groups and ends, runs that stop before they start; no call for each group."""
    rng = np.random.default_rng(4)
    rows = [(int(g) if g else None, i, int(s), int(s + w)) for i, (g, s, w) in enumerate(zip(rng.integers(0, 40, 900), rng.integers(0, 200, 900), rng.integers(-2, 30, 900)))]
    rows += [(100 + i, 0, i, i + 3) for i in range(300)] + [(7, 1000, None, 5), (7, 1001, 3, None), (7, 1002, 1, 9)]
    frame = spark.createDataFrame(rows, "g long, ord long, start long, stop long")
    out = intervals.lay_out(frame, "g")
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    want, planes = [], {}
    nan = float("nan")
    for g, _, s, e in sorted(rows, key=lambda r: r[1]):
        x, y = (nan if s is None else s), (nan if e is None else e)
        held = planes.setdefault(g, [])
        k = next((k for k, p in enumerate(held) if all(y < a or x > b for a, b in p)), len(held))
        if k == len(held):
            held.append([])
        held[k].append((x, y))
        want.append((g, s, e, k))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))
