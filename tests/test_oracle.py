"""Every query against its SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["l_suppkey", "cnt"] and rows.count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    if FOLDER.endswith("sf0.001") and name in ("at", "image_single"):
        pytest.skip("the smallest tables have no such index")
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    rel = duck.sql(SQL[name])
    names = list(rel.columns)
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
    assert got == want


def test_queries_without_sql_give_rows(spark):
    for name in ("cluster_leaders", "random_subset", "interval_layout"):
        assert entry.queries()[name](spark, FOLDER).count() > 0


def test_texts_against_brute_force(spark):
    from collections import Counter

    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall())
    run = lambda name: entry.queries()[name](spark, FOLDER).collect()
    grams = Counter(t[i : i + 5] for t in texts.values() for i in range(len(t) - 4))
    assert {r.kmer: r.cnt for r in run("doc_kmer_counts")} == grams
    assert {r.cnt: r.kinds for r in run("doc_kmer_histogram")} == Counter(grams.values())
    starts = {(d, i) for d, t in texts.items() for i in range(len(t)) if t.startswith("the", i)}
    assert {(r.doc_id, r.start) for r in run("doc_word_starts")} == starts
    chars = Counter((i, c) for t in texts.values() for i, c in enumerate(t))
    assert {(r.pos, r.ch): r.cnt for r in run("doc_octet_stat")} == chars
