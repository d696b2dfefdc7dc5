"""One query and one SQL text for each operator, over the test tables.

Sets: A orders of status F, B orders above 150,000, T urgent orders. Vector: order to customer, every seventh NULL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from .operators import frames, intervals, metrics, multi, navigation, packed, position, rank, relations, search, sets, vectors
from .plans import analytics, ordering
from .sources import readers, writers
from .storage import ensure_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when asked for, and the frames made of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def A(self):
        return self.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))

    @property
    def B(self):
        return self.orders.filter("o_totalprice > 150000").select(F.col("o_orderkey").alias("id"))

    @property
    def T(self):
        return self.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))

    @property
    def V(self):
        """Nullable vector."""
        return frames.vector(self.orders, "o_orderkey", F.expr("CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END"))

    @property
    def W(self):
        """Second vector: 0 by the tenth, NULL by the eleventh, negative by the third."""
        return frames.vector(self.orders, "o_orderkey", F.expr("CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN -o_custkey ELSE o_custkey END"))

    @property
    def X(self):
        """Float vector of events."""
        return frames.vector(self.events, "event_id", F.expr("CASE WHEN event_id % 9 <> 0 THEN cast(value AS float) END"))

    @property
    def N(self):
        """Text vector of parts, NULL by the thirteenth, empty by the seventeenth."""
        return frames.vector(self.part, "p_partkey", F.expr("CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END"))

    @property
    def P(self):
        """Collection: priority to orders."""
        return frames.collection(self.orders, "o_orderpriority", "o_orderkey")

    @property
    def C(self):
        """Collection: priority to customers."""
        return frames.collection(self.orders, "o_orderpriority", "o_custkey")

    @property
    def L(self):
        """Links: customer to order."""
        return frames.edges(self.orders, "o_custkey", "o_orderkey")


A = "A AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F')"
B = "B AS (SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 150000)"
T = "T AS (SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT')"
V = "V AS (SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS value FROM orders)"
W = "W AS (SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN -o_custkey ELSE o_custkey END AS value FROM orders)"
X = "X AS (SELECT event_id AS idx, CASE WHEN event_id % 9 <> 0 THEN CAST(value AS FLOAT) END AS value FROM events)"
N = "N AS (SELECT p_partkey AS idx, CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 17 = 0 THEN '' ELSE p_name END AS value FROM part)"
P = "P AS (SELECT DISTINCT o_orderpriority AS set_id, o_orderkey AS id FROM orders)"
C = "C AS (SELECT DISTINCT o_orderpriority AS set_id, o_custkey AS id FROM orders)"
L = "L AS (SELECT o_custkey AS src, o_orderkey AS dst FROM orders)"
R = "R AS (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM A)"
I = "I AS (SELECT min(id) AS start, max(id) AS stop FROM (SELECT id, id - row_number() OVER (ORDER BY id) AS g FROM A) GROUP BY g)"
CODE = "(CASE WHEN {0} >= 0 THEN 2 * {0} ELSE 2 * (-({0} + 1)) + 1 END)"
DECODE = "(CASE WHEN {0} % 2 = 0 THEN {0} // 2 ELSE -({0} // 2) - 1 END)"


def query(name: str, sql: str | None, *ctes: str):
    """Registers a function of Tables with its SQL."""

    def put(function):
        QUERIES[name] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = f"WITH {', '.join(ctes)} {sql}" if ctes else sql
        return function

    return put


def simple(name: str, function, sql: str | None, *ctes: str) -> None:
    query(name, sql, *ctes)(function)


# relations of a star: the flagship
simple("fk_star", lambda t: analytics.flagship(t.lineitem, t.supplier, 7, 1997), "SELECT l_suppkey, count(*) AS cnt FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_returnflag <> 'R' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 7) GROUP BY l_suppkey")

# set algebra
for _name, _op, _sql in (("and", sets.bit_and, "INTERSECT"), ("or", sets.bit_or, "UNION"), ("sub", sets.bit_sub, "EXCEPT")):
    simple(f"set_{_name}", lambda t, op=_op: op(t.A, t.B), f"SELECT id FROM A {_sql} SELECT id FROM B", A, B)
simple("set_xor", lambda t: sets.bit_xor(t.A, t.B), "(SELECT id FROM A EXCEPT SELECT id FROM B) UNION (SELECT id FROM B EXCEPT SELECT id FROM A)", A, B)
simple("set_combine_operation", lambda t: sets.combine(t.A, t.T, "sub"), "SELECT id FROM A EXCEPT SELECT id FROM T", A, T)
simple("set_or_and", lambda t: sets.bit_or_and(t.T, t.A, t.B), "SELECT id FROM T UNION (SELECT id FROM A INTERSECT SELECT id FROM B)", A, B, T)
simple("set_merge", lambda t: sets.merge(t.A, t.T), "SELECT id FROM A UNION SELECT id FROM T", A, T)
simple("set_invert", lambda t: sets.invert(t.A, 200000), "SELECT range AS id FROM range(200000) EXCEPT SELECT id FROM A", A)
simple("set_import", lambda t: frames.as_set(t.orders, "o_custkey"), "SELECT DISTINCT o_custkey AS id FROM orders")
simple("set_literal", lambda t: frames.set_of(t.spark, [5, 3, 3, 9, 65536]), "SELECT unnest([3, 5, 9, 65536])::BIGINT AS id")
simple("set_checked", lambda t: frames.checked(t.A), "SELECT id FROM A", A)
simple("set_keep_ids", lambda t: sets.keep(t.A, t.T), "SELECT id FROM A WHERE id IN (SELECT id FROM T)", A, T)
simple("set_clear_ids", lambda t: sets.clear(t.A, t.T), "SELECT id FROM A WHERE id NOT IN (SELECT id FROM T)", A, T)
simple("set_range", lambda t: sets.set_range(t.A, 1200, 1000), "SELECT id FROM A UNION SELECT range AS id FROM range(1000, 1201)", A)
simple("set_clear_range", lambda t: sets.clear_range(t.A, 100, 9000), "SELECT id FROM A WHERE id NOT BETWEEN 100 AND 9000", A)
simple("set_keep_range", lambda t: sets.keep_range(t.A, 9000, 100), "SELECT id FROM A WHERE id BETWEEN 100 AND 9000", A)
simple("set_copy_range", lambda t: sets.copy_range(t.A, 5, 700), "SELECT id FROM A WHERE id BETWEEN 5 AND 700", A)
simple("set_full", lambda t: frames.full_set(t.spark, 1000), "SELECT range AS id FROM range(1000)")
simple("set_empty", lambda t: frames.empty_set(t.spark), "SELECT range AS id FROM range(0)")
simple("set_bit", lambda t: sets.set_bit(sets.set_bit(t.A, 1, False), 20000), "SELECT id FROM A WHERE id <> 1 UNION SELECT 20000 AS id", A)
simple("set_bit_conditional", lambda t: sets.set_bit_conditional(t.A, 20000, True, False), "SELECT id FROM A UNION SELECT 20000 AS id", A)
simple("set_bit_and", lambda t: sets.set_bit_and(t.A, 1, False), "SELECT id FROM A WHERE id <> 1", A)
simple("set_flip", lambda t: sets.flip(t.A, 1), "SELECT id FROM A WHERE id <> 1 UNION SELECT 1 AS id WHERE NOT EXISTS (SELECT 1 FROM A WHERE id = 1)", A)
simple("set_inc_carry", lambda t: sets.increment(t.A, 1)[1], "SELECT count(*) > 0 AS carry FROM A WHERE id = 1", A)
simple("set_resize", lambda t: sets.resize(t.A, 5000), "SELECT id FROM A WHERE id < 5000", A)
simple("set_swap", lambda t: sets.swap(t.A, 1, 20000), "SELECT CASE WHEN id = 1 THEN 20000 WHEN id = 20000 THEN 1 ELSE id END AS id FROM A", A)
_ids = lambda t: t.orders.select(F.col("o_orderkey").alias("id"))
simple("set_test", lambda t: sets.test(t.A, _ids(t)), "SELECT o_orderkey AS id, o_orderkey IN (SELECT id FROM A) AS member FROM orders", A)
simple("set_compare", lambda t: sets.compare(t.A, t.B), "SELECT CAST(CASE WHEN m IS NULL THEN 0 WHEN m IN (SELECT id FROM A) THEN 1 ELSE -1 END AS INTEGER) AS cmp FROM (SELECT min(id) AS m FROM ((SELECT id FROM A EXCEPT SELECT id FROM B) UNION (SELECT id FROM B EXCEPT SELECT id FROM A)))", A, B)
simple("set_first_mismatch", lambda t: sets.first_mismatch(t.A, t.B), "SELECT min(id) AS first_mismatch FROM ((SELECT id FROM A EXCEPT SELECT id FROM B) UNION (SELECT id FROM B EXCEPT SELECT id FROM A))", A, B)
simple("set_equal", lambda t: sets.equal(t.A, t.A.filter("id % 2 = 0").unionByName(t.A.filter("id % 2 <> 0"))), "SELECT count(*) = 0 AS equal FROM A WHERE id NOT IN (SELECT id FROM A)", A)
simple("set_unequal", lambda t: sets.equal(t.A, t.B), "SELECT count(*) = 0 AS equal FROM ((SELECT id FROM A EXCEPT SELECT id FROM B) UNION ALL (SELECT id FROM B EXCEPT SELECT id FROM A))", A, B)
_SEQ = "S AS (SELECT o_custkey AS id FROM orders)"
_seq = lambda t: t.orders.select(F.col("o_custkey").alias("id"))
simple("seq_or", lambda t: sets.combine_or(t.A, _seq(t)), "SELECT id FROM A UNION SELECT id FROM S", A, _SEQ)
simple("seq_xor_toggle", lambda t: sets.combine_xor(t.A, _seq(t)), "SELECT id FROM (SELECT id FROM A UNION ALL SELECT id FROM S) GROUP BY id HAVING count(*) % 2 = 1", A, _SEQ)
simple("seq_sub", lambda t: sets.combine_sub(t.A, _seq(t)), "SELECT id FROM A EXCEPT SELECT id FROM S", A, _SEQ)
simple("seq_and", lambda t: sets.combine_and(t.A, _seq(t)), "SELECT id FROM A INTERSECT SELECT id FROM S", A, _SEQ)

# many sets at once
simple("agg_or", lambda t: multi.agg_or(t.C), "SELECT DISTINCT id FROM C", C)
simple("agg_and", lambda t: multi.agg_and(t.C), "SELECT id FROM C GROUP BY id HAVING count(*) = (SELECT count(DISTINCT set_id) FROM C)", C)
simple("agg_and_sub", lambda t: multi.agg_and_sub([t.A, t.B], [t.T]), "SELECT id FROM A INTERSECT SELECT id FROM B EXCEPT SELECT id FROM T", A, B, T)
simple("agg_and_sub_first", lambda t: multi.first_and_sub([t.A, t.B], [t.T]), "SELECT min(id) AS first FROM (SELECT id FROM A INTERSECT SELECT id FROM B EXCEPT SELECT id FROM T)", A, B, T)
simple("agg_shift_right_and", lambda t: multi.shift_right_and(t.A, t.B, t.A), "SELECT a.id + 2 AS id FROM A a JOIN B b ON b.id = a.id + 1 JOIN A c ON c.id = a.id + 2", A, B)
simple("agg_range_hint", lambda t: multi.agg_or(multi.with_range(t.C, 300, 10)), "SELECT DISTINCT id FROM C WHERE id BETWEEN 10 AND 300", C)
_ASK = [("q1", "1-URGENT", 0), ("q1", "2-HIGH", 0), ("q2", "3-MEDIUM", 0), ("q2", "5-LOW", 1), ("q3", "1-URGENT", 0), ("q3", "1-URGENT", 1)]
_Q = f"Q(qid, set_id, grp) AS (VALUES {', '.join(map(str, _ASK))})"
_H = "H AS (SELECT qid, id FROM Q JOIN C USING (set_id) GROUP BY qid, id HAVING count(*) FILTER (grp = 0) = (SELECT count(DISTINCT set_id) FROM Q other WHERE other.qid = Q.qid AND other.grp = 0) AND count(*) FILTER (grp = 1) = 0)"
_ask = lambda t: t.spark.createDataFrame(_ASK, "qid string, set_id string, grp int")
simple("agg_pipeline", lambda t: multi.pipeline(t.C, _ask(t)), "SELECT qid, id FROM H", C, _Q, _H)
simple("agg_pipeline_counts", lambda t: multi.pipeline_counts(t.C, _ask(t)), "SELECT qid, count(id) AS cnt FROM (SELECT DISTINCT qid FROM Q) LEFT JOIN H USING (qid) GROUP BY qid", C, _Q, _H)
simple("agg_pipeline_or", lambda t: multi.pipeline_or(t.C, _ask(t)), "SELECT DISTINCT id FROM H", C, _Q, _H)
simple("agg_pipeline_limit", lambda t: multi.limit_per_query(multi.pipeline(t.C, _ask(t)), 5), "SELECT qid, id FROM H QUALIFY row_number() OVER (PARTITION BY qid ORDER BY id) <= 5", C, _Q, _H)

# counts and similarity
simple("count", lambda t: metrics.count(t.A), "SELECT count(*) AS cnt FROM A", A)
simple("count_range", lambda t: metrics.count_range(t.A, 9000, 100), "SELECT count(*) AS cnt FROM A WHERE id BETWEEN 100 AND 9000", A)
simple("count_blocks", lambda t: rank.count_blocks(t.lineitem.select((F.col("l_orderkey") * 64).alias("id")).distinct()), "SELECT (l_orderkey * 64) // 65536 AS block, count(DISTINCT l_orderkey) AS cnt FROM lineitem GROUP BY 1")
simple("any", lambda t: metrics.any_member(t.A), "SELECT count(*) > 0 AS any FROM A", A)
simple("any_range", lambda t: metrics.any_range(t.A, 1, 2), "SELECT count(*) > 0 AS any FROM A WHERE id BETWEEN 1 AND 2", A)
simple("all_one_range", lambda t: metrics.all_one_range(t.A, 1, 3), "SELECT count(*) = 3 AS \"all\" FROM A WHERE id BETWEEN 1 AND 3", A)
_FULL = "F AS (SELECT a.id AS a, b.id AS b FROM A a FULL JOIN B b ON a.id = b.id)"
_D = "D AS (SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS cnt_and, count(*) AS cnt_or, count(*) FILTER (a IS NULL OR b IS NULL) AS cnt_xor, count(*) FILTER (b IS NULL) AS sub_ab, count(*) FILTER (a IS NULL) AS sub_ba, count(a) AS cnt_a, count(b) AS cnt_b FROM F)"
simple("count_metrics", lambda t: metrics.distances(t.A, t.B), "SELECT * FROM D", A, B, _FULL, _D)
simple("any_metrics", lambda t: metrics.distances_any(t.A, t.B), "SELECT cnt_and > 0 AS any_and, cnt_or > 0 AS any_or, cnt_xor > 0 AS any_xor, sub_ab > 0 AS any_sub_ab, sub_ba > 0 AS any_sub_ba FROM D", A, B, _FULL, _D)
simple("dice", lambda t: metrics.distances(t.A, t.B).select(F.round(metrics.dice(F.col("cnt_and"), F.col("cnt_a"), F.col("cnt_b")), 9).alias("dice")), "SELECT round(2 * cnt_and / (cnt_a + cnt_b), 9) AS dice FROM D", A, B, _FULL, _D)
_PAIR = "K AS (SELECT a.set_id AS s1, b.set_id AS s2, count(*) FILTER (a.id = b.id) AS cnt_and FROM C a JOIN C b ON a.set_id < b.set_id GROUP BY 1, 2), M AS (SELECT set_id, count(*) AS n FROM C GROUP BY 1), J AS (SELECT s1, s2, cnt_and, x.n + y.n - cnt_and AS cnt_or FROM K JOIN M x ON x.set_id = s1 JOIN M y ON y.set_id = s2)"
simple("pair_counts", lambda t: metrics.pair_counts(t.C), "SELECT * FROM J", C, _PAIR)
simple("jaccard_pairs", lambda t: metrics.jaccard_batch(t.C).withColumn("similarity", F.round("similarity", 9)), "SELECT s1, s2, cnt_and, cnt_or, round(cnt_and / cnt_or, 9) AS similarity FROM J", C, _PAIR)
simple("and_matrix", lambda t: metrics.and_matrix(t.C), "SELECT s1, s2, cnt_and AS cnt FROM J UNION ALL SELECT set_id, set_id, n FROM M", C, _PAIR)
_SEG = "G AS (SELECT DISTINCT c_nationkey AS set_id, c_custkey % 97 AS id FROM customer)"
simple("cluster_leaders", lambda t: analytics.cluster_leaders(frames.collection(t.customer, "c_nationkey", F.expr("c_custkey % 97")), 0.33), None)
simple("histogram_fixed", lambda t: analytics.histogram_fixed(t.A, 700, 200000), "SELECT range AS bin, count(id) AS cnt FROM range(286) LEFT JOIN A ON id // 700 = range AND id < 200000 GROUP BY range", A)
simple("histogram_adaptive", lambda t: analytics.histogram_adaptive(t.A, 500), "SELECT coalesce(lag(stop) OVER (ORDER BY g) + 1, low) AS start, stop FROM (SELECT (rank - 1) // 500 AS g, min(id) AS low, max(id) AS stop FROM R GROUP BY 1)", A, R)
simple("value_counts", lambda t: metrics.value_counts(t.V), "SELECT value, count(*) AS cnt FROM V WHERE value IS NOT NULL GROUP BY value", V)
simple("count_notnull", lambda t: metrics.count_notnull(t.V, 100, 900), "SELECT count(value) AS cnt FROM V WHERE idx BETWEEN 100 AND 900", V)

# rank and select
simple("rank_index", lambda t: rank.rank_index(t.A.select((F.col("id") * 64).alias("id"))), "SELECT block, cnt, CAST(sum(cnt) OVER (ORDER BY block) AS BIGINT) AS upto FROM (SELECT (id * 64) // 65536 AS block, count(*) AS cnt FROM A GROUP BY 1)", A)
simple("count_to", lambda t: rank.count_to(t.A, 5000), "SELECT count(*) AS rank FROM A WHERE id <= 5000", A)
simple("rank", lambda t: rank.with_rank(t.A), "SELECT * FROM R", A, R)
_LINE = "Y AS (SELECT o_orderkey AS probe, A.id AS hit, count(A.id) OVER (ORDER BY o_orderkey) AS n FROM orders LEFT JOIN A ON A.id = o_orderkey)"
simple("rank_probes", lambda t: rank.ranks(t.A, _ids(t)), "SELECT probe, n AS rank, hit IS NOT NULL AS member, CASE WHEN hit IS NULL THEN n ELSE n - 1 END AS corrected, CASE WHEN hit IS NULL THEN 0 ELSE n END AS rank_test FROM Y", A, _LINE)
simple("select", lambda t: rank.select(t.A, 1234), "SELECT id FROM R WHERE rank = 1234", A, R)
simple("select_many", lambda t: rank.select_many(t.A, _ids(t).withColumnRenamed("id", "rank")), "SELECT rank, id FROM R WHERE rank IN (SELECT o_orderkey FROM orders)", A, R)
simple("find_rank", lambda t: rank.find_rank(t.A, 10, 7000), "SELECT id FROM A WHERE id >= 7000 ORDER BY id LIMIT 1 OFFSET 9", A)
simple("skip", lambda t: rank.skip(t.A, 4000), "SELECT id FROM R WHERE rank > 4000", A, R)
simple("rank_range_split", lambda t: rank.range_split(t.A, 100), "SELECT coalesce(lag(stop) OVER (ORDER BY g) + 1, low) AS start, stop FROM (SELECT (rank - 1) // 100 AS g, min(id) AS low, max(id) AS stop FROM R GROUP BY 1)", A, R)
simple("set_as_vector", lambda t: rank.as_vector(t.A), "SELECT rank - 1 AS idx, id AS value FROM R", A, R)
simple("rank_compress", lambda t: rank.compress(t.T, t.A), "SELECT rank - 1 AS id FROM R WHERE id IN (SELECT id FROM T)", A, T, R)
simple("rank_decompress", lambda t: rank.decompress(rank.compress(t.T, t.A), t.A), "SELECT id FROM A INTERSECT SELECT id FROM T", A, T)
simple("resolve", lambda t: rank.resolve(t.V), "SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS addr FROM V WHERE value IS NOT NULL", V)
simple("resolve_range", lambda t: rank.resolve_range(t.V, 900, 100), "SELECT min(addr) AS first, max(addr) AS last FROM (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS addr FROM V WHERE value IS NOT NULL) WHERE idx BETWEEN 100 AND 900", V)

# navigation
simple("find_first_from", lambda t: navigation.find_first(t.A, 7001), "SELECT min(id) AS first FROM A WHERE id >= 7001", A)
simple("find_reverse_from", lambda t: navigation.find_last(t.A, 7001), "SELECT max(id) AS last FROM A WHERE id <= 7001", A)
simple("find_dynamic_range", lambda t: navigation.dynamic_range(t.A), "SELECT min(id) AS first, max(id) AS last FROM A", A)
simple("get_first", lambda t: navigation.get_first(t.A), "SELECT coalesce(min(id), 0) AS first FROM A", A)
simple("get_next", lambda t: navigation.get_next(t.A), "SELECT id, coalesce(lead(id) OVER (ORDER BY id), 0) AS next FROM A", A)
simple("extract_next", lambda t: navigation.extract_next(t.A), "SELECT id FROM A WHERE id > (SELECT min(id) FROM A)", A)
simple("enumerator_go_to", lambda t: navigation.go_to(t.A, 9000), "SELECT id FROM A WHERE id >= 9000", A)
simple("sort_values", lambda t: ordering.sorted_vector(t.N), "SELECT idx, value FROM N", N)
simple("ordered_index", lambda t: ordering.ordered_index(t.part.select(F.col("p_name").alias("value")).distinct(), "value"), "SELECT row_number() OVER (ORDER BY value) - 1 AS idx, value FROM (SELECT DISTINCT p_name AS value FROM part)")
simple("random_subset", lambda t: navigation.sample(t.A, 100).join(t.A.withColumn("member", F.lit(1)), "id", "left").agg(F.countDistinct("id").alias("n"), F.count("member").alias("members")), "SELECT least(count(*), 100) AS n, least(count(*), 100) AS members FROM A", A)

# positions
simple("shift_right", lambda t: position.shift_right(t.A), "SELECT id + 1 AS id FROM A", A)
simple("shift_left", lambda t: position.shift_left(t.A), "SELECT id - 1 AS id FROM A WHERE id > 0", A)
simple("shift_carry", lambda t: position.carry_left(t.A), "SELECT count(*) > 0 AS carry FROM A WHERE id = 0", A)
simple("insert_bit", lambda t: position.insert_bit(t.A, 500), "SELECT CASE WHEN id >= 500 THEN id + 1 ELSE id END AS id FROM A UNION SELECT 500", A)
simple("erase_bit", lambda t: position.erase_bit(t.A, 500), "SELECT CASE WHEN id > 500 THEN id - 1 ELSE id END AS id FROM A WHERE id <> 500", A)
simple("insert_element", lambda t: position.insert_element(t.V, 500, 42), "SELECT CASE WHEN idx >= 500 THEN idx + 1 ELSE idx END AS idx, value FROM V UNION ALL SELECT 500, 42", V)
simple("erase_element", lambda t: position.erase_element(t.V, 500), "SELECT CASE WHEN idx > 500 THEN idx - 1 ELSE idx END AS idx, value FROM V WHERE idx <> 500", V)
simple("swap_elements", lambda t: position.swap_elements(t.V, 3, 8), "SELECT CASE WHEN idx = 3 THEN 8 WHEN idx = 8 THEN 3 ELSE idx END AS idx, value FROM V", V)
simple("insert_text", lambda t: position.insert_element(t.N, 5, "zz"), "SELECT CASE WHEN idx >= 5 THEN idx + 1 ELSE idx END AS idx, value FROM N UNION ALL SELECT 5, 'zz'", N)
_MAT = "Z AS (SELECT o_orderpriority AS row, o_orderkey AS id FROM orders)"
_mat = lambda t: t.P.withColumnRenamed("set_id", "row")
simple("matrix_insert_column", lambda t: position.insert_column(_mat(t), 100), "SELECT row, CASE WHEN id >= 100 THEN id + 1 ELSE id END AS id FROM Z", _MAT)
simple("matrix_erase_column", lambda t: position.erase_column(_mat(t), 100), "SELECT row, CASE WHEN id > 100 THEN id - 1 ELSE id END AS id FROM Z WHERE id <> 100", _MAT)
simple("matrix_swap_columns", lambda t: position.swap_columns(_mat(t), 100, 7), "SELECT row, CASE WHEN id = 100 THEN 7 WHEN id = 7 THEN 100 ELSE id END AS id FROM Z", _MAT)
simple("matrix_clear_column", lambda t: position.clear_column(_mat(t), 100), "SELECT row, id FROM Z WHERE id <> 100", _MAT)
simple("matrix_row", lambda t: position.matrix_row(_mat(t), "5-LOW"), "SELECT id FROM Z WHERE row = '5-LOW'", _MAT)

# intervals
simple("intervals", lambda t: intervals.islands(t.A), "SELECT * FROM I", A, I)
simple("interval_count", lambda t: metrics.count_intervals(t.A), "SELECT 2 * (SELECT count(*) FROM I) + 1 - (SELECT count(*) FROM A WHERE id = 0) AS intervals", A, I)
simple("interval_goto", lambda t: intervals.go_to(t.A, 7001, extend=False), "SELECT greatest(start, 7001) AS start, stop FROM I WHERE stop >= 7001 ORDER BY start LIMIT 1", A, I)
simple("is_interval", lambda t: intervals.is_interval(t.A, 1, 1), "SELECT count(*) > 0 AS is_interval FROM I WHERE start = 1 AND stop = 1", A, I)
simple("interval_start_end", lambda t: intervals.around_many(t.A, _ids(t)), "SELECT o_orderkey AS probe, start, stop FROM orders JOIN I ON o_orderkey BETWEEN start AND stop", A, I)
simple("interval_expand", lambda t: intervals.expand(intervals.islands(t.A)), "SELECT id FROM A", A)
_runs = lambda t: t.orders.select("o_custkey", F.col("o_orderkey").alias("ord"), F.expr("o_orderkey % 1000").alias("start"), F.expr("o_orderkey % 1000 + o_custkey % 90 + 10").alias("stop"))
simple("interval_layout", lambda t: intervals.lay_out(_runs(t), "o_custkey"), None)
_LAY = "Y AS (SELECT o_orderkey % 9 AS plane, o_orderkey AS start, o_orderkey + o_custkey % 40 AS stop FROM orders), E AS (SELECT * FROM Y WHERE start <= 7100 AND stop >= 7090)"
simple("interval_splice", lambda t: intervals.splice(t.orders.select(F.expr("o_orderkey % 9").alias("plane"), F.col("o_orderkey").alias("start"), F.expr("o_orderkey + o_custkey % 40").alias("stop")), 7090, 7100), "SELECT dense_rank() OVER (ORDER BY plane) - 1 AS plane, start, stop FROM E", _LAY)

# searches
for _name, _op, _sql in (("eq", search.find_eq, "= 500"), ("gt", search.find_gt, "> 500"), ("ge", search.find_ge, ">= 500"), ("lt", search.find_lt, "< 500"), ("le", search.find_le, "<= 500")):
    simple(f"scan_{_name}", lambda t, op=_op: op(t.W, 500), f"SELECT idx AS id FROM W WHERE value {_sql}", W)
simple("scan_range", lambda t: search.find_range(t.W, 300, -200), "SELECT idx AS id FROM W WHERE value BETWEEN -200 AND 300", W)
simple("scan_in", lambda t: search.find_in(t.W, [1, 5, 900]), "SELECT idx AS id FROM W WHERE value IN (1, 5, 900)", W)
simple("scan_in_frame", lambda t: search.find_in_frame(t.V, t.customer.filter("c_nationkey = 3").select(F.col("c_custkey").alias("value"))), "SELECT idx AS id FROM V WHERE value IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)", V)
simple("scan_first", lambda t: search.find_first(t.V, 500), "SELECT min(idx) AS first FROM V WHERE value = 500", V)
simple("scan_zero", lambda t: search.find_zero(t.W), "SELECT idx AS id FROM W WHERE value = 0", W)
simple("scan_zero_uncorrected", lambda t: search.find_zero(t.W, False), "SELECT idx AS id FROM W WHERE coalesce(value, 0) = 0", W)
simple("scan_nonzero", lambda t: search.find_nonzero(t.W), "SELECT idx AS id FROM W WHERE value <> 0", W)
simple("scan_nonnegative", lambda t: search.find_nonnegative(t.W), "SELECT idx AS id FROM W WHERE value IS NULL OR value >= 0", W)
simple("scan_invert", lambda t: search.invert_result(t.W, search.find_gt(t.W, 500)), "SELECT idx AS id FROM W WHERE value IS NOT NULL AND NOT value > 500", W)
simple("scan_mask", lambda t: search.find_gt(search.masked(t.W, t.A), 500), "SELECT idx AS id FROM W WHERE value > 500 AND idx IN (SELECT id FROM A)", W, A)
for _name, _op, _sql in (("gt", search.find_gt, "> 25.5"), ("ge", search.find_ge, ">= 25.5"), ("lt", search.find_lt, "< 25.5"), ("le", search.find_le, "<= 25.5")):
    simple(f"scan_float_{_name}", lambda t, op=_op: op(t.X, 25.5), f"SELECT idx AS id FROM X WHERE value {_sql}", X)
simple("scan_float_range", lambda t: search.find_range(t.X, 30.0, 10.5), "SELECT idx AS id FROM X WHERE value BETWEEN 10.5 AND 30.0", X)
simple("scan_float_open", lambda t: search.find_range_open(t.X, 10.5, 30.0), "SELECT idx AS id FROM X WHERE value > 10.5 AND value < 30.0", X)
simple("scan_str_eq", lambda t: search.find_eq(t.N, "red plate"), "SELECT idx AS id FROM N WHERE value = 'red plate'", N)
simple("scan_str_empty", lambda t: search.find_eq(t.N, ""), "SELECT idx AS id FROM N WHERE value = ''", N)
simple("scan_str_first", lambda t: search.find_first(t.N, "red plate"), "SELECT min(idx) AS first FROM N WHERE value = 'red plate'", N)
simple("scan_str_prefix", lambda t: search.find_prefix(t.N, "sm"), "SELECT idx AS id FROM N WHERE starts_with(value, 'sm')", N)
_KEYS = ["red plate", "small ring", "hot rod", "no such part"]
_keys = lambda t: t.spark.createDataFrame([(k,) for k in _KEYS], "value string")
_KEY = f"Q(value) AS (VALUES {', '.join(f'({k!r})' for k in _KEYS)})"
_even = lambda t: t.part.filter("p_size % 2 = 0").select(F.col("p_partkey").alias("id"))
_EVEN = "E AS (SELECT p_partkey AS id FROM part WHERE p_size % 2 = 0)"
simple("scan_str_bulk", lambda t: search.bulk(t.N, _keys(t)), "SELECT value, idx AS id FROM N JOIN Q USING (value)", N, _KEY)
simple("scan_str_bulk_count", lambda t: search.bulk_counts(t.N, _keys(t)), "SELECT value, count(idx) AS cnt FROM Q LEFT JOIN N USING (value) GROUP BY value", N, _KEY)
simple("scan_str_bulk_or", lambda t: search.bulk_or(t.N, _keys(t)), "SELECT idx AS id FROM N WHERE value IN (SELECT value FROM Q)", N, _KEY)
simple("scan_str_bulk_mask", lambda t: search.bulk(t.N, _keys(t), _even(t)), "SELECT value, idx AS id FROM N JOIN Q USING (value) WHERE idx IN (SELECT id FROM E)", N, _KEY, _EVEN)
simple("scan_str_bulk_limit", lambda t: search.bulk_limit(t.N, _keys(t), 3), "SELECT value, idx AS id FROM N JOIN Q USING (value) QUALIFY row_number() OVER (PARTITION BY value ORDER BY idx) <= 3", N, _KEY)
_SORTED = "U AS (SELECT row_number() OVER (ORDER BY value) - 1 AS idx, value FROM (SELECT DISTINCT p_name AS value FROM part))"
_sorted = lambda t: ordering.ordered_index(t.part.select(F.col("p_name").alias("value")).distinct(), "value")
simple("bfind", lambda t: search.binary_find(_sorted(t), "hot rod"), "SELECT bool_or(value = 'hot rod') AS found, coalesce(min(idx) FILTER (value = 'hot rod'), count(*) FILTER (value < 'hot rod')) AS pos FROM U", _SORTED)
simple("lower_bound_str", lambda t: search.lower_bound(_sorted(t), "m"), "SELECT coalesce(min(idx) FILTER (value >= 'm'), max(idx) + 1, 0) AS pos, count(*) FILTER (value = 'm') > 0 AS exact FROM U", _SORTED)
simple("compare_int", lambda t: t.W.select("idx", fn.compare_int("value", 100).alias("cmp")), "SELECT idx, CAST(sign(coalesce(value, 0) - 100) AS INTEGER) AS cmp FROM W", W)
simple("compare_float", lambda t: t.X.select("idx", fn.compare_float("value", 25.5, 0.5).alias("cmp")), "SELECT idx, CASE WHEN abs(coalesce(value, 0) - 25.5) <= 0.5 THEN 0 WHEN coalesce(value, 0) < 25.5 THEN -1 ELSE 1 END AS cmp FROM X", X)
simple("str_compare", lambda t: t.N.select("idx", fn.compare_text("value", "old gear").alias("cmp")), "SELECT idx, CASE WHEN coalesce(value, '') < 'old gear' THEN -1 WHEN coalesce(value, '') > 'old gear' THEN 1 ELSE 0 END AS cmp FROM N", N)

# element access
simple("get", lambda t: vectors.get(t.V), "SELECT idx, coalesce(value, 0) AS value FROM V", V)
simple("try_get", lambda t: vectors.try_get(t.V), "SELECT idx, value, value IS NOT NULL AS assigned FROM V", V)
simple("at", lambda t: vectors.at(t.V, 1234), "SELECT value FROM V WHERE idx = 1234", V)
simple("decode_range", lambda t: vectors.decode(t.V, 100, 250), "SELECT idx, value FROM V WHERE idx BETWEEN 100 AND 349", V)
_WANT = "G AS (SELECT event_id AS pos, user_id * 101 % 16000 AS idx FROM events)"
simple("gather", lambda t: vectors.gather(t.V, t.events.select(F.col("event_id").alias("pos"), F.expr("user_id * 101 % 16000").alias("idx"))), "SELECT pos, G.idx AS idx, value FROM G LEFT JOIN V ON G.idx = V.idx", V, _WANT)
simple("bit_slice", lambda t: vectors.slice_of(t.W, 3), f"SELECT idx AS id FROM W WHERE ({CODE.format('value')} >> 3) & 1 = 1", W)
simple("unsigned_bits", lambda t: t.W.select("idx", fn.low_bits("value", 5).alias("bits")), f"SELECT idx, {CODE.format('value')} & 31 AS bits FROM W", W)
simple("signed_code", lambda t: t.W.select("idx", fn.signed_code("value").alias("code"), fn.signed_value(fn.signed_code("value")).alias("back")), f"SELECT idx, {CODE.format('value')} AS code, value AS back FROM W", W)
simple("number_octet", lambda t: t.W.select("idx", fn.number_octet("value", 1).alias("octet")), f"SELECT idx, ({CODE.format('value')} >> 8) & 255 AS octet FROM W", W)
simple("text_octet", lambda t: t.N.select("idx", fn.octet("value", 2).alias("octet")), "SELECT idx, CASE WHEN length(coalesce(value, '')) > 2 THEN ascii(substr(value, 3, 1)) ELSE 0 END AS octet FROM N", N)
simple("compare_octet", lambda t: t.N.select("idx", fn.compare_octet("value", 0, 109).alias("cmp")), "SELECT idx, CASE WHEN coalesce(value, '') = '' THEN -1 ELSE CAST(sign(ascii(substr(value, 1, 1)) - 109) AS INTEGER) END AS cmp FROM N", N)
simple("float_parts", lambda t: t.X.filter("value IS NOT NULL").select("idx", "value", fn.float_parts("value").alias("p")).select("idx", (fn.float_of("p") == F.col("value")).alias("same")), "SELECT idx, TRUE AS same FROM X WHERE value IS NOT NULL", X)
simple("substr_decode", lambda t: vectors.substring(t.N, 2, 5), "SELECT idx, substr(value, 3, 4) AS value FROM N", N)
simple("rsc_load_from", lambda t: vectors.drop_nulls(t.V), "SELECT * FROM V WHERE value IS NOT NULL", V)
simple("rsc_load_to", lambda t: vectors.fill_nulls(vectors.drop_nulls(t.V), 200000), "SELECT range AS idx, value FROM range(200000) LEFT JOIN V ON range = idx", V)
simple("super_block_sizes", lambda t: vectors.super_block_arrays(t.A).select("block", F.size("ids").cast("long").alias("cnt"), F.element_at("ids", -1).alias("last")), "SELECT id // 16777216 AS block, count(*) AS cnt, max(id) AS last FROM A GROUP BY 1", A)

# rewriting
simple("vec_assign", lambda t: vectors.assign(t.V, t.spark.createDataFrame([(5, 7), (20000, 8)], "idx long, value long")), "SELECT idx, value FROM V WHERE idx <> 5 UNION ALL VALUES (5, 7), (20000, 8)", V)
simple("vec_push_back", lambda t: frames.push_back_null(frames.push_back(t.V, 5, 6), 2), "SELECT idx, value FROM V UNION ALL VALUES (15000, 5), (15001, 6), (15002, NULL), (15003, NULL)", V)
ORACLE["vec_push_back"] = f"WITH {V}, E AS (SELECT max(idx) + 1 AS n FROM V) SELECT idx, value FROM V UNION ALL SELECT n, 5 FROM E UNION ALL SELECT n + 1, 6 FROM E UNION ALL SELECT n + 2, NULL FROM E UNION ALL SELECT n + 3, NULL FROM E"
simple("vec_set_null", lambda t: vectors.set_null(t.V, 10), "SELECT idx, CASE WHEN idx <> 10 THEN value END AS value FROM V", V)
simple("vec_set_null_mask", lambda t: vectors.set_null_mask(t.V, t.A), "SELECT idx, CASE WHEN idx NOT IN (SELECT id FROM A) THEN value END AS value FROM V", V, A)
simple("vec_clear_mask", lambda t: vectors.clear_mask(t.V, t.A), "SELECT idx, CASE WHEN value IS NOT NULL AND idx IN (SELECT id FROM A) THEN 0 ELSE value END AS value FROM V", V, A)
simple("vec_clear_element", lambda t: vectors.clear_element(t.V, 10), "SELECT idx, CASE WHEN idx = 10 AND value IS NOT NULL THEN 0 ELSE value END AS value FROM V", V)
simple("vec_clear_range", lambda t: vectors.clear_range(t.V, 900, 100), "SELECT idx, CASE WHEN idx BETWEEN 100 AND 900 AND value IS NOT NULL THEN 0 ELSE value END AS value FROM V", V)
simple("vec_keep_range", lambda t: vectors.keep_range(t.V, 100, 900), "SELECT idx, CASE WHEN idx BETWEEN 100 AND 900 THEN value END AS value FROM V", V)
simple("vec_cut_range", lambda t: vectors.cut_range(vectors.drop_nulls(t.V), 100, 900), "SELECT idx, value FROM V WHERE idx BETWEEN 100 AND 900 AND value IS NOT NULL", V)
simple("vec_filter", lambda t: vectors.filter_mask(t.V, t.A), "SELECT idx, CASE WHEN idx IN (SELECT id FROM A) THEN value END AS value FROM V", V, A)
simple("vec_erase_mask", lambda t: vectors.erase_mask(vectors.drop_nulls(t.V), t.A), "SELECT idx, value FROM V WHERE value IS NOT NULL AND idx NOT IN (SELECT id FROM A)", V, A)
simple("vec_inc", lambda t: vectors.increment(t.V, t.events.select(F.col("user_id").alias("idx"), F.lit(1).alias("delta"))), "SELECT coalesce(V.idx, d.idx) AS idx, CASE WHEN n IS NULL THEN value ELSE coalesce(value, 0) + n END AS value FROM V FULL JOIN (SELECT user_id AS idx, count(*) AS n FROM events GROUP BY 1) d ON V.idx = d.idx", V)
_OR = f"J AS (SELECT V.idx AS idx, V.value AS a, W.value AS b, coalesce({CODE.format('V.value')}, 0) | coalesce({CODE.format('W.value')}, 0) AS c FROM V JOIN W ON V.idx = W.idx)"
simple("vec_inc_not_null", lambda t: vectors.increment_not_null(t.V, 5), "SELECT idx, value + 5 AS value FROM V", V)
simple("vec_join_or", lambda t: vectors.join_or(t.V, t.W), f"SELECT idx, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN {DECODE.format('c')} END AS value FROM J", V, W, _OR)
simple("vec_merge_not_null", lambda t: vectors.merge_not_null(t.V, t.W), f"SELECT idx, {DECODE.format('c')} AS value FROM J WHERE a IS NOT NULL AND b IS NOT NULL", V, W, _OR)
simple("vec_merge_disjoint", lambda t: vectors.merge_disjoint(t.N.filter("idx < 1000"), t.N.filter("idx >= 900")), "SELECT idx, value FROM N", N)
_SHORT = "W2 AS (SELECT idx - 1 AS idx, value FROM W WHERE idx > 0)"
_short = lambda t: position.erase_element(t.W, 0)
simple("vec_mismatch_use_null", lambda t: vectors.mismatch(t.V, _short(t)), "SELECT V.idx AS id FROM V LEFT JOIN W2 ON V.idx = W2.idx WHERE W2.idx IS NULL OR V.value IS DISTINCT FROM W2.value", V, W, _SHORT)
simple("vec_mismatch_no_null", lambda t: vectors.mismatch(t.V, _short(t), use_null=False), "SELECT V.idx AS id FROM V LEFT JOIN W2 ON V.idx = W2.idx WHERE (V.value IS NOT NULL OR W2.value IS NOT NULL) AND (W2.idx IS NULL OR V.value IS DISTINCT FROM W2.value)", V, W, _SHORT)
simple("vec_first_mismatch", lambda t: vectors.first_mismatch(t.V, t.W), "SELECT min(V.idx) AS first_mismatch FROM V JOIN W ON V.idx = W.idx WHERE V.value IS DISTINCT FROM W.value", V, W)
simple("vec_equal", lambda t: vectors.equal(t.V, t.V), "SELECT TRUE AS equal")
simple("vec_unequal", lambda t: vectors.equal(t.V, t.W), "SELECT count(*) = 0 AS equal FROM V JOIN W ON V.idx = W.idx WHERE V.value IS DISTINCT FROM W.value", V, W)
simple("clip_high", lambda t: t.V.select("idx", fn.clip_high("value", 6).alias("value")), "SELECT idx, CASE WHEN value >> 7 <> 0 THEN 127 ELSE value END AS value FROM V", V)
simple("clip_low", lambda t: t.V.select("idx", fn.clip_low("value", 4).alias("value")), "SELECT idx, CASE WHEN (value >> 5 <> 0) <> (value & 15 <> 0) THEN ((value >> 4) << 4) | 16 ELSE (value >> 4) << 4 END AS value FROM V", V)
simple("set_octet", lambda t: t.N.select("idx", fn.set_octet("value", 1, "X").alias("value")), "SELECT idx, CASE WHEN length(value) > 1 THEN substr(value, 1, 1) || 'X' || substr(value, 3) ELSE value END AS value FROM N", N)
simple("insert_octet", lambda t: t.N.select("idx", fn.insert_octet("value", 1, "X").alias("value")), "SELECT idx, CASE WHEN length(value) >= 1 THEN substr(value, 1, 1) || 'X' || substr(value, 2) ELSE value END AS value FROM N", N)

# three-valued logic
_K3 = "K AS (SELECT o_orderkey AS idx, CASE o_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS a, CASE o_orderkey // 3 % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS b FROM orders)"
_k3 = lambda t: t.orders.select(F.col("o_orderkey").alias("idx"), F.expr("CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END").alias("a"), F.expr("CASE (o_orderkey div 3) % 3 WHEN 0 THEN true WHEN 1 THEN false END").alias("b"))
_CASE = "CASE WHEN {0} THEN 1 WHEN NOT {0} THEN -1 ELSE 0 END"
simple("kleene_and", lambda t: _k3(t).select("idx", fn.kleene(fn.kleene_and("a", "b")).alias("v")), f"SELECT idx, {_CASE.format('(a AND b)')} AS v FROM K", _K3)
simple("kleene_or", lambda t: _k3(t).select("idx", fn.kleene(fn.kleene_or("a", "b")).alias("v")), f"SELECT idx, {_CASE.format('(a OR b)')} AS v FROM K", _K3)
simple("kleene_not", lambda t: _k3(t).select("idx", fn.kleene(fn.kleene_not("a")).alias("v")), f"SELECT idx, {_CASE.format('(NOT a)')} AS v FROM K", _K3)
simple("kleene_get", lambda t: _k3(t).select("idx", fn.kleene("a").alias("v"), fn.kleene(fn.from_kleene(fn.kleene("a"))).alias("back")), f"SELECT idx, {_CASE.format('a')} AS v, {_CASE.format('a')} AS back FROM K", _K3)
simple("kleene_init", lambda t: _k3(t).select("idx", fn.kleene(fn.init_kleene(F.coalesce("a", F.lit(False)), F.col("b").isNotNull())).alias("v")), "SELECT idx, CASE WHEN b IS NULL THEN 0 WHEN a THEN 1 ELSE -1 END AS v FROM K", _K3)
simple("kleene_set", lambda t: _k3(t).select("idx", fn.kleene(fn.set_kleene("a", F.col("idx") < 100, 1)).alias("v")), f"SELECT idx, CASE WHEN idx < 100 THEN 1 ELSE {_CASE.format('a')} END AS v FROM K", _K3)
simple("kleene_codes", lambda t: _k3(t).select("idx", fn.code_and(fn.kleene("a"), fn.kleene("b")).alias("c_and"), fn.code_or(fn.kleene("a"), fn.kleene("b")).alias("c_or")), f"SELECT idx, {_CASE.format('(a AND b)')} AS c_and, {_CASE.format('(a OR b)')} AS c_or FROM K", _K3)

# relations
simple("image_remap", lambda t: relations.image(t.A, t.V), "SELECT DISTINCT value AS id FROM V WHERE value IS NOT NULL AND idx IN (SELECT id FROM A)", A, V)
simple("image_one_pass", lambda t: relations.image(t.A, t.V, nullable=False), "SELECT DISTINCT coalesce(value, 0) AS id FROM V WHERE idx IN (SELECT id FROM A)", A, V)
simple("image_single", lambda t: relations.image_of(t.V, 1234), "SELECT value IS NOT NULL AS mapped, value FROM V WHERE idx = 1234", V)
simple("link_targets", lambda t: relations.targets(t.L, 77), "SELECT DISTINCT dst AS id FROM L WHERE src = 77", L)
_REL = "G AS (SELECT o_custkey AS src, o_orderkey % 1500 AS dst FROM orders)"
simple("khop_or", lambda t: relations.hops(frames.set_of(t.spark, [3]), frames.edges(t.orders.select("o_custkey", F.expr("o_orderkey % 1500").alias("d")), "o_custkey", "d"), 2), "SELECT 3::BIGINT AS id UNION SELECT dst FROM G WHERE src = 3 UNION SELECT b.dst FROM G a JOIN G b ON b.src = a.dst WHERE a.src = 3", _REL)
simple("link_add", lambda t: relations.add_links(t.L, 5, t.T), "SELECT src, dst FROM L UNION ALL SELECT 5, id FROM T", L, T)
simple("posting_counts", lambda t: relations.posting_counts(t.lineitem, "l_suppkey", "l_orderkey"), "SELECT l_suppkey AS key, count(DISTINCT l_orderkey) AS cnt FROM lineitem GROUP BY 1")
simple("collection_at", lambda t: relations.lookup(t.part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("val")), t.lineitem.select(F.col("l_partkey").alias("key")).distinct()), "SELECT p_partkey AS key, p_name AS val FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
simple("fx_style_inverse", lambda t: relations.inverse_matches(t.V, frames.vector(t.orders, "o_orderkey", F.expr("300 - o_custkey")), 400), "SELECT idx AS id FROM V JOIN orders ON o_orderkey = idx WHERE value >= 400 AND 300 - o_custkey <= -400", V)
simple("fx_arbitrage", lambda t: analytics.arbitrage(frames.vector(t.part, "p_partkey", "p_retailprice"), frames.vector(t.part, "p_partkey", F.expr("1.0D / (p_size + 1)")), frames.vector(t.part, "p_partkey", F.expr("p_retailprice / (p_size + 2)")), 0.21).select("idx", F.round("ratio", 6).alias("ratio")), "SELECT p_partkey AS idx, round((p_size + 2.0) / (p_size + 1), 6) AS ratio FROM part WHERE (p_size + 2.0) / (p_size + 1) - 1 > 0.21")
simple("asof_before", lambda t: relations.nearest_before(_ids(t), t.A), "SELECT probe, max(hit) OVER (ORDER BY probe) AS found FROM Y", A, _LINE)

simple("matrix_equal", lambda t: relations.equal_frames(t.P, t.P.union(t.P.limit(0))), "SELECT TRUE AS equal")
simple("collection_unequal", lambda t: relations.equal_frames(t.P, t.P.filter("id > 5")), "SELECT FALSE AS equal")


def _doubled(frames_):
    for frame in frames_:
        yield frame.assign(id=frame["id"] * 2)


simple("visit_members", lambda t: navigation.visit(t.A, _doubled, "id long"), "SELECT id * 2 AS id FROM A", A)
simple("visit_range", lambda t: navigation.visit(t.A, _doubled, "id long", 900, 100), "SELECT id * 2 AS id FROM A WHERE id BETWEEN 100 AND 900", A)


def _negated(frames_):
    for frame in frames_:
        yield frame.assign(value=-frame["value"].astype("Int64"))


simple("visit_vector", lambda t: vectors.visit(t.V, _negated, "idx long, value long"), "SELECT idx, -value AS value FROM V", V)
simple("visit_masked", lambda t: vectors.visit(t.V, _negated, "idx long, value long", t.A), "SELECT idx, -value AS value FROM V WHERE idx IN (SELECT id FROM A)", V, A)

# packed sets
simple("packed_count", lambda t: packed.packed_count(packed.pack(t.A)), "SELECT count(*) AS cnt FROM A", A)
for _name, _op, _sql in (("and", packed.packed_and, "INTERSECT"), ("or", packed.packed_or, "UNION"), ("sub", packed.packed_sub, "EXCEPT")):
    simple(f"packed_{_name}", lambda t, op=_op: packed.unpack(op(packed.pack(t.A), packed.pack(t.B))), f"SELECT id FROM A {_sql} SELECT id FROM B", A, B)
simple("packed_xor", lambda t: packed.unpack(packed.packed_xor(packed.pack(t.A), packed.pack(t.B))), "(SELECT id FROM A EXCEPT SELECT id FROM B) UNION (SELECT id FROM B EXCEPT SELECT id FROM A)", A, B)
simple("packed_count_and", lambda t: packed.packed_op(packed.pack(t.A), packed.pack(t.B), "COUNT_AND"), "SELECT count(*) AS cnt FROM A WHERE id IN (SELECT id FROM B)", A, B)
simple("export_words", lambda t: packed.words(t.A), "SELECT id // 32 AS word, bit_or(CAST(1 AS BIGINT) << CAST(id % 32 AS INTEGER)) AS bits FROM A GROUP BY 1", A)
simple("import_words", lambda t: packed.from_words(packed.words(t.A)), "SELECT id FROM A", A)
simple("block_digest", lambda t: packed.block_digest(t.A.select((F.col("id") * 64).alias("id"))), "SELECT DISTINCT (id * 64) // 65536 AS block FROM A", A)

# texts
simple("octet_stat", lambda t: metrics.octet_statistics(t.N), "SELECT i AS pos, substr(value, CAST(i AS INTEGER) + 1, 1) AS ch, count(*) AS cnt FROM N, range(64) r(i) WHERE i < length(value) GROUP BY 1, 2", N)
_STAT = "S AS (SELECT i AS pos, substr(value, CAST(i AS INTEGER) + 1, 1) AS ch, count(*) AS cnt FROM N, range(64) r(i) WHERE i < length(value) GROUP BY 1, 2)"
simple("octet_codes", lambda t: analytics.octet_codes(metrics.octet_statistics(t.N)), "SELECT pos, ch, row_number() OVER (PARTITION BY pos ORDER BY cnt DESC, ch) AS code FROM S", N, _STAT)
simple("max_text_length", lambda t: t.N.agg(F.max(F.length("value")).cast("long").alias("n")), "SELECT max(length(value)) AS n FROM N", N)
simple("lcp_pairs", lambda t: relations.aligned(t.N, frames.vector(t.N, F.expr("idx - 1"), "value")).select("idx", fn.common_prefix("a", "b").cast("long").alias("lcp")), "SELECT x.idx AS idx, coalesce((SELECT min(i) FROM range(64) r(i) WHERE substr(coalesce(x.value, ''), CAST(i AS INTEGER) + 1, 1) <> substr(coalesce(y.value, ''), CAST(i AS INTEGER) + 1, 1)), length(coalesce(x.value, ''))) AS lcp FROM N x JOIN N y ON y.idx = x.idx + 1", N)
_GRAM = "G AS (SELECT substr(p_name, CAST(i AS INTEGER) + 1, 3) AS kmer FROM part, range(64) r(i) WHERE i + 3 <= length(p_name)), H AS (SELECT kmer, count(*) AS cnt FROM G GROUP BY 1)"
_part = {"text": "p_name", "key": "p_partkey"}
simple("kmer_counts", lambda t: analytics.kmer_counts(t.part, 3, **_part), "SELECT kmer, cnt FROM H", _GRAM)
simple("kmer_histogram", lambda t: analytics.kmer_histogram(t.part, 3, **_part), "SELECT cnt, count(*) AS kinds FROM H GROUP BY 1", _GRAM)
simple("kmer_presence", lambda t: analytics.kmer_presence(t.part.withColumn("s", F.translate("p_name", "adegilnorst", "acgtacgtacg")), 3, text="s", key="p_partkey"), "SELECT DISTINCT CAST(instr('acgt', substr(k, 1, 1)) - 1 + 4 * (instr('acgt', substr(k, 2, 1)) - 1) + 16 * (instr('acgt', substr(k, 3, 1)) - 1) AS BIGINT) AS id FROM (SELECT substr(s, CAST(i AS INTEGER) + 1, 3) AS k FROM (SELECT translate(p_name, 'adegilnorst', 'acgtacgtacg') AS s FROM part), range(64) r(i) WHERE i + 3 <= length(s)) WHERE regexp_full_match(k, '[acgt]{3}')")
simple("kmer_frequent", lambda t: ordering.cumulative_pick(analytics.kmer_counts(t.part, 3, **_part).withColumnRenamed("kmer", "value"), 20.0), "SELECT value, cnt, rn FROM (SELECT *, min(CASE WHEN cnt >= target - (rn - 1) THEN rn END) OVER () AS stop FROM (SELECT kmer AS value, cnt, row_number() OVER (ORDER BY cnt DESC, kmer) AS rn, CAST(floor(count(*) OVER () * 20.0 / 100) AS BIGINT) AS target FROM H WHERE cnt > 1) WHERE rn <= target) WHERE rn <= coalesce(stop, target)", _GRAM)
simple("kmer_top", lambda t: analytics.top_words(t.part, 3, 20, **_part), "SELECT kmer, cnt FROM H ORDER BY cnt DESC, kmer LIMIT 20", _GRAM)
simple("shift_and_words", lambda t: analytics.word_starts(t.part, "ed", "p_name", "p_partkey"), "SELECT p_partkey, i AS start FROM part, range(64) r(i) WHERE substr(p_name, CAST(i AS INTEGER) + 1, 2) = 'ed'")
simple("range_index_search", lambda t: analytics.range_search(t.orders.select(F.col("o_orderpriority").alias("id_from"), F.col("o_orderkey").alias("start"), F.expr("o_custkey % 40").alias("len"), F.col("o_custkey").alias("id_to")), "5-LOW"), "SELECT o_orderkey AS start, o_orderkey + o_custkey % 40 AS stop, o_custkey AS id_to FROM orders WHERE o_orderpriority = '5-LOW'")
simple("scroll_window", lambda t: analytics.scroll(t.V, 1000, 9999, 500), "SELECT (idx - 1000) // 500 AS page, count(value) AS cnt, CAST(sum(value) AS BIGINT) AS total FROM V WHERE idx BETWEEN 1000 AND 9999 GROUP BY 1", V)

# the same over whole documents
_CHAR = "CH AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM documents WHERE text <> '')"
_LEAD = "lead(c, {0}) OVER w"
_FIVE = "G5 AS (SELECT c || " + " || ".join(_LEAD.format(k) for k in range(1, 5)) + " AS kmer FROM CH WINDOW w AS (PARTITION BY doc_id ORDER BY i)), H5 AS (SELECT kmer, count(*) AS cnt FROM G5 WHERE kmer IS NOT NULL GROUP BY 1)"
simple("doc_kmer_counts", lambda t: analytics.kmer_counts(t.documents, 5), "SELECT kmer, cnt FROM H5", _CHAR, _FIVE)
simple("doc_kmer_histogram", lambda t: analytics.kmer_histogram(t.documents, 5), "SELECT cnt, count(*) AS kinds FROM H5 GROUP BY 1", _CHAR, _FIVE)
simple("doc_word_starts", lambda t: analytics.word_starts(t.documents, "the"), "SELECT doc_id, i AS start FROM (SELECT doc_id, i, c || lead(c, 1) OVER w || lead(c, 2) OVER w AS word FROM CH WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE word = 'the'", _CHAR)
simple("doc_octet_stat", lambda t: metrics.octet_statistics(frames.vector(t.documents, "doc_id", "text")), "SELECT i AS pos, c AS ch, count(*) AS cnt FROM CH GROUP BY 1, 2", _CHAR)
simple("doc_max_text_length", lambda t: t.documents.agg(F.max(F.length("text")).cast("long").alias("n")), "SELECT max(length(text)) AS n FROM documents")
simple("ordered_index_numbers", lambda t: ordering.ordered_index(t.part.select(F.col("p_retailprice").alias("value")).distinct(), "value"), "SELECT row_number() OVER (ORDER BY value) - 1 AS idx, value FROM (SELECT DISTINCT p_retailprice AS value FROM part)")


# stored frames: written to the shared folder, read again
def stored(t: Tables, write, frame: DataFrame, **options) -> str:
    path = f"{ensure_folder(t.spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    write(frame, path, **options)
    return path


def text_of(t: Tables, lines: DataFrame) -> str:
    """lines: one column of text."""
    return stored(t, lambda df, path: df.write.text(path), lines)


simple("stored_set", lambda t: readers.read_set(t.spark, stored(t, writers.write_set, t.A)), "SELECT id FROM A", A)
simple("stored_set_level", lambda t: readers.read_set(t.spark, stored(t, writers.write_set, t.A, codec="zstd", level=9)), "SELECT id FROM A", A)
simple("stored_set_plain", lambda t: readers.read_set(t.spark, stored(t, writers.write_set, t.A, codec="none")), "SELECT id FROM A", A)
simple("stored_set_range", lambda t: readers.read_range(t.spark, stored(t, writers.write_set, t.A), 900, 100, "id"), "SELECT id FROM A WHERE id BETWEEN 100 AND 900", A)
simple("stored_set_and", lambda t: sets.bit_and(readers.read_range(t.spark, stored(t, writers.write_set, t.A), 100, 9000, "id"), t.B), "SELECT id FROM A WHERE id BETWEEN 100 AND 9000 AND id IN (SELECT id FROM B)", A, B)
simple("stored_vector", lambda t: readers.read_vector(t.spark, stored(t, writers.write_vector, t.V)), "SELECT idx, value FROM V", V)
simple("stored_vector_float", lambda t: readers.read_vector(t.spark, stored(t, writers.write_vector, frames.vector(t.part, "p_partkey", "p_retailprice"))), "SELECT p_partkey AS idx, p_retailprice AS value FROM part")
simple("stored_vector_text", lambda t: readers.read_vector(t.spark, stored(t, writers.write_vector, t.N)), "SELECT idx, value FROM N", N)
simple("stored_range", lambda t: readers.read_range(t.spark, stored(t, writers.write_vector, t.V), 100, 900), "SELECT idx, value FROM V WHERE idx BETWEEN 100 AND 900", V)
simple("stored_masked", lambda t: readers.read_masked(t.spark, stored(t, writers.write_vector, t.V), t.A), "SELECT idx, value FROM V WHERE idx IN (SELECT id FROM A)", V, A)
simple("stored_structure", lambda t: t.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in readers.read_structure(t.spark, stored(t, writers.write_vector, t.N))], "name string, kind string"), "SELECT * FROM (VALUES ('idx', 'bigint'), ('value', 'string')) x(name, kind)")
simple("stored_links", lambda t: readers.read_stored_links(t.spark, stored(t, writers.write_links, t.L)), "SELECT DISTINCT src, dst FROM L", L)
simple("stored_collection", lambda t: readers.read_collection(t.spark, stored(t, writers.write_collection, t.part.select(F.col("p_partkey").alias("key"), F.encode("p_name", "UTF-8").alias("val")))).select("key", F.hex("val").alias("val")), "SELECT p_partkey AS key, hex(encode(p_name)) AS val FROM part")
simple("stored_packed", lambda t: packed.unpack(t.spark.read.parquet(stored(t, writers.write_packed, packed.pack(t.A)))), "SELECT id FROM A", A)
simple("stored_size", lambda t: t.spark.createDataFrame([(writers.stored_size(stored(t, writers.write_set, t.A), t.A) > 0,)], "some boolean"), "SELECT TRUE AS some")
simple("text_links", lambda t: readers.read_links(t.spark, text_of(t, t.L.select(F.concat_ws("\t", "src", "dst")))), "SELECT DISTINCT src, dst FROM L", L)
simple("text_range_index", lambda t: readers.read_range_index(t.spark, text_of(t, t.orders.select(F.concat_ws(" ", F.lit("k"), "o_orderkey", F.expr("o_orderkey + o_custkey % 40 - 3"), "o_custkey")))), "SELECT 'k' AS id_from, o_orderkey AS start, o_custkey % 40 - 3 AS len, CAST(o_custkey AS VARCHAR) AS id_to FROM orders WHERE o_custkey % 40 >= 3")
simple("text_positions_report", lambda t: readers.read_positions_report(t.spark, text_of(t, t.part.select(F.concat_ws("\t", F.concat(F.lit("rs"), "p_partkey"), F.lit("1"), F.expr("p_partkey * 3"))))), "SELECT p_partkey * 3 AS idx, p_partkey AS value FROM part")
simple("text_dictionary", lambda t: readers.read_dictionary(t.spark, text_of(t, t.part.select(F.concat_ws("|", "p_partkey", "p_brand", F.lit("x"))))), "SELECT row_number() OVER (ORDER BY value) - 1 AS idx, value FROM (SELECT DISTINCT p_brand AS value FROM part)")
