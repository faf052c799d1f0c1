from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from attestry.llm import permutation_ann, pivot_topk, queries

SF = "/root/testdata/sf0.01"


def table(spark, vectors, first=0):
    return spark.createDataFrame([(i + first, v, "x", 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, score string, rank int")


def slow_topk(rows, k, every):
    q = {i: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for i, v in rows}
    out = set()
    for i in q:
        if i % every == 0:
            best = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    return out


def test_topk_is_exact(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {tuple(r) for r in queries.op5_pivot_topk(spark, SF).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == slow_topk(rows, 5, 50)


def test_topk_in_blocks_with_ties(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(90, 8)).astype(np.float32)
    vectors = [*base.tolist(), *[base[3].tolist()] * 60, (base[4] * 50).tolist()]
    got = pivot_topk.pivot_topk(table(spark, vectors), F.col("vec_id") % 10 == 0, 5, pivots=4, query_rows=5, candidate_rows=20)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == slow_topk(list(enumerate(vectors)), 5, 10)


def test_topk_beyond_doubles(spark):
    vectors = [[3.0e5, 2.0e5], [3.1e5, 1.0], [2.9e5, -4.0e5], [1.0, 1.0]]
    got = pivot_topk.pivot_topk(table(spark, vectors), F.col("vec_id") == 0, 3)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == {t for t in slow_topk(list(enumerate(vectors)), 3, 1) if t[0] == 0}


def test_scores_beyond_a_long_count_as_its_ends(spark):
    vectors = [[1e10, 1.0], [2e10, 1.0], [-3e10, 1.0], [3e38, 0.0], [1.0, 1.0]]
    got = pivot_topk.pivot_topk(table(spark, vectors), F.col("vec_id") == 0, 5)
    exact = {i: max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(*[np.floor(256 * np.array(v, np.float32).astype(float)).tolist() for v in (vectors[0], vectors[i])])))) for i in range(1, 5)}
    assert [(r["vec_id"], r["score"]) for r in got.orderBy("rank").collect()] == sorted(exact.items(), key=lambda x: (-x[1], x[0]))


def test_pivots_rule_out_candidates_of_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16))
    vectors = [(c + rng.normal(scale=0.02, size=16)).astype(np.float32).tolist() for c in centers for _ in range(60)]
    got = pivot_topk.pivot_topk(table(spark, vectors), F.col("vec_id") % 40 == 0, 5, query_rows=10, candidate_rows=200)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == slow_topk(list(enumerate(vectors)), 5, 40)


def odd(spark):
    nan, inf = float("nan"), float("inf")
    return table(spark, [[1.0, 0.0], None, [nan, 1.0], [1.0, None], [inf, 0.0], [0.0, 0.0], [0.5, 0.5], [1.0, 0.0], [0.3]])


def test_odd_vectors(spark):
    got = pivot_topk.pivot_topk(odd(spark), F.lit(True), 5).collect()
    assert {r["vec_id"] for r in got} == {0, 5, 6, 7, 8}
    near = permutation_ann.permutation_neighbours(odd(spark), F.lit(True), 5).collect()
    assert {r["vec_id"] for r in near} == {0, 6, 7, 8}
    assert [r["vec_id"] for r in near if r["query_id"] == 6] == [0, 7, 8]
    for op in (pivot_topk.pivot_topk, permutation_ann.permutation_neighbours):
        assert op(odd(spark).limit(0), F.lit(True), 5).count() == 0


def test_recall_against_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([list(r["embedding"]) for r in rows])
    got = {}
    for r in queries.op9_permutation_ann(spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for i in ids[ids % 20 == 0]:
        s = x @ x[ids == i][0]
        s[ids == i] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        mine = sorted(got[i])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(a[2] >= b[2] for a, b in zip(mine, mine[1:]))
        assert all(abs(score - s[ids == v][0]) < 1e-12 for _, v, score in mine)
        hits, total = hits + len(want & {v for _, v, _ in mine}), total + 20
    assert hits / total >= 0.9


def test_copies_rank_by_id(spark):
    got = permutation_ann.permutation_neighbours(table(spark, [[0.6, 0.8]] * 50), F.col("vec_id") == 9, 5).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [0, 1, 2, 3, 4]
