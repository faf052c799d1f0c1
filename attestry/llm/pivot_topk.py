"""Exact top-k by inner product with a pivot table: lower bounds on distance order the candidates and end the search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import saved, ship
from . import vectors as V

STEP = 256
EXACT = float(2**53)
LONG = 2**63 - 1


def pivot_topk(vectors: DataFrame, query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, pivots: int = 64, query_rows: int = 2048, candidate_rows: int = 8192) -> DataFrame:
    """Rows (``query_id``, ``rank`` from 1, ``vec_id``, ``score``): for each row where ``query`` holds, its ``k`` best others.

    The score is the integer inner product of floor(``scale`` * x), ties to the smaller id. One more coordinate lifts
    all candidates to the same norm R, so the inner product falls as the distance d grows: 2 s = |q|^2 + R^2 - d^2.
    The pivot table holds each candidate's distances to all pivots; the largest gap between a query's and a
    candidate's distances to one pivot bounds d from below. Pivots are rows spread far apart, so a query's scores with
    them already give a k-th score that the result cannot fall below: each block first drops the candidates whose bound
    cannot reach it, then evaluates the others by rising bound until none left can reach the k-th score so far. So
    results are exact whatever the pivots.

    Vectors that are null or hold null or non-finite components take no part. Shorter vectors count as padded with
    zeros. Repeated rows (equal id and vector) are separate candidates, but a row never meets its own id. Null ids are
    ids like others. Products beyond 2^53 are summed in whole numbers; scores beyond the ends of a long count as these
    ends. Other columns are not read, so their names cannot clash. An empty table gives an empty result.
    """
    rows = saved(V.packed_rows(vectors, id_col, vector_col, query, scale), "vectors")
    ship(rows.sparkSession)
    dims = (rows.agg(F.max(F.octet_length("v"))).first()[0] or 0) // 8
    points = V.spread_pivots(V.matrix(V.sample_rows(rows, 16 * pivots), dims), pivots)

    @F.arrow_udf("double")
    def norm2(column: pa.Array) -> pa.Array:
        return pa.array(np.square(V.matrix(column.to_pylist(), dims)).sum(axis=1))

    radius2 = rows.select(norm2("v").alias("n")).agg(F.max("n")).first()[0] or 0.0
    lift = lambda x2: np.sqrt(np.maximum(radius2 - x2, 0.0))
    points2 = np.square(points).sum(axis=1)

    def to_pivots(x: np.ndarray, lifted: np.ndarray | float) -> np.ndarray:
        with np.errstate(all="ignore"):
            flat = np.square(x).sum(axis=1)[:, None] + points2 - 2.0 * (x @ points.T)
            return np.sqrt(np.maximum(flat + np.square(np.reshape(lifted, (-1, 1)) - lift(points2)), 0.0))

    @F.arrow_udf("binary")
    def table(column: pa.Array) -> pa.Array:
        x = V.matrix(column.to_pylist(), dims)
        return pa.array([d.tobytes() for d in to_pivots(x, lift(np.square(x).sum(axis=1)))], pa.binary())

    index = saved(rows.withColumn("to_pivots", table("v")), "pivot-table")
    schema = f"query_id {dict(rows.dtypes)['vec_id']}, vec_id {dict(rows.dtypes)['vec_id']}, score long"

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if asked.num_rows and held.num_rows:
            held = held.sort_by("vec_id")
            ids, x = held["vec_id"].to_pylist(), V.matrix(held["v"], dims)
            far, q = V.matrix(held["to_pivots"], len(points)), V.matrix(asked["v"], dims)
            near, q2 = to_pivots(q, 0.0), np.square(q).sum(axis=1)
            spots: dict = {}
            for at, i in enumerate(ids):
                spots.setdefault(i, []).append(at)
            for i, own in enumerate(asked["vec_id"].to_pylist()):
                small = q2[i] * radius2 < EXACT**2
                product = (lambda m: m @ q[i]) if small else (lambda m: np.array([max(-LONG - 1, min(LONG, sum(int(a) * int(b) for a, b in zip(r, q[i])))) for r in m], object))
                with np.errstate(all="ignore"):
                    apart = np.abs(far - near[i]).max(axis=1)
                    most = (q2[i] + radius2 - np.square(apart)) / 2 + 1e-6 * (1.0 + q2[i] + radius2)
                most[np.isnan(most)] = np.inf
                most[spots.get(own, [])] = -np.inf
                others = points[(points != q[i]).any(axis=1)]  # of an equal vector the row may be the query's own
                known = sorted(product(others).tolist())[-k:] if len(others) else []
                least = known[0] if len(known) == k else -np.inf
                order = np.flatnonzero((most >= least) & (most > -np.inf))
                order = order[np.argsort(-most[order], kind="stable")]
                best_s, best_at = np.empty(0, float if small else object), np.empty(0, np.int64)
                for start in range(0, len(order), STEP):
                    if len(best_s) == k and most[order[start]] < best_s[-1]:
                        break
                    some = order[start : start + STEP]
                    s, some = np.concatenate((best_s, product(x[some]))), np.concatenate((best_at, some))
                    top = np.lexsort((some, -s))[:k] if small else sorted(range(len(s)), key=lambda j: (-s[j], some[j]))[:k]
                    best_s, best_at = s[top], some[top]
                out["query_id"] += [own] * len(best_s)
                out["vec_id"] += [ids[j] for j in best_at.tolist()]
                out["score"] += [int(s) for s in best_s.tolist()]
        kind = held.schema.field("vec_id").type
        return pa.table({"query_id": pa.array(out["query_id"], kind), "vec_id": pa.array(out["vec_id"], kind), "score": pa.array(out["score"], pa.int64())})

    return V.block_search(index, k, search, schema, query_rows, candidate_rows)
