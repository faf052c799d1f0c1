"""Approximate nearest neighbours by a permutation index: pivot inverted files, footrule distance, rerank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import saved, ship
from . import vectors as V


def permutation_neighbours(vectors: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = 2048, prefix: int = 64, rerank: float = 0.125, at_least: int = 10, query_rows: int = 2048, candidate_rows: int = 8192) -> DataFrame:
    """Rows (``query_id``, ``rank`` from 1, ``vec_id``, ``score``): for each row where ``query`` holds, its ``k`` nearest found.

    Nearness is the inner product in double precision on the original vectors, ties to the smaller id. Every vector
    is represented by its ``prefix`` nearest of ``pivots`` pivots (by angle), in order; pivots are a bounded sample
    of the rows (``pivots`` of them), but every row is indexed. Each block of candidates is posted in one inverted file
    per pivot: a list of the vectors that have the pivot in their order, and at which place. A query reads the files of
    its own ``prefix`` pivots only, about ``prefix``^2 / ``pivots`` postings per vector, and adds up the footrule distance
    over its pivots: the difference of places, or ``prefix`` for a vector that is not in the file. The share ``rerank``
    of all rows with the smallest distances, but no fewer than ``at_least`` times ``k``, is compared exactly; each block
    gives its part. The share is of all rows, so recall does not fall as the table grows.

    Vectors that are null, zero, or hold null or non-finite components take no part. Shorter vectors count as padded
    with zeros. Repeated rows are separate candidates, but a row never meets its own id; null ids are ids like others.
    Other columns are not read, so their names cannot clash. An empty table gives an empty result.
    """
    rows = saved(V.packed_rows(vectors.filter(F.exists(F.col(vector_col), lambda x: x.cast("double") != 0)), id_col, vector_col, query), "vectors")
    ship(rows.sparkSession)
    facts = rows.agg(F.max(F.octet_length("v")).alias("size"), F.count(F.lit(1)).alias("n")).first()
    dims, share = (facts["size"] or 0) // 8, max(rerank, at_least * k / max(1, facts["n"]))
    points = V.matrix(V.sample_rows(rows, pivots), dims)
    points = points / np.maximum(np.abs(points).max(axis=1, keepdims=True, initial=0.0), 1e-300)
    points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)
    length = min(prefix, len(points))

    @F.arrow_udf("binary")
    def order(column: pa.Array) -> pa.Array:
        x, out = V.matrix(column.to_pylist(), dims), []
        x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
        for at in range(0, len(x), 1024):
            away = -(x[at : at + 1024] @ points.T)
            edge = np.partition(away, length - 1, axis=1)[:, length - 1 : length]
            for row, last in zip(away, edge):  # of pivots equally far the first counts
                near = np.flatnonzero(row <= last)
                out.append(near[np.argsort(row[near], kind="stable")][:length].astype(np.int16).tobytes())
        return pa.array(out, pa.binary())

    index = saved(rows.withColumn("order", order("v")), "permutations")
    schema = f"query_id {dict(rows.dtypes)['vec_id']}, vec_id {dict(rows.dtypes)['vec_id']}, score double"

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        kind = held.schema.field("vec_id").type
        if asked.num_rows and held.num_rows:
            held = held.sort_by("vec_id")
            ids, x = held["vec_id"].to_numpy(), V.matrix(held["v"], dims)
            n = len(ids)
            told = np.frombuffer(b"".join(held["order"].to_pylist()), np.int16)
            by_pivot = np.argsort(told, kind="stable")
            posted, places = by_pivot // length, by_pivot % length
            file_starts = np.searchsorted(told[by_pivot], np.arange(len(points) + 1))
            wanted = np.frombuffer(b"".join(asked["order"].to_pylist()), np.int16).reshape(asked.num_rows, length)
            q, keep = V.matrix(asked["v"], dims), min(n, int(np.ceil(share * n)))
            for i, own in enumerate(asked["vec_id"].to_pylist()):
                files = [(file_starts[p], file_starts[p + 1]) for p in wanted[i].tolist()]
                read = np.concatenate([posted[a:b] for a, b in files])
                saves = np.concatenate([length - np.abs(places[a:b] - at) for at, (a, b) in enumerate(files)])
                footrule = length * length - np.bincount(read, saves, n)
                near = np.argpartition(footrule * n + np.arange(n), keep - 1)[:keep] if keep < n else np.arange(n)
                near = near[ids[near] != own]
                rough = x[near] @ q[i]
                if len(near) > k:
                    edge = np.partition(rough, len(rough) - k)[len(rough) - k]
                    near = near[rough >= edge - 1e-9 * (1.0 + abs(edge))]
                exact = (x[near] * q[i]).sum(axis=1)  # summed alike for every row, so that copies tie
                top = np.lexsort((ids[near], -exact))[:k]
                out["query_id"] += [own] * len(top)
                out["vec_id"] += ids[near[top]].tolist()
                out["score"] += exact[top].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], kind), "vec_id": pa.array(out["vec_id"], kind), "score": pa.array(out["score"], pa.float64())})

    return V.block_search(index, k, search, schema, query_rows, candidate_rows)
