"""Shared layout of the two vector searches: usable rows, packed vectors, and query blocks meeting candidate blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved, ship


def usable(vec: Column) -> Column:
    """True for vectors that are not null and hold neither nulls nor non-finite numbers."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def packed_rows(vectors: DataFrame, id_col: str, vector_col: str, query: Column, scale: int | None = None) -> DataFrame:
    """Usable rows as (``vec_id``, ``v`` packed doubles, ``is_query``); with ``scale``, components become floor(scale * x)."""
    ship(vectors.sparkSession)

    @F.arrow_udf("binary")
    def pack(column: pa.Array) -> pa.Array:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        if scale is not None:
            flat = np.floor(scale * flat)
        raw, ends = flat.tobytes(), np.concatenate(([0], np.cumsum(np.asarray(column.value_lengths(), np.int64)))) * 8
        return pa.array([raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())

    rows = vectors.filter(usable(F.col(vector_col)))
    return rows.select(F.col(id_col).alias("vec_id"), pack(F.col(vector_col)).alias("v"), F.coalesce(query, F.lit(False)).alias("is_query"))


def matrix(column: pa.ChunkedArray | list, dims: int) -> np.ndarray:
    """Rows of packed doubles, zero-padded or cut to ``dims``."""
    parts = column if isinstance(column, list) else column.to_pylist()
    if all(len(p) == 8 * dims for p in parts):
        return np.frombuffer(b"".join(parts), np.float64).reshape(len(parts), dims)
    return np.array([np.pad(np.frombuffer(p, np.float64)[:dims], (0, max(0, dims - len(p) // 8))) for p in parts]).reshape(len(parts), dims)


def sample_rows(rows: DataFrame, count: int) -> list[bytes]:
    """``count`` distinct packed vectors, the first by a hash of the vector: bounded, and alike on every run."""
    return [r["v"] for r in rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(count).collect()]


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows of a sample, each the one farthest from those before it."""
    if not len(sample):
        return sample
    with np.errstate(all="ignore"):
        taken, far = [0], np.square(sample - sample[0]).sum(axis=1)
        while len(taken) < min(count, len(sample)):
            taken.append(int(far.argmax()))
            far = np.minimum(far, np.square(sample - sample[taken[-1]]).sum(axis=1))
    return sample[taken]


def block_search(index: DataFrame, k: int, search: Callable[[pa.Table, pa.Table], pa.Table], result: str, query_rows: int, candidate_rows: int) -> DataFrame:
    """Run ``search`` on every pair of a query block and a candidate block, then keep each query's ``k`` best.

    ``index`` has ``vec_id``, ``v``, ``is_query`` and what the method adds. Rows are dealt to blocks by a hash, so a
    task holds at most about ``query_rows`` queries and ``candidate_rows`` candidates whatever the table's size; each
    query row travels once per candidate block and each candidate once per query block. Rows of one id are dealt by
    their vectors too.
    """
    counts = index.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("q")).first()
    q_blocks, c_blocks = max(1, -(-counts["q"] // query_rows)), max(1, -(-counts["n"] // candidate_rows))
    own = lambda n, salt: F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    queries = index.filter("is_query").withColumn("_q", own(q_blocks, 1)).withColumn("_c", every(c_blocks))
    candidates = index.withColumn("_c", own(c_blocks, 2)).withColumn("_q", every(q_blocks))
    met = queries.groupBy("_q", "_c").cogroup(candidates.groupBy("_q", "_c")).applyInArrow(search, result)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
