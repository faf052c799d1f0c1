"""Incremental backfill: which keys have not been done, from stored Bloom filters, read from the stored keys only where a filter cannot tell."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import saved, ship

BITS_A_KEY, PROBES = 10, 7


def _places(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """Bits of keys by double hashing, a row a key."""
    step = second.view(np.uint64) | np.uint64(1)
    return (first.view(np.uint64)[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


def _filter_of(table: pa.Table) -> pa.Table:
    """The Bloom filter of one bucket's keys."""
    places = _places(table["h1"].to_numpy().copy(), table["h2"].to_numpy().copy(), bits := max(64, BITS_A_KEY * len(table)))
    marks = np.zeros(bits, np.uint8)
    marks[places.ravel()] = 1
    return pa.table({"bucket": table["bucket"].slice(0, 1).combine_chunks(), "bits": pa.array([bits], pa.int64()), "marks": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})


def _told_apart(asked: pa.Table, filters: pa.Table) -> pa.Table:
    """Keys of one bucket with ``maybe``: one of its filters holds all their bits."""
    first, second = asked["h1"].to_numpy().copy(), asked["h2"].to_numpy().copy()
    maybe = np.zeros(len(asked), bool)
    for bits, marks in zip(filters["bits"].to_pylist(), filters["marks"].to_pylist()):
        held = np.unpackbits(np.frombuffer(marks, np.uint8), bitorder="little")
        maybe |= held[_places(first, second, bits)].all(axis=1)
    return asked.select(["key", "bucket"]).append_column("maybe", pa.array(maybe))


class DoneKeys:
    """Keys (strings) under a folder, a generation each time some are added: the keys by bucket, a Bloom filter per bucket (ten bits a key, one key
    in a hundred is mistaken), and a log that is written last, so a lost ``add`` is as if it had not begun."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = ship(spark), root.rstrip("/"), buckets

    def _generations(self) -> list[int]:
        try:
            return sorted(r["gen"] for r in self.spark.read.parquet(f"{self.root}/log").collect())
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return []

    def _hashed(self, keys: DataFrame, key: Column) -> DataFrame:
        once = keys.select(key.alias("key")).filter("key IS NOT NULL").distinct()
        hashed = once.select("key", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("done"), "key").alias("h2"))
        return hashed.withColumn("bucket", F.pmod(F.xxhash64("h1"), F.lit(self.buckets)).cast("int"))

    def add(self, keys: DataFrame, key: str = "key") -> None:
        """Take keys as done; those that are already cost a little space and change nothing."""
        gen = max(self._generations(), default=0) + 1
        self._hashed(keys, F.col(key)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/keys/gen={gen}")
        written = self.spark.read.schema("key string, h1 long, h2 long, bucket int").parquet(f"{self.root}/keys/gen={gen}")
        filters = written.groupBy("bucket").applyInArrow(_filter_of, "bucket int, bits long, marks binary")
        filters.write.mode("overwrite").parquet(f"{self.root}/filters/gen={gen}")
        self.spark.range(1).select(F.lit(gen).alias("gen")).coalesce(1).write.mode("append").parquet(f"{self.root}/log")

    def missing(self, rows: DataFrame, key: str = "key") -> DataFrame:
        """Distinct keys (``key``) of ``rows`` that are not done, exactly; null keys are left out.

        What no filter holds is not done and never meets the stored keys; the rest meets those of its own buckets."""
        asked, generations = self._hashed(rows, F.col(key)), self._generations()
        if not generations:
            return asked.select("key")
        filters = self.spark.read.schema("bucket int, bits long, marks binary, gen int").parquet(f"{self.root}/filters").filter(F.col("gen").isin(generations))
        told = asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_told_apart, "key string, bucket int, maybe boolean")
        told = saved(told, "backfill")
        wanted = [r[0] for r in told.filter("maybe").select("bucket").distinct().collect()]  # as many as there are buckets at most
        done = self.spark.read.schema("key string, h1 long, h2 long, gen int, bucket int").parquet(f"{self.root}/keys").filter(F.col("gen").isin(generations) & F.col("bucket").isin(wanted))
        return told.filter("NOT maybe").select("key").unionByName(told.filter("maybe").join(done.select("key", "bucket"), ["key", "bucket"], "left_anti").select("key"))
