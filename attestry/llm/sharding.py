"""Sharding by proportional stratified interleaving, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import set_aside
from .ranking import bucket_count, group_key, hash_bucket, order_hash, running


def interleave_shards(rows: DataFrame, strata: str = "source", id_col: str = "doc_id", shards: int = 16, seed: int = 17, tie_cols: tuple[str, ...] = (), per_bucket: int = 1024) -> DataFrame:
    """All columns of ``rows`` plus ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    Rows of each stratum are shuffled by a seeded hash of their id and ranked 1..n; they are then ordered by the
    fractional rank (rank - 1/2) / n over all strata and cut into shards whose row counts differ by one at most.
    Every shard holds each stratum in proportion, to within two rows. Null strata form a stratum of their own; equal
    ids, null ones too, are told apart by ``tie_cols``; fully equal rows are interchangeable. Texts, of any length, are
    only carried along. Fewer rows than shards leave shards empty; an empty table gives an empty result. Columns of
    ``rows`` named as a result are replaced, others keep their values whatever their names.

    Besides buckets of about ``per_bucket`` rows, one task sees one number for each bucket, of which there are 2^22 at most.
    """
    ties = {f"_tie{i}": F.coalesce(F.col(c).cast("string"), F.lit("")) for i, c in enumerate(tie_cols)}
    keyed, back = set_aside(rows, _key=group_key(F.col(strata)), _order=order_hash(seed, F.col(id_col)), **ties)
    n = rows.count()
    buckets = bucket_count(n, per_bucket)
    keyed = keyed.withColumn("_bucket", hash_bucket(F.col("_order"), buckets))
    ranked = running(keyed, "_key", "_bucket", ["_order", *ties], F.lit(1).cast("long"), "_before", "_total")
    odd = F.col("_before") * 2 + 1  # fractional rank = odd / (2 * total)
    spread = ranked.withColumn("_fraction", odd.cast("double") / (F.col("_total") * 2)).withColumn("_bucket", F.floor(F.col("_fraction") * buckets))
    ahead = spread.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("_bucket").orderBy("_fraction", "_key", "_order", *ties)
    placed = spread.withColumn("_inside", F.row_number().over(inside) - 1).join(ahead, "_bucket").withColumn("_place", F.col("_ahead") + F.col("_inside"))
    placed = placed.withColumn("_shard", F.expr(f"_place * {shards} div {max(n, 1)}"))
    first = F.expr(f"(_shard * {n} + {shards - 1}) div {shards}")
    return placed.select(*back("shard", "slot"), F.col("_shard").cast("int").alias("shard"), (F.col("_place") - first).alias("slot"))
