"""Ranks and running sums over hot groups, dealt out by hash buckets so that no group meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_hash(seed, *cols: Column) -> Column:
    """Seeded order as 32 hex digits; ``seed`` may be a column. Nulls count as empty."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", seed, *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def hash_bucket(hashed: Column, buckets: int) -> Column:
    """Bucket 0 to ``buckets`` - 1, rising with the order of ``hashed``."""
    return F.shiftright(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") * F.lit(buckets).cast("long"), 32)


def bucket_count(rows: int, per_bucket: int = 1024, most: int = 1 << 22) -> int:
    return max(1, min(most, -(-rows // per_bucket)))


def group_key(col: Column) -> Column:
    """A non-null string for a value, null included."""
    return F.when(col.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), col.cast("string")))


def running(rows: DataFrame, group: str, bucket: str, order: list, value: Column, before: str, total: str) -> DataFrame:
    """Add ``before``, the sum of ``value`` over the group's earlier rows, and ``total``, the group's sum.

    Rows of a group are ordered by ``bucket`` then ``order``. Sums per (group, bucket) are gathered first; within a
    bucket a window adds up. One task holds one bucket of rows, or one row for each bucket of a group.
    """
    sums = rows.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    by_group = Window.partitionBy(group)
    ahead = sums.select(
        group,
        bucket,
        F.coalesce(F.sum("_sum").over(by_group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"),
        F.sum("_sum").over(by_group).alias(total),
    )
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(ahead, [group, bucket])
        .withColumn(before, F.col("_ahead") + F.col("_inside"))
        .drop("_ahead", "_inside")
    )
