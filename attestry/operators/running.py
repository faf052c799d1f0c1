"""Running sums and carried values over hot keys: rows are cut into ranges of their order, so no key meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved

PER_RANGE = 100_000


def ranged(rows: DataFrame, keys: list[str], order: list[Column], per_range: int = PER_RANGE) -> DataFrame:
    """``rows`` with ``_range``: neighbouring numbers for neighbouring stretches of about ``per_range`` rows by keys and order.

    Rows of equal keys and order lie in one range. The ranges are written down, so a task that is run again finds the same."""
    parts = max(1, -(-rows.count() // per_range))
    return saved(rows.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()) if keys or order else rows.withColumn("_range", F.lit(0)), "ranges")


def running(rows: DataFrame, keys: list[str], order: list[Column], values: dict[str, Column], per_range: int = PER_RANGE, direct: int = 0) -> DataFrame:
    """Add, per name, the sum of its value over the earlier rows of the key (0 for the first), nulls left out.

    Sums per key and range are added up over the ranges; a window adds up inside each range. Tables of up to ``direct``
    rows, which any task can hold, have one window and no ranges; sums are the same."""
    if direct and rows.limit(direct + 1).count() <= direct:
        earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select("*", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(n) for n, v in values.items()])
    dealt = ranged(rows.withColumns({f"_value_{n}": v for n, v in values.items()}), keys, order, per_range)
    sums = dealt.groupBy(*keys, "_range").agg(*[F.sum(f"_value_{n}").alias(f"_sum_{n}") for n in values])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(*keys, "_range", *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_ahead_{n}") for n in values])
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.select(*dealt.columns, *[F.coalesce(F.sum(f"_value_{n}").over(inside), F.lit(0)).alias(f"_inside_{n}") for n in values])
    met = _met(placed, ahead, [*keys, "_range"])
    return met.select(*[met[c] for c in rows.columns], *[(F.col(f"_ahead_{n}") + F.col(f"_inside_{n}")).alias(n) for n in values])


def _met(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys, nulls too, with the facts' keys dropped."""
    named = facts.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], *[c for c in facts.columns if c not in keys])
    cond = [rows[k].eqNullSafe(named[f"_key_{i}"]) for i, k in enumerate(keys)]
    return rows.join(named, cond).drop(*[f"_key_{i}" for i in range(len(keys))])


def carried(rows: DataFrame, keys: list[str], order: str, columns: list[str], per_range: int = PER_RANGE) -> DataFrame:
    """Nulls in ``columns`` take the key's last value before them."""
    dealt = ranged(rows, keys, [F.col(order)], per_range)
    ends = dealt.groupBy(*keys, "_range").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_end_{c}") for c in columns])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ends.select(*keys, "_range", *[F.last(f"_end_{c}", ignorenulls=True).over(earlier).alias(f"_ahead_{c}") for c in columns])
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.select(*dealt.columns, *[F.last(c, ignorenulls=True).over(inside).alias(f"_inside_{c}") for c in columns])
    met = _met(placed, ahead, [*keys, "_range"])
    return met.select(*[F.coalesce(f"_inside_{c}", f"_ahead_{c}").alias(c) if c in columns else met[c] for c in rows.columns])


def quantiles(rows: DataFrame, keys: list[str], value: str, between: dict[str, float] | None = None, ranked: dict[str, float] | None = None, per_range: int = PER_RANGE, direct: int = 1_000_000) -> DataFrame:
    """Exact quantiles by key from counts of distinct values, nulls left out: ``between`` interpolates between the two
    neighbouring values, ``ranked`` takes element floor(n * p) of the sorted values (from 0, the last at most).

    Adds ``n``, ``min``, ``mean`` and ``max``. No list of a key's values is built; up to ``direct`` counts are summed by one window."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = running(counts, keys, [F.col("_v")], {"_before": F.col("_n")}, per_range, direct)
    v, up = F.col("_v"), F.col("_before") + F.col("_n")
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.min("_v").alias("_min"), (F.sum(v * F.col("_n")) / F.sum("_n")).alias("_mean"), F.max("_v").alias("_max"))
    met = _met(placed, totals, keys) if keys else placed.crossJoin(F.broadcast(totals))  # without keys: one row
    at = lambda i: F.min(F.when(up > i, v))
    found = []
    for name, p in (between or {}).items():
        spot = (F.col("_all") - 1) * F.lit(float(p))
        low, high = at(F.floor(spot)), at(F.ceil(spot))
        found.append((low + (high - low) * (F.max(spot) - F.floor(F.max(spot)))).alias(name))
    for name, p in (ranked or {}).items():
        found.append(at(F.least(F.floor(F.col("_all") * F.lit(float(p))), F.col("_all") - 1)).alias(name))
    first = [F.first(c).alias(n) for c, n in (("_all", "n"), ("_min", "min"), ("_mean", "mean"), ("_max", "max"))]
    return met.groupBy(*keys).agg(*first, *found)
