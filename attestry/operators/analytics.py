"""Operational analytics: rollups, queues, statistics, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..session import small
from .running import carried, quantiles, running

RISK = ["Fake", "Likely Fake", "Needs Review", "Likely Genuine", "Genuine"]
FRESH_DAYS = {"Genuine": 180, "Likely Genuine": 90, "Needs Review": 14, "Likely Fake": 30, "Fake": 7}


def hourly_rollup(rows: DataFrame, at: str, value: str, flags: dict[str, Column], extra_keys: list[str] | None = None) -> DataFrame:
    """Per hour: count, mean, exact median and 95th percentile (between neighbours), and a count for each flag.

    Percentiles come from counts of distinct values, so an hour's values never meet in one buffer."""
    keys = ["hour", *(extra_keys or [])]
    timed = rows.withColumn("hour", F.date_trunc("hour", at))
    counts = timed.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.avg(value).alias("avg_ms"), *[F.count_if(cond).alias(name) for name, cond in flags.items()])
    found = quantiles(timed, keys, value, {"p50_ms": 0.5, "p95_ms": 0.95}).select(*keys, "p50_ms", "p95_ms")
    return counts.join(found, keys, "left").select(*keys, "total", "avg_ms", "p50_ms", "p95_ms", *flags)


SKETCH_K = 800


def rollup_sketches(rows: DataFrame, at: str, value: str, keys: list[str] | None = None, k: int = SKETCH_K) -> DataFrame:
    """Per hour and ``keys``: rows, their sum, and a KLL sketch of their values, to be stored and merged without the rows.

    Nulls are left out. A sketch is a few kilobytes whatever the hour holds; its ranks are within about 2.3 / k^0.9 of the true
    ones (99 %), merged or not."""
    timed = rows.filter(F.col(value).isNotNull()).withColumn("hour", F.date_trunc("hour", F.col(at).cast("timestamp")))
    return timed.groupBy("hour", *(keys or [])).agg(F.count(F.lit(1)).alias("total"), F.sum(value).alias("sum"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged_rollup(sketches: DataFrame, width: str = "day", keys: list[str] | None = None, quantiles: dict[str, float] | None = None) -> DataFrame:
    """Hourly sketches as longer stretches (``width`` as ``date_trunc`` has it): rows, mean, and quantiles of the merged sketches."""
    grouped = sketches.groupBy(F.date_trunc(width, "hour").alias(width), *(keys or [])).agg(F.sum("total").alias("total"), F.sum("sum").alias("sum"), F.kll_merge_agg_double("sketch").alias("sketch"))
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(n) for n, p in (quantiles or {"p50": 0.5, "p95": 0.95}).items()]
    return grouped.select(width, *(keys or []), "total", (F.col("sum") / F.col("total")).alias("mean"), *found)


def with_cache_hits(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Runs with ``cache_hit``: some step was answered from a cache."""
    hits = steps.groupBy(F.col("run_id").alias("id")).agg((F.max("cache_hit") == 1).alias("cache_hit"))
    return runs.join(hits, "id", "left").fillna(False, ["cache_hit"])


def top_names(rows: DataFrame, name: str, at: str, as_of: Column, days: int = 30, limit: int = 1000) -> DataFrame:
    """The most requested names of the last days, ties by name."""
    recent = rows.filter((F.col(at) > as_of - F.make_dt_interval(F.lit(days))) & (F.col(at) <= as_of))
    return recent.groupBy(name).agg(F.count(F.lit(1)).alias("requests")).orderBy(F.desc("requests"), name).limit(limit)


def stale_queue(rows: DataFrame, verdict: str, validated: str, until: str, as_of: Column, limit: int = 500, risk: list[str] | None = None, key: str = "id") -> DataFrame:
    """What is no longer valid, riskiest first, then longest unchecked (never checked last)."""
    order = F.array_position(F.array(*[F.lit(v) for v in (risk or RISK)]), F.col(verdict))
    rank = F.when(order > 0, order).otherwise(len(risk or RISK) + 1)
    return rows.filter(F.col(until) < as_of).withColumn("risk_rank", rank).orderBy("risk_rank", F.asc_nulls_last(validated), key).limit(limit)


def stale_counts(rows: DataFrame, verdict: str, until: str, as_of: Column) -> DataFrame:
    return rows.filter(F.col(until) < as_of).groupBy(verdict).agg(F.count(F.lit(1)).alias("stale"))


def freshness(verdict: Column, validated: Column, as_of: Column) -> Column:
    """fresh, stale (to be checked again) or expired (twice the allowed age)."""
    days = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in FRESH_DAYS.items() for x in p]), verdict), F.lit(14))
    age = X.age_days(validated, as_of)
    return F.when(age <= days, "fresh").when(age <= days * 2, "stale").otherwise("expired")


def open_dead_letters(rows: DataFrame) -> DataFrame:
    return rows.filter("resolved_at IS NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("open"), F.max("last_attempt_at").alias("last_attempt_at"))


def due_retries(rows: DataFrame, as_of: Column, most: int = 3) -> DataFrame:
    """Dead letters to try again now: fewer than ``most`` attempts, and the backoff has passed."""
    wait = X.backoff_ms(F.col("attempts"), 10_000)
    return rows.filter((F.col("attempts") < most) & F.col("resolved_at").isNull() & (F.unix_millis("last_attempt_at") + wait <= F.unix_millis(as_of)))


def llm_stats(calls: DataFrame) -> DataFrame:
    """Call statistics; rates are 0 without calls."""
    share = lambda cond: F.coalesce(F.avg(cond.cast("double")), F.lit(0.0))
    return calls.agg(
        F.count(F.lit(1)).alias("calls"),
        share(F.col("cache_hit")).alias("cache_hit_rate"),
        F.coalesce(F.sum(F.col("tokens_in") + F.col("tokens_out")), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(X.llm_cost(F.col("tokens_in"), F.col("tokens_out"))), F.lit(0.0)).alias("cost_usd"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
        share(F.col("repaired")).alias("repair_rate"),
        share(F.col("error").isNotNull()).alias("error_rate"),
    )


def within_budget(calls: DataFrame, key: str, order: list[str], cost: Column, budget: float) -> DataFrame:
    """Calls with the run's cost up to them and whether the budget still held before them."""
    out = running(calls, [key], [F.col(c) for c in order], {"spent_before": cost})
    return out.withColumn("allowed", F.col("spent_before") < budget)


def share_of_total(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with their share of the key's sum; sums are added up before they travel."""
    totals = rows.groupBy(F.col(key).alias("_key")).agg(F.sum(value).alias("_total"))
    return rows.join(small(totals), rows[key].eqNullSafe(totals["_key"])).withColumn("share", F.col(value) / F.col("_total")).drop("_key", "_total")


def nearest_rank(rows: DataFrame, value: str, keys: list[str], shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Latency statistics with percentiles by nearest rank (element floor(n * p) of the sorted values, from 0)."""
    names = {f"p{round(p * 100)}": p for p in shares}
    return quantiles(rows, keys, value, ranked=names).select(*keys, "n", "min", *names, "mean", "max")


def cache_ratio(rows: DataFrame, layer: str, hit: Column) -> DataFrame:
    return rows.groupBy(layer).agg(F.count(F.lit(1)).alias("lookups"), F.count_if(hit).alias("hits"), (F.count_if(hit) / F.count(F.lit(1))).alias("hit_ratio"))


def blended_latency(values: Column) -> Column:
    """The running blend of latencies in an ordered list: half the last blend, half the new value."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(1))), F.get(values, F.lit(0)).cast("double"), lambda s, x: (s + x) / 2)


def forward_fill(rows: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """Nulls take the last value before them."""
    return carried(rows, key, order, columns)


def health(errors: DataFrame, key: str, failed: Column) -> DataFrame:
    counts = errors.groupBy(key).agg(F.count_if(failed).alias("errors"))
    return counts.withColumn("status", X.status_of_errors(F.col("errors")))


def system_stats(institutions: DataFrame, verdict: str, confidence: str) -> DataFrame:
    return institutions.groupBy(verdict).agg(F.count(F.lit(1)).alias("institutions"), F.avg(confidence).alias("avg_confidence"))


def system_overview(runs: DataFrame, evidence: DataFrame, ingested: DataFrame, today: Column) -> DataFrame:
    """One row: runs in all and their mean confidence, runs since ``today``, and counts by verdict, by tier and the last
    ingestion by authority as maps; verdicts, tiers and authorities are few."""
    totals = runs.agg(F.count(F.lit(1)).alias("institutions"), F.avg("confidence").alias("avg_confidence"), F.count_if(F.col("at") >= today).alias("runs_today"))
    maps = lambda rows, key, value, name: rows.groupBy(key).agg(value.alias("_v")).agg(F.map_from_entries(F.collect_list(F.struct(key, "_v"))).alias(name))
    out = totals
    for one in (maps(runs, "verdict", F.count(F.lit(1)), "by_verdict"), maps(evidence, "tier", F.count(F.lit(1)), "by_tier"), maps(ingested, "authority", F.max("at"), "last_ingest")):
        out = out.crossJoin(F.broadcast(one))  # one row each
    return out
