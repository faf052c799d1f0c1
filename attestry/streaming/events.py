"""Event streams: typed payloads, tumbling rollups, idempotent delivery, latest progress."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.running import running
from ..schemas import EVENT_PAYLOADS, REQUIRED_FIELDS


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def typed(events: DataFrame, kind: str, name_col: str = "name", data_col: str = "data") -> DataFrame:
    """Events of one kind with their parsed payload and ``valid``: the payload parses and its required fields are filled."""
    payload = F.from_json(data_col, EVENT_PAYLOADS[kind], {"mode": "PERMISSIVE"})
    mine = events.filter(F.col(name_col) == kind).withColumn("payload", payload)
    filled = reduce(lambda a, b: a & b, [F.col(f"payload.{f}").isNotNull() for f in REQUIRED_FIELDS[kind]])
    return mine.withColumn("valid", F.coalesce(filled, F.lit(False)))


def as_event_time(events: DataFrame, at: str) -> DataFrame:
    """Timestamps without zone count as UTC ones, so that a watermark can be set."""
    return events.withColumn(at, F.col(at).cast("timestamp"))


def tumbling_rollup(events: DataFrame, at: str, keys: list[str], aggregates: dict[str, Column], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Aggregates per window of event time and keys; on streams, windows close once the watermark passes them."""
    timed = as_event_time(events, at)
    if timed.isStreaming:
        timed = timed.withWatermark(at, late)
    grouped = timed.groupBy(F.window(at, width).alias("w"), *keys)
    return grouped.agg(*[c.alias(n) for n, c in aggregates.items()]).select(F.col("w.start").alias("hour"), *keys, *aggregates)


def idempotent(events: DataFrame, key: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Each key once, as long as its repeats come within the watermark."""
    timed = as_event_time(events, at)
    return timed.withWatermark(at, late).dropDuplicatesWithinWatermark(key) if timed.isStreaming else timed.dropDuplicates(key)


def latest_progress(updates: DataFrame, run: str = "run_id", order: str = "seq") -> DataFrame:
    """The last update of each run."""
    rest = [c for c in updates.columns if c not in (run, order)]
    return updates.groupBy(run).agg(F.max(F.struct(order, *rest)).alias("u")).select(run, "u.*")


def offered_load(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Events with ``offered``: how many of their key fell into the ``seconds`` that end with their second, itself included.

    Counts per second are kept in the stretch of ``seconds`` they lie in and, as history, in the next one, so a hot key is
    split by time: a task holds two stretches of seconds at most."""
    timed = events.withColumn("_s", F.unix_seconds(F.col(at).cast("timestamp")))
    per_second = timed.groupBy(key, "_s").agg(F.count(F.lit(1)).alias("_n")).withColumn("_own", F.floor(F.col("_s") / seconds))
    told = per_second.withColumn("_stretch", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = Window.partitionBy(key, "_stretch").orderBy("_s").rangeBetween(-seconds + 1, 0)
    sums = told.withColumn("offered", F.sum("_n").over(w)).filter("_stretch = _own").select(F.col(key).alias("_key"), F.col("_s").alias("_at"), "offered")
    return timed.join(sums, timed[key].eqNullSafe(sums["_key"]) & (timed["_s"] == sums["_at"])).drop("_s", "_key", "_at")


def over_limit(events: DataFrame, key: str, at: str, seconds: int, limit: int) -> DataFrame:
    """Per key and stretch of ``seconds``: events, and how many of them exceed ``limit``; on streams, by watermark."""
    counts = tumbling_rollup(events, at, [key], {"offered": F.count(F.lit(1))}, f"{seconds} seconds")
    return counts.withColumn("excess", F.greatest(F.col("offered") - limit, F.lit(0)))


def failure_runs(events: DataFrame, key: str, order: list[str], failed: Column, least: int = 2) -> DataFrame:
    """Unbroken runs of at least ``least`` failures of a key: (key, ``run``, ``failures``, first and last order value).

    Successes before an event number the runs: failures between two successes share a number."""
    told = running(events.withColumn("_failed", F.coalesce(failed, F.lit(False))), [key], [F.col(c) for c in order], {"run": F.when(F.col("_failed"), 0).otherwise(1)})
    runs = told.filter("_failed").groupBy(key, "run").agg(F.count(F.lit(1)).alias("failures"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))
    return runs.filter(F.col("failures") >= least)
