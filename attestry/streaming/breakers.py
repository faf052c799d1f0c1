"""State of each provider as calls come in: blended latency and the unbroken run of failures, in the order of the calls' own time
whatever the order in which they arrive; a provider that is idle for long is forgotten."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.running import PER_RANGE, ranged, running
from ..session import ship

IDLE_SECONDS = 3600
SPAN_MS = 3_600_000
STATE = "key string, at timestamp, id long, blended double, calls long, failures long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Breaker(StatefulProcessor):
    """Per key: what is blended so far, and calls that wait until the watermark has passed them, so that late ones take their place.

    Calls wait in a list for each span of ``SPAN_MS`` of their time, and a key has one timer: at the first span that waits, or, if
    none does, when the key has been idle. So a batch reads and writes only the spans that it adds to or that are due."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", "blended double, calls long, failures long, last long")
        self.waiting = handle.getMapState("waiting", "span long", "calls array<struct<at:long,id:long,value:double,failed:boolean>>")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        spans: dict[int, list] = {}
        for batch in rows:
            at = batch["at"].astype("int64") // 1000 if batch["at"].dtype == "datetime64[us]" else batch["at"].astype("datetime64[us]").astype("int64") // 1000
            for call in zip(at.tolist(), batch["id"].tolist(), batch["value"].tolist(), batch["failed"].tolist()):
                spans.setdefault(call[0] // SPAN_MS, []).append(call)
        for span, calls in spans.items():
            self._put(span, [*self._held(span), *calls])
        if spans:
            self._wake(min(c[0] for calls in spans.values() for c in calls))
        yield from ()

    def _held(self, span: int) -> list[tuple]:
        return [tuple(c) for c in self.waiting.getValue((span,))[0]] if self.waiting.containsKey((span,)) else []

    def _put(self, span: int, calls: list[tuple]) -> None:
        if calls:
            self.waiting.updateValue((span,), (calls,))
        else:
            self.waiting.removeKey((span,))

    def _wake(self, at: int, anew: bool = False) -> None:
        """The key's timer at ``at``; one that is earlier stays, unless told ``anew``."""
        old = self.timer.get()[0] if self.timer.exists() else None
        if old is not None and (old > at or anew and old != at):
            self.handle.deleteTimer(old)
        if old is None or old > at or anew:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        state = tuple(self.folded.get()) if self.folded.exists() else None
        self.timer.clear()  # it has expired
        waiting, out, next_at = sorted(s[0] for s in self.waiting.keys()), [], None
        for span in waiting:
            if span * SPAN_MS > until:
                next_at = span * SPAN_MS
                break
            held = self._held(span)
            later = [c for c in held if c[0] > until]
            for at, number, value, failed in sorted(c for c in held if c[0] <= until):
                if state is None or at - state[3] > self.idle_ms:
                    state = (None, 0, 0, at)
                state = (value if state[0] is None else (state[0] + value) / 2, state[1] + 1, state[2] + 1 if failed else 0, at)
                out.append((key[0], pd.Timestamp(at, unit="ms"), number, *state[:3]))
            self._put(span, later)
            if later:
                next_at = min(c[0] for c in later)
                break
        if state is not None and until > state[3] + self.idle_ms:
            self.folded.clear()
            state = None
        elif out:
            self.folded.update(state)
        if next_at is not None or state is not None:
            self._wake(next_at if next_at is not None else state[3] + self.idle_ms + 1)
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "id", "blended", "calls", "failures"])

    def close(self) -> None:
        pass


def breaker_stream(calls: DataFrame, late: str = "10 minutes", idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """A stream of the state after each call of ``calls`` (``key``, ``at``, ``id``, ``value``, ``failed``): ``blended`` (half the last blend, half the new value),
    ``calls`` and ``failures`` in a row, once the watermark has passed the call. Calls later than ``late`` are dropped, as by any
    watermark; a call more than ``idle_seconds`` after the last one begins anew; calls without a key are left out. State is one row a key and the calls that wait."""
    spark = ship(calls.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    named = calls.filter("key IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at"), F.col("id").cast("long").alias("id"), F.col("value").cast("double").alias("value"), F.coalesce("failed", F.lit(False)).alias("failed"))
    return named.withWatermark("at", late).groupBy("key").transformWithStateInPandas(Breaker(idle_seconds * 1000), STATE, outputMode="Append", timeMode="EventTime")


def breaker_states(calls: DataFrame, idle_seconds: int = IDLE_SECONDS, per_range: int = PER_RANGE) -> DataFrame:
    """The state of each key after its last call, as ``breaker_stream`` has it, from a table: ``key``, ``at``, ``id``, ``blended``, ``calls``, ``failures``.

    A call's weight in the blend is a power of one half told by how many calls follow, so the blend is a sum by ranges and no
    list of a key's calls is built."""
    rows = calls.filter("key IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at"), F.col("id").cast("long").alias("id"), F.col("value").cast("double").alias("value"), F.coalesce("failed", F.lit(False)).alias("failed"))
    order = [F.col("at"), F.col("id")]
    dealt = ranged(rows, ["key"], order, per_range)
    inside = Window.partitionBy("key", "_range").orderBy(*order)
    ends = dealt.groupBy("key", "_range").agg(F.max("at").alias("_end"))
    ahead = ends.select("key", "_range", F.max("_end").over(Window.partitionBy("key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_ahead"))
    before = F.coalesce(F.lag("at").over(inside), "_ahead")
    timed = dealt.join(ahead, ["key", "_range"]).withColumn("_new", F.coalesce((F.unix_millis("at") - F.unix_millis(before) > idle_seconds * 1000).cast("int"), F.lit(0)))
    spells = running(timed.drop("_range", "_ahead"), ["key"], order, {"_earlier": F.col("_new")}, per_range).withColumn("_spell", F.col("_earlier") + F.col("_new"))
    last = spells.groupBy("key").agg(F.max("_spell").alias("_last"))
    spell = spells.join(last, "key").filter("_spell = _last").select("key", "at", "id", "value", "failed")
    placed = running(spell, ["key"], order, {"_no": F.lit(1)}, per_range)
    totals = spell.groupBy("key").agg(F.count(F.lit(1)).alias("calls"), F.max(F.struct("at", "id")).alias("_at"), F.max(F.when(~F.col("failed"), F.struct("at", "id"))).alias("_ok"))
    met = placed.join(totals, "key")
    weight = F.pow(F.lit(0.5), F.col("calls") - F.greatest(F.col("_no"), F.lit(1)))
    return met.groupBy("key").agg(
        F.first("_at.at").alias("at"), F.first("_at.id").alias("id"), F.sum(F.col("value") * weight).alias("blended"), F.first("calls").alias("calls"),
        F.count_if(F.col("_ok").isNull() | (F.struct("at", "id") > F.col("_ok"))).alias("failures"),
    )
