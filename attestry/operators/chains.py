"""Chains of pointers followed to their ends by pointer jumping, in rounds that grow with the logarithm of a chain's length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved


def chain_ends(steps: DataFrame) -> DataFrame:
    """Where each ``from_id`` ends when ``to_id`` is followed on and on (``from_id``, ``to_id``); cycles end at their smallest id.

    Of several targets of one id the smallest counts; steps to itself and steps with nulls are none. The smallest id of a
    cycle is an end, so it has no row. Each round doubles how far every pointer reaches, and writes one table, so a lost
    executor repeats one round at most. Pointers that have arrived are left alone.
    """
    first = steps.filter("from_id <> to_id").groupBy("from_id").agg(F.min("to_id").alias("to_id"))
    first = saved(first, "chain-steps")
    onward = F.broadcast if first.count() <= 100_000 else (lambda keys: keys)
    moves = first.select(F.col("from_id").alias("to_id"), F.lit(True).alias("_on"))
    state = first.join(onward(moves), "to_id", "left").select("from_id", "to_id", F.col("to_id").alias("low"), F.coalesce("_on", F.lit(False)).alias("open"))
    reach, settled = 1, False
    while True:
        state = saved(state, "chain-round")
        left = state.filter("open").count()
        if left == 0:
            return state.select("from_id", "to_id")
        if settled:  # so what is left leads into cycles
            smallest = state.filter("open AND low = from_id").select("from_id")
            return chain_ends(first.join(smallest, "from_id", "left_anti"))
        # A chain of length n that has not arrived leaves n - reach pointers open, so once these are no more than the reach,
        # n is at most twice the reach, and the next round is the last that a chain needs.
        settled = reach >= left
        ahead = state.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("_to"), F.col("low").alias("_low"), F.col("open").alias("_open"))
        jumped = state.filter("open").join(ahead, "to_id").select("from_id", F.col("_to").alias("to_id"), F.least("low", "_low").alias("low"), F.col("_open").alias("open"))
        state = state.filter("NOT open").unionByName(jumped)
        reach *= 2
