"""Batches of names: duplicates, chunks, progress, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import scalars as X
from .running import running


def validated_upload(rows: DataFrame, name: str = "institution_name", most: int = 512) -> DataFrame:
    """Uploaded rows with ``row_no`` (from 2, below the header) and ``error``, null for good rows."""
    text = F.trim(F.coalesce(F.col(name), F.lit("")))
    error = F.when(text == "", f"{name} is required").when(F.length(text) > most, f"{name} is longer than {most} characters")
    return rows.withColumn("error", error)


def deduplicated(items: DataFrame, name: str = "input_name", key: str = "id") -> DataFrame:
    """One row per normal form with the number of items and the first of them."""
    form = N.lookup_form(F.col(name))
    return items.withColumn("normalized_name", form).groupBy("normalized_name").agg(F.count(F.lit(1)).alias("items"), F.min(key).alias("first_id"))


def dedupe_saving(items: DataFrame, name: str = "input_name") -> DataFrame:
    """How many validations duplicates save: total, unique and saved."""
    form = N.lookup_form(F.col(name))
    total, unique = F.count(F.lit(1)), F.count_distinct(form)
    return items.agg(total.alias("total"), unique.alias("unique"), (total - unique).alias("saved"))


def numbered(rows: DataFrame, order: list[str], size: int = 1000) -> DataFrame:
    """Rows with ``row_no`` (from 1) and ``chunk``, numbered by ranges of the order, whatever their number."""
    out = running(rows, [], [F.col(c) for c in order], {"row_no": F.lit(1)}).withColumn("row_no", F.col("row_no") + 1)
    return out.withColumn("chunk", F.floor((F.col("row_no") - 1) / size).cast("int"))


def progress(items: DataFrame, key: str, done: Column, failed: Column) -> DataFrame:
    """Per batch: counts and the finished share in per cent, rounded half up."""
    out = items.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(done).alias("succeeded"), F.count_if(failed).alias("failed"))
    return out.withColumn("progress", X.round_half_up((F.col("succeeded") + F.col("failed")) / F.col("total") * 100))


def results(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Items with the verdict and confidence of their run."""
    r = runs.select(F.col("id").alias("run_id"), "verdict", "confidence")
    return items.join(r, "run_id", "left").select("row_no", "input_name", F.col("state").alias("status"), "verdict", "confidence")
