"""Uploaded lists of names and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.batch import numbered, validated_upload
from ..schemas import SCHEMAS

COLUMNS = ["institution_name", "university_name", "state", "district"]


def read_upload(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejected rows of a CSV with a header; rows are numbered from 2 and empty lines are skipped."""
    header = spark.read.csv(path, header=True, inferSchema=False)
    if COLUMNS[0] not in header.columns:
        raise ValueError(f"the file has no column {COLUMNS[0]}")
    rows = header.select(*[F.col(c) if c in header.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS])
    placed = numbered(rows.withColumn("_at", F.monotonically_increasing_id()), ["_at"]).drop("_at", "chunk")
    checked = validated_upload(placed.withColumn("row_no", F.col("row_no") + 1))
    return checked.filter("error IS NULL").drop("error"), checked.filter("error IS NOT NULL")


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").csv(path, header=True)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table under its schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def create_tables(spark: SparkSession, database: str, location: str | None = None) -> None:
    """An empty Parquet table for each schema, below ``location`` if one is given, else in the warehouse."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}" + (f" LOCATION '{location}'" if location else ""))
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").saveAsTable(f"{database}.{name}")


def drop_tables(spark: SparkSession, database: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
