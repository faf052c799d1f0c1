"""Rows kept in the order of their pages, so that a page reads the one or two files that hold it instead of sorting the table."""

from __future__ import annotations

import base64
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


class ClusteredRows:
    """Rows cut by range into parts of about ``per_part`` rows, each in files of its own and sorted, and a small table of what each part
    holds. There are ``most_parts`` at most, so larger tables have larger parts, not more files and tasks than the driver can list. ``order`` names the columns, ascending, nulls last; the last one must be unique and not null."""

    def __init__(self, spark: SparkSession, root: str, order: list[str]):
        self.spark, self.root, self.order = spark, root.rstrip("/"), order

    def _sorted(self, backward: bool = False) -> list[Column]:
        return [F.desc_nulls_first(c) if backward else F.asc_nulls_last(c) for c in self.order]

    def build(self, rows: DataFrame, per_part: int = 10_000, most_parts: int = 512) -> None:
        """Write ``rows`` and the table of parts, replacing what was there."""
        parts = min(max(1, -(-rows.count() // per_part)), most_parts)
        dealt = rows.repartitionByRange(parts, *self._sorted()).sortWithinPartitions(*self._sorted()).withColumn("part", F.spark_partition_id())
        dealt.write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/rows")
        rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/schema")
        held = self._held()
        key = F.struct(*[x for c in self.order for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c))])
        told = held.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.max(key).alias("last"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part: the table is small
        told.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/parts")

    def _parts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/parts")

    def _held(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.root}/schema").schema.add("part", IntegerType())
        return self.spark.read.schema(schema).parquet(f"{self.root}/rows")

    def _rows(self, parts: DataFrame) -> DataFrame:
        """Rows of these parts, as few as a page spans; all other files are pruned."""
        return self._held().filter(F.col("part").isin([r["part"] for r in parts.select("part").collect()]))

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` from 1 on: where it lies is told by the parts' counts, so nothing before it is read."""
        start = (number - 1) * size
        mine = self._parts().filter((F.col("before") < start + size) & (F.col("before") + F.col("n") > start))
        first = mine.agg(F.min("before")).first()[0]
        return self._rows(mine).orderBy(*self._sorted()).offset(start - (first or 0)).limit(size).drop("part")

    def after(self, cursor: str | None, size: int, backward: bool = False) -> DataFrame:
        """The ``size`` rows behind a cursor (before it, nearest first, if ``backward``), each with its own ``cursor``."""
        rows, at = self._parts(), self.decode(cursor) if cursor else None
        if at is not None:
            key = F.struct(*[x for c in self.order for x in (F.lit(at[c] is None), F.lit(at[c]))]).cast(rows.schema["last"].dataType)
            home = rows.filter(F.col("last") >= key).orderBy("part").limit(1).select("before", "n").first()
            edge = home["before"] if home else rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            n = home["n"] if home else 0
            rows = rows.filter((F.col("before") + F.col("n") > edge - size) & (F.col("before") <= edge)) if backward else rows.filter((F.col("before") >= edge) & (F.col("before") < edge + n + size))
        elif backward:
            total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            rows = rows.filter(F.col("before") + F.col("n") > total - size)
        else:
            rows = rows.filter(F.col("before") < size)
        held = self._rows(rows)
        kept = held if at is None else held.filter(self._beyond(at, backward))
        told = F.base64(F.encode(F.to_json(F.struct(*self.order), {"ignoreNullFields": "false"}), "utf-8"))
        return kept.orderBy(*self._sorted(backward)).limit(size).drop("part").withColumn("cursor", told)

    def encode(self, row: dict) -> str:
        return base64.b64encode(json.dumps({c: row[c] for c in self.order}).encode()).decode()

    def decode(self, cursor: str) -> dict:
        return json.loads(base64.b64decode(cursor))

    def _beyond(self, at: dict, backward: bool) -> Column:
        """Rows behind (or before) the cursor's row in the order."""
        def past(c: str) -> Column:
            if backward:
                return F.col(c).isNotNull() if at[c] is None else F.col(c) < F.lit(at[c])
            return F.lit(False) if at[c] is None else (F.col(c) > F.lit(at[c])) | F.col(c).isNull()

        same = lambda c: F.col(c).eqNullSafe(F.lit(at[c]))
        return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [*[same(x) for x in self.order[:i]], past(c)]) for i, c in enumerate(self.order)])
