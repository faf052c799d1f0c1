"""One table of the last update of each run that micro-batches change in place, without rewriting what they do not touch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class LatestTable:
    """Runs in buckets of files. A batch rewrites the buckets that it touches as files of its own number, then logs its number
    and those buckets; readers take, of each bucket, the files of the last logged batch.

    A batch that is already logged changes nothing when it comes again. A batch that was lost before it was logged is as if it had
    not begun, and its files are replaced when it comes again. Batches come one at a time and in order, as a stream gives
    them."""

    def __init__(self, spark: SparkSession, root: str, run: str = "run_id", order: str = "seq", buckets: int = 32):
        self.spark, self.root, self.run, self.order, self.buckets = spark, root.rstrip("/"), run, order, buckets

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def current(self) -> dict[int, int]:
        """The batch whose files hold each bucket; as many entries as there are buckets at most."""
        log = self._read("log")
        return {} if log is None else {r["bucket"]: r["batch"] for r in log.filter("bucket >= 0").groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.run), F.lit(self.buckets)).cast("int")

    def _held(self, current: dict[int, int]) -> DataFrame | None:
        """Rows of these buckets, files of other batches pruned; ``_batch`` is the one that brought the row."""
        if not current:
            return None
        files = [f"{b}:{n}" for b, n in current.items()]
        return self._read("runs").filter(F.concat_ws(":", "bucket", "version").isin(files)).drop("version", "bucket")

    def read(self) -> DataFrame | None:
        """The last update of each run."""
        rows = self._held(self.current())
        return None if rows is None else rows.drop("_batch")

    def merge(self, updates: DataFrame, batch: int) -> None:
        """Take in a batch of updates: of a run the greatest ``order`` stays, of equal ones the later batch, then any one row by
        all its columns. Null orders come before all others."""
        log = self._read("log")
        if log is not None and not log.filter(F.col("batch") >= batch).isEmpty():
            return
        updates.persist()
        try:
            touched = [r[0] for r in updates.select(self._bucket()).distinct().collect()]
            rows = updates.withColumn("_batch", F.lit(batch).cast("long"))
            current = self.current()
            old = self._held({b: n for b, n in current.items() if b in touched})
            rows = rows if old is None else rows.unionByName(old)
            rest = [c for c in rows.columns if c not in (self.run, self.order, "_batch")]
            last = rows.groupBy(self.run).agg(F.max(F.struct(self.order, "_batch", *rest)).alias("u")).select(self.run, "u.*")
            if touched:
                dealt = last.withColumn("bucket", self._bucket()).withColumn("version", F.lit(batch).cast("long")).repartition("bucket")
                mode = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                mode.partitionBy("version", "bucket").parquet(f"{self.root}/runs")
            marks = [(batch, b) for b in touched] or [(batch, -1)]
            self.spark.createDataFrame(marks, "batch long, bucket int").coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        finally:
            updates.unpersist()

    def sweep(self) -> None:
        """Delete files that no reader takes any more; call it when no reader that began before the last batch is left."""
        current = {f"version={n}/bucket={b}" for b, n in self.current().items()}
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(f"{self.root}/runs")
        fs = root.getFileSystem(conf)
        for version in fs.listStatus(root):
            for bucket in fs.listStatus(version.getPath()) if version.isDirectory() and version.getPath().getName().startswith("version=") else []:
                if f"{version.getPath().getName()}/{bucket.getPath().getName()}" not in current:
                    fs.delete(bucket.getPath(), True)


def write_latest(updates: DataFrame, root: str, checkpoint: str, run: str = "run_id", order: str = "seq", buckets: int = 32):
    """A writer of a stream of updates into the latest table under ``root``; start it, and read with ``LatestTable.read``."""
    table = LatestTable(updates.sparkSession, root, run, order, buckets)
    return updates.writeStream.option("checkpointLocation", checkpoint).foreachBatch(table.merge)
