"""Session helpers: builder, code shipping, and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
_written: dict[str, list[str]] = {}


def build_session(app: str = "attestry", master: str | None = None, cores: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine is tested with (UTC, AQE); ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if cores:
        settings["spark.sql.shuffle.partitions"] = str(cores)
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, once per application, wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        if root.parent.is_dir():  # not itself imported from an archive
            target = os.path.join(tempfile.mkdtemp(), f"{root.name}_code.zip")
            with zipfile.ZipFile(target, "w") as archive:
                for path in sorted(root.rglob("*.py")):
                    archive.write(path, path.relative_to(root.parent))
            sc.addPyFile(target)
        _shipped.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; in local mode alone, a temporary one if unset."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = f"local:{sc.applicationId}"
    if key not in _written:
        _written[key] = [tempfile.mkdtemp(prefix="attestry-")]
    return f"file://{_written[key][0]}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attestry/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it holds ``rows`` rows at most, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(scan: DataFrame) -> DataFrame:
    """Deal a plain scan out over all cores if it has fewer splits than these; larger inputs are left as they are.

    So a small input is shuffled once, texts included; what is computed of it does not change."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def dealt(rows: DataFrame, key: str, per_part: int = 10_000) -> DataFrame:
    """Short rows that much is made of, dealt out by their key in parts of about ``per_part``, whatever the files they come from: a small
    file of a few row groups is else read by as few tasks."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // per_part))
    return rows.repartition(parts, key)


def tidy(spark: SparkSession) -> None:
    """Let the driver's JVM collect its garbage and give back the heap that a burst of plans and tasks took, which it else keeps while
    the next one comes; call it between the phases of a long job. No result depends on it."""
    spark.sparkContext._jvm.System.gc()


def written(spark: SparkSession) -> int:
    """How many tables ``saved`` has written for this application and not yet deleted."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def discard(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables that ``saved`` wrote for this application after the first ``since``, but for the last ``keep``.

    Call it when their readers are done."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = _written.get(spark.sparkContext.applicationId, [])
    for path in paths[since : len(paths) - keep]:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    del paths[since : len(paths) - keep]
