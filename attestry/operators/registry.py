"""Registry mirror: ingestion behind a quality gate, snapshot log, differences, lookups."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import names as N
from ..session import small
from .matching import priority_first


@dataclass(frozen=True)
class Rules:
    """Gate of one connector: allowed change of the row count, columns that must be filled, allowed share of duplicates.

    By default only the row count decides; ``strict`` adds the other checks."""

    variance: float = 0.2
    required: tuple[str, ...] = ("external_id", "name")
    max_null_share: float = 0.05
    max_duplicate_share: float = 0.1
    strict: bool = False


@dataclass
class IngestReport:
    state: str
    row_count: int
    previous_count: int | None
    checks: list[dict] = field(default_factory=list)
    added: int = 0
    removed: int = 0
    changed: int = 0


def authority_of(code: Column) -> Column:
    """Authority of a connector code; codes that are authorities themselves stay; null for unknown ones."""
    known = sorted(set(D.CONNECTOR_AUTHORITIES.values()) | {"WIKIDATA", "WEBSITE", "MANUAL"})
    return F.coalesce(F.try_element_at(N.fixed_map(D.CONNECTOR_AUTHORITIES), code), F.when(F.upper(code).isin(known), F.upper(code)))


def first_wins(drafts: DataFrame, key: str = "external_id", order: str = "_pos") -> DataFrame:
    """Of rows with an equal key the first stays."""
    return priority_first(drafts, [key], [F.col(order)])


def to_entries(drafts: DataFrame, authority: str, snapshot_id: int) -> DataFrame:
    """Parsed rows as registry entries."""
    return drafts.select(
        F.xxhash64(F.lit(authority), F.lit(snapshot_id), "external_id").alias("id"),
        F.lit(authority).alias("authority_code"),
        F.lit(snapshot_id).cast("long").alias("snapshot_id"),
        "external_id",
        F.col("name").alias("canonical_name"),
        N.lookup_form(F.col("name")).alias("normalized_name"),
        N.registry_type(F.col("raw_data")).alias("type"),
        N.registry_status(F.col("raw_data")).alias("status"),
        F.col("raw_data").alias("attributes"),
    )


def content_hash(*cols: str) -> Column:
    """Hash of a set of rows that does not depend on their order and counts copies."""
    return F.sum(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]).cast("decimal(38,0)"))


def gate(row_count: Column, previous: Column, variance: float = 0.2) -> Column:
    """Pass if there is no previous snapshot or the count stays within the variance."""
    return previous.isNull() | row_count.between(previous * (1 - variance), previous * (1 + variance))


def gate_checks(counts: dict, previous: int | None, rules: Rules) -> list[dict]:
    """Checks of one snapshot: name, passed, message."""
    n = counts["n"]
    low, high = ((previous or 0) * (1 - rules.variance), (previous or 0) * (1 + rules.variance))
    checks = [{"name": "Row Count Variance", "passed": previous is None or low <= n <= high, "message": "first snapshot" if previous is None else f"{n} rows against {low:.0f}-{high:.0f}"}]
    if rules.strict:
        for column in rules.required:
            share = counts[f"null_{column}"] / max(1, n)
            checks.append({"name": f"Required {column}", "passed": share <= rules.max_null_share, "message": f"{share:.3f} empty"})
        share = 1 - n / max(1, counts["raw"])
        checks.append({"name": "Duplicates", "passed": share <= rules.max_duplicate_share, "message": f"{share:.3f} duplicates"})
        checks.append({"name": "Not empty", "passed": n > 0, "message": f"{n} rows"})
    return checks


def diff_snapshots(old: DataFrame, new: DataFrame, key: str = "external_id", compare: tuple[str, ...] = ("canonical_name", "status")) -> DataFrame:
    """Key by key what two snapshots differ in: (key, ``change``: added, removed or changed), from one full join."""
    digest = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in compare])
    a = old.groupBy(key).agg(F.min(digest).alias("_old"))
    b = new.groupBy(key).agg(F.min(digest).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).filter("change IS NOT NULL")


def latest_state(log: DataFrame) -> DataFrame:
    """Current state of each snapshot from the appended log."""
    return priority_first(log, ["id"], [F.desc("seq")])


def published_snapshots(log: DataFrame, all_published: bool = False) -> DataFrame:
    """Snapshots that serve lookups: per authority the latest published one, or all published ones."""
    live = latest_state(log).filter("state = 'published'")
    return live if all_published else priority_first(live, ["authority_code"], [F.desc("id")])


def published_entries(entries: DataFrame, log: DataFrame, all_published: bool = False) -> DataFrame:
    return entries.join(published_snapshots(log, all_published).select(F.col("id").alias("snapshot_id")), "snapshot_id", "left_semi")


def lookup(entries: DataFrame, name: str, codes: list[str] | None = None, limit: int = 100) -> DataFrame:
    """Entries whose normal form holds the text, whatever its case; ordered by authority and id."""
    cond = F.ilike(F.col("normalized_name"), F.lit(f"%{name}%"))
    if codes:
        cond = cond & F.col("authority_code").isin(codes)
    return entries.filter(cond).orderBy("authority_code", "external_id").limit(limit)


def lookup_external(entries: DataFrame, code: str, external_id: str) -> DataFrame:
    if code not in set(D.CONNECTOR_AUTHORITIES.values()):
        raise ValueError(f"unknown authority {code}")
    return entries.filter((F.col("authority_code") == code) & (F.col("external_id") == external_id)).orderBy("id").limit(1)


def with_authorities(rows: DataFrame, key: str, identities: DataFrame, authorities: DataFrame, code: str = "source") -> DataFrame:
    """Distinct rows with the authorities that know them: by identities, and what is told of each authority; rows without
    identities and codes without an authority stay."""
    links = identities.select(F.col("institution_id").alias(key), F.col(code).alias("authority_code")).distinct()
    return rows.join(links, key, "left").join(small(authorities), "authority_code", "left").distinct()


def rows_per_authority(entries: DataFrame) -> DataFrame:
    return entries.groupBy("authority_code").agg(F.count(F.lit(1)).alias("rows"))


class RegistryStore:
    """Immutable snapshots on Parquet, partitioned by authority and snapshot, and an appended log of their states."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str) -> DataFrame | None:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
            return None

    @property
    def log(self) -> DataFrame | None:
        return self._read("snapshots")

    @property
    def entries(self) -> DataFrame | None:
        return self._read("entries")

    def _mark(self, snapshot_id: int, authority: str, state: str, seq: int, rows: int | None, as_of) -> None:
        row = [(snapshot_id, authority, state, seq, rows, as_of)]
        self.spark.createDataFrame(row, "id LONG, authority_code STRING, state STRING, seq LONG, row_count LONG, created_at TIMESTAMP").coalesce(1).write.mode("append").parquet(f"{self.root}/snapshots")

    def _write(self, rows: DataFrame, authority: str, snapshot_id: int) -> None:
        """Replace the snapshot's own folder: what an earlier attempt left there goes, no other snapshot is touched."""
        rows.drop("authority_code", "snapshot_id").write.mode("overwrite").parquet(f"{self.root}/entries/authority_code={authority}/snapshot_id={snapshot_id}")

    def ingest(self, drafts: DataFrame, authority: str, snapshot_id: int, as_of, rules: Rules = Rules(), dry_run: bool = False, by_content: bool = False) -> IngestReport:
        """Parsed rows (with ``_pos``) to a published snapshot, or to a rejected or unchanged one.

        Rows without an external id or name are dropped, the first of equal external ids stays. A snapshot with the
        row count of the published one before it (or, ``by_content``, its content) is unchanged. A failed gate leaves the
        old snapshot serving. A failure marks the snapshot as failed before it is raised.
        A snapshot may be ingested again. If an attempt failed or was lost, its rows are replaced; if it had come to an
        end, its rows and log stay as they are, whatever the drafts, and the report is made anew.
        """
        log = self.log
        seen = [] if log is None else latest_state(log).filter(F.col("id") == snapshot_id).select("state", "seq").take(1)
        over = bool(seen) and seen[0]["state"] in ("published", "rejected", "unchanged")
        at = seen[0]["seq"] + 1 if seen else 0
        before = None if log is None else published_snapshots(log.filter(F.col("id") < snapshot_id)).filter(F.col("authority_code") == authority).select("id", "row_count").first()
        if not over:
            self._mark(snapshot_id, authority, "running", at, None, as_of)
        try:
            kept = first_wins(drafts.filter("trim(coalesce(external_id, '')) <> '' AND trim(coalesce(name, '')) <> ''"))
            rows = to_entries(kept, authority, snapshot_id)
            if not dry_run:
                if not over:
                    self._write(rows, authority, snapshot_id)
                rows = self.spark.read.schema(rows.schema).parquet(f"{self.root}/entries").filter((F.col("authority_code") == authority) & (F.col("snapshot_id") == snapshot_id))
            counted = rows.agg(F.count(F.lit(1)).alias("n"), content_hash("external_id", "canonical_name", "status").alias("digest"), *[F.count_if(F.coalesce(F.col({"name": "canonical_name"}.get(c, c)), F.lit("")) == "").alias(f"null_{c}") for c in rules.required]).first().asDict()
            counted["raw"] = drafts.count() if rules.strict else counted["n"]
            report = IngestReport("published", counted["n"], None if before is None else before["row_count"])
            report.checks = gate_checks(counted, report.previous_count, rules)
            entries = self.entries if before is not None else None
            old = None if entries is None else entries.filter((F.col("authority_code") == authority) & (F.col("snapshot_id") == before["id"]))
            same = report.previous_count == counted["n"]
            if by_content and same and old is not None:
                same = old.agg(content_hash("external_id", "canonical_name", "status")).first()[0] == counted["digest"]
            if before is not None and same:
                report.state = "unchanged"
            elif not all(c["passed"] for c in report.checks):
                report.state = "rejected"
            elif old is not None:
                changes = {r["change"]: r["n"] for r in diff_snapshots(old, rows).groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
                report.added, report.removed, report.changed = (changes.get(k, 0) for k in ("added", "removed", "changed"))
            else:
                report.added = counted["n"]
            if over:
                report.state = seen[0]["state"]
            else:
                self._mark(snapshot_id, authority, "dry_run" if dry_run else report.state, at + 1, counted["n"], as_of)
            return report
        except Exception:
            if not over:
                self._mark(snapshot_id, authority, "failed", at + 1, None, as_of)
            raise


def snapshot_states(log: DataFrame) -> DataFrame:
    """Each authority's snapshots in order with the state that holds and how the count moved."""
    w = Window.partitionBy("authority_code").orderBy("id")
    return latest_state(log).withColumn("previous_count", F.lag("row_count").over(w))
