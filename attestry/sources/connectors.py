"""Registry connectors over captured files: each reads raw rows and parses them into drafts of entries.

A draft has external_id, name, city, state, affiliated_university, website, email, phone_number, raw_data and ``_pos``,
the row's place in its source, by which the first of equal rows wins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators.registry import Rules
from . import html_tables as T

DRAFT = ["external_id", "name", "city", "state", "affiliated_university", "website", "email", "phone_number"]


def _clean(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def drafts(raw: DataFrame, fields: dict[str, Column], default_id: Column | None = None) -> DataFrame:
    """Raw rows as drafts: fields trimmed, empty ones null, unnamed rows dropped, the raw row kept as attributes."""
    residue = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in raw.columns if c != "_pos"]), lambda e: e["value"].isNotNull()))
    given = {**{f: F.lit(None).cast("string") for f in DRAFT}, **fields}
    if default_id is not None:
        given["external_id"] = F.coalesce(_clean(given["external_id"]), default_id)
    return raw.select(*[_clean(given[f]).alias(f) for f in DRAFT], residue.alias("raw_data"), "_pos").filter("name IS NOT NULL")


@dataclass(frozen=True)
class Connector:
    code: str
    display_name: str
    read: Callable[[SparkSession, str], DataFrame]
    parse: Callable[[DataFrame], DataFrame]
    rules: Rules


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Place of each row: the file's place in the listing order and the row's place in it, without a global sort."""
    return rows.withColumn("_pos", F.struct(*order))


def _html(columns: list[str], min_cells: int, name_from: str = "name") -> Callable[[SparkSession, str], DataFrame]:
    def read(spark: SparkSession, path: str) -> DataFrame:
        rows = T.table_rows(spark, path).filter((F.size("cells") >= min_cells) & T.is_number(F.get("cells", F.lit(0))))
        return _numbered(rows.select("file", "row", *[F.get("cells", F.lit(i + 1)).alias(c) for i, c in enumerate(columns)], F.get("links", F.lit(-1) + F.size("links")).alias("url")), ["file", "row"]).drop("file", "row")

    return read


def read_aicte(spark: SparkSession, path: str) -> DataFrame:
    """JSON files of arrays, one per state in a folder ``state=...``; positions become columns, bad files are skipped."""
    lines = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    state = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), "state=([^/]+)/", 1)
    rows = lines.select(state.alias("state"), F.posexplode(F.from_json("value", "array<array<string>>")).alias("_row", "r"))
    return rows.select(*[F.get("r", F.lit(i)).alias(n) for i, n in enumerate(_AICTE)], "state", F.struct("state", "_row").alias("_pos"))


#: Columns of an AICTE row by position.
_AICTE = ["aicteId", "name", "address", "district", "institutionType", "women", "minority", "pid"]


def aicte_drafts(pages: DataFrame) -> DataFrame:
    """Drafts from AICTE pages as the paged source reads them; pages that could not be read give none."""
    rows = pages.filter("error IS NULL")
    raw = rows.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(_AICTE)], "state", F.struct("state", "page", "row").alias("_pos"))
    return get_connector("aicte").parse(raw)


def read_depository(spark: SparkSession, path: str) -> DataFrame:
    """Depository tables whose state and institution cells span rows: carried forward, then grouped by institution."""
    rows = T.table_rows(spark, path).filter((F.size("cells") >= 3) & ~F.col("header"))
    w = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.select("file", "row", *[F.last(_clean(F.get("cells", F.lit(i))), ignorenulls=True).over(w).alias(c) for i, c in enumerate(["state", "name"])], _clean(F.get("cells", F.lit(2))).alias("kind"))
    grouped = carried.filter("name IS NOT NULL").groupBy("name", "state").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.min(F.struct("file", "row")).alias("_pos"))
    return grouped.select(F.concat_ws("-", F.lit("NAD"), N.slug(F.col("name"))).alias("externalId"), "name", "state", F.array_join("kinds", "; ").alias("documentTypes"), "_pos")


def read_pci(spark: SparkSession, path: str) -> DataFrame:
    """Tables of two layouts: with a number in the second cell, the name comes third. A dash is no value."""
    rows = T.table_rows(spark, path).filter((F.size("cells") >= 3) & ~F.rlike(F.lower(F.array_join("cells", " ")), F.lit("name of (the )?institution")))
    shift = F.when(T.is_number(F.get("cells", F.lit(1))), 1).otherwise(0)
    cell = lambda i: F.nullif(F.trim(F.get("cells", shift + i)), F.lit("-"))
    program = F.when(F.contains(F.lower("file"), F.lit("bpharm")), "B.Pharm").when(F.contains(F.lower("file"), F.lit("dpharm")), "D.Pharm").when(F.contains(F.lower("file"), F.lit("pharmd")), "Pharm.D").otherwise("Pharmacy")
    raw = rows.select(cell(1).alias("name"), cell(2).alias("state"), cell(3).alias("pciCode"), cell(4).alias("approvalInfo"), cell(5).alias("examinationAuthority"), program.alias("programType"), F.struct("file", "row").alias("_pos"))
    w = Window.partitionBy(F.lower("name"), F.lower("state")).orderBy("_pos")
    return raw.withColumn("_n", F.row_number().over(w)).filter("_n = 1 AND name IS NOT NULL").drop("_n")


def read_wiki(spark: SparkSession, path: str) -> DataFrame:
    """Encyclopaedia tables: footnotes stripped, two-, three- and four-column layouts, one row per name and state."""
    rows = T.table_rows(spark, path).filter((F.size("cells") >= 2) & (F.col("header") == F.lit(False)))
    cell = lambda i: _clean(F.regexp_replace(F.get("cells", F.lit(i)), r"\[[^\]]*\]", ""))
    wide = F.size("cells") >= 4
    raw = rows.select(cell(0).alias("name"), F.when(F.size("cells") >= 3, cell(1)).alias("city"), F.when(wide, cell(2)).when(F.size("cells") == 3, cell(2)).otherwise(cell(1)).alias("state"), F.when(wide, F.nullif(F.regexp_extract(cell(3), r"\d{4}", 0), F.lit(""))).alias("yearOfEstablishment"), F.struct("file", "row").alias("_pos"))
    w = Window.partitionBy("name", "state").orderBy("_pos")
    return raw.withColumn("_n", F.row_number().over(w)).filter("_n = 1 AND name IS NOT NULL").drop("_n")


def _parse(**fields: str) -> Callable[[DataFrame], DataFrame]:
    def parse(raw: DataFrame) -> DataFrame:
        have = {f: F.col(c) for f, c in fields.items() if c in raw.columns}
        fallback = N.external_slug(*[F.coalesce(F.col(c), F.lit("")) for c in ("name", "state") if c in raw.columns])
        return drafts(raw, have, fallback)

    return parse


def _before_comma(col: Column) -> Column:
    return F.trim(F.substring_index(col, ",", 1))


def parse_fake(raw: DataFrame) -> DataFrame:
    """The name ends at the first comma, the rest is the address; the status is fixed."""
    rest = F.trim(F.regexp_replace("name", "^[^,]*,?", ""))
    named = raw.withColumn("address", F.coalesce(F.nullif(rest, F.lit("")), F.col("address") if "address" in raw.columns else F.lit(None))).withColumn("name", _before_comma(F.col("name"))).withColumn("status", F.lit("Fake/Fraudulent"))
    return drafts(named, {"name": F.col("name"), "state": F.col("state")}, N.external_slug(F.lit("fake"), F.col("name"), F.coalesce("state", F.lit(""))))


CONNECTORS = {
    c.code: c
    for c in [
        Connector("aicte", "AICTE approved institutions", read_aicte, _parse(external_id="aicteId", name="name", state="state", city="district"), Rules(0.15)),
        Connector("ugc-recognized", "UGC recognised universities", _html(["name", "state", "type", "address", "zip", "status"], 3), _parse(external_id="externalId", name="name", state="state", website="url"), Rules(0.3)),
        Connector("ugc-colleges", "UGC colleges", _html(["name", "state", "address", "district", "affiliatedUniversity", "status", "yearEstablished", "teachingUpto", "govtOrNonGovt", "aiddedOrUnaided"], 3), _parse(external_id="externalId", name="name", state="state", city="district", affiliated_university="affiliatedUniversity"), Rules(0.3)),
        Connector("ugc-fake", "UGC fake universities", _html(["name", "state"], 3), parse_fake, Rules(0.3)),
        Connector("aishe-universities", "AISHE universities", _html(["aisheCode", "name", "state", "district", "website", "yearOfEstablishment", "location"], 3), _parse(external_id="aisheCode", name="name", state="state", city="district", website="website"), Rules(0.25)),
        Connector("aishe-colleges", "AISHE colleges", _html(["aisheCode", "name", "state", "district", "website"], 3), _parse(external_id="aisheCode", name="name", state="state", city="district", website="website"), Rules(0.25)),
        Connector("nmc", "NMC colleges", _html(["state", "name", "courseName", "universityName", "yearOfInception", "intake", "recognition", "remarks"], 9), lambda raw: _parse(name="name", state="state", affiliated_university="universityName")(raw.filter("trim(coalesce(name,'')) <> '' AND trim(coalesce(state,'')) <> ''")), Rules(0.15)),
        Connector("pci", "PCI institutions", read_pci, _parse(external_id="pciCode", name="name", state="state"), Rules(0.2)),
        Connector("ini", "Institutes of National Importance", read_wiki, _parse(name="name", state="state", city="city"), Rules(0.1)),
        Connector("digilocker", "National Academic Depository", read_depository, _parse(external_id="externalId", name="name", state="state"), Rules(0.15)),
    ]
}


def get_connector(code: str) -> Connector:
    if code not in CONNECTORS:
        raise ValueError(f"unknown connector {code}; known: {', '.join(sorted(CONNECTORS))}")
    return CONNECTORS[code]


def list_connectors() -> list[tuple[str, str]]:
    return [(c.code, c.display_name) for c in CONNECTORS.values()]


def load(spark: SparkSession, code: str, path: str) -> DataFrame:
    """Drafts from a connector's captured files."""
    c = get_connector(code)
    return c.parse(c.read(spark, path))


def load_or_last(spark: SparkSession, code: str, path: str, last: DataFrame) -> DataFrame:
    """Drafts from captured files, or, if there are none or they cannot be read, the drafts that were loaded last; ``stale`` tells."""
    from pyspark.errors import PySparkException

    try:
        fresh = load(spark, code, path)
        if not fresh.isEmpty():
            return fresh.withColumn("stale", F.lit(False))
    except PySparkException:
        pass  # told by ``stale``
    return last.withColumn("stale", F.lit(True))
