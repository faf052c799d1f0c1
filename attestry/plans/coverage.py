"""Further registered queries: registry ingestion, connectors, identities, batches, scalars, enrichment, with DuckDB twins.

Connectors read captured files, so their queries first write tables of the driver as such files into the shared folder.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import names as N
from ..functions import scalars as X
from ..functions import similarity as S
from ..functions import urls as U
from ..operators import analytics as A
from ..operators import batch as B
from ..operators import enrichment as R
from ..operators import evidence as E
from ..operators import identity as I
from ..operators import listing as L
from ..operators import matching as M
from ..operators import registry as G
from ..operators import scoring as P
from ..operators import structured as T
from ..session import shared_dir
from ..sources import connectors, uploads
from ..sources import html_tables as HT
from ..streaming import events as V
from .catalogue import _LINKS, _as_of, _links, _t, query
from .validate import discover, fast_path

NOW = dt.datetime(2024, 2, 1)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/attestry/files-{uuid.uuid4().hex}"


def _pick(values: list, key: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


# Registry ----------------------------------------------------------------------------------------------------


@query("""WITH n AS (SELECT count(*) AS a, count(*) FILTER (s_suppkey % 10 <> 0) AS b, count(*) FILTER (s_suppkey % 10 = 1) AS c FROM supplier)
SELECT * FROM (SELECT 1::BIGINT AS snapshot_id, 'published' AS state, b AS row_count, 0::BIGINT AS live, NULL::BIGINT AS previous FROM n UNION ALL SELECT 2, 'unchanged', b, 0, b FROM n
UNION ALL SELECT 3, 'rejected', c, 0, b FROM n UNION ALL SELECT 4, 'published', a, a, c FROM n)""")
def registry_ingest(spark, sf_dir):
    """Four ingestions of one authority: first, unchanged, far too few rows, all rows; what is live, and how counts moved."""
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("external_id"), F.col("s_name").alias("name"), F.create_map(F.lit("status"), F.lit("ok")).alias("raw_data"), F.col("s_suppkey").alias("_pos"))
    store = G.RegistryStore(spark, _folder(spark))
    for number, cond in enumerate(["_pos % 10 <> 0", "_pos % 10 <> 0", "_pos % 10 = 1", "true"], 1):
        store.ingest(rows.filter(cond), "UGC", number, NOW)
    live = G.published_entries(store.entries, store.log).groupBy(F.col("snapshot_id").alias("id")).agg(F.count(F.lit(1)).alias("live"))
    return G.snapshot_states(store.log).join(live, "id", "left").select(F.col("id").alias("snapshot_id"), "state", "row_count", F.coalesce("live", F.lit(0)).alias("live"), F.col("previous_count").alias("previous"))


@query("""WITH n AS (SELECT s_suppkey, s_name, s_suppkey % 11 <> 1 AS first FROM supplier)
SELECT 'UGC' AS authority_code, 2::BIGINT AS snapshot_id, s_suppkey::VARCHAR AS external_id, s_name AS canonical_name, count(*) OVER () AS row_count, (SELECT count(*) FROM n WHERE NOT first) AS added, 0::BIGINT AS removed, 3 AS marks FROM n""")
def registry_retry(spark, sf_dir):
    """Two snapshots, each ingested twice; the second one's first attempt is lost after it has written half of its rows."""
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("external_id"), F.col("s_name").alias("name"), F.create_map(F.lit("status"), F.lit("ok")).alias("raw_data"), F.col("s_suppkey").alias("_pos"))
    store = G.RegistryStore(spark, _folder(spark))
    for _ in range(2):
        store.ingest(rows.filter("_pos % 11 <> 1"), "UGC", 1, NOW)
    store._mark(2, "UGC", "running", 0, None, NOW)
    store._write(G.to_entries(rows.filter("_pos % 2 = 0"), "UGC", 2), "UGC", 2)
    reports = [store.ingest(rows, "UGC", 2, NOW) for _ in range(2)]
    added, removed = {(r.added, r.removed) for r in reports}.pop()
    marks = store.log.filter("id = 2").count()
    live = G.published_entries(store.entries, store.log)
    count = F.lit(reports[1].row_count).cast("long").alias("row_count")
    return live.select("authority_code", F.col("snapshot_id").cast("long").alias("snapshot_id"), "external_id", "canonical_name", count, F.lit(added).cast("long").alias("added"), F.lit(removed).cast("long").alias("removed"), F.lit(marks).alias("marks"))



def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as registry entries of four authorities, with attributes."""
    key = F.col("s_suppkey")
    attributes = F.map_filter(
        F.create_map(F.lit("website"), F.when(key % 3 == 0, F.concat(F.lit("https://s"), key, F.lit(".ac.in"))), F.lit("contact_email"), F.when(key % 4 == 0, F.concat(F.lit("e"), key, F.lit("@s.in"))), F.lit("phone"), F.when(key % 5 == 0, F.concat(F.lit("98"), key)), F.lit("state"), F.lit("goa")),
        lambda k, v: v.isNotNull(),
    )
    return _t(spark, sf_dir, "supplier").select(key.cast("long").alias("id"), _pick(["UGC", "AISHE", "AICTE", "UGC_FAKE"], key).alias("authority_code"), key.cast("string").alias("external_id"), F.col("s_name").alias("canonical_name"), N.lookup_form(F.concat(F.lit("name "), key % 20)).alias("normalized_name"), F.lit("Central University").alias("type"), F.lit("ok").alias("status"), attributes.alias("attributes"))


_ENTRIES = """e AS (SELECT s_suppkey::BIGINT AS id, ['UGC', 'AISHE', 'AICTE', 'UGC_FAKE'][s_suppkey % 4 + 1] AS authority_code, s_suppkey::VARCHAR AS external_id, s_name AS canonical_name, 'name ' || (s_suppkey % 20) AS normalized_name,
CASE WHEN s_suppkey % 3 = 0 THEN 'https://s' || s_suppkey || '.ac.in' END AS website, CASE WHEN s_suppkey % 4 = 0 THEN 'e' || s_suppkey || '@s.in' END AS email, CASE WHEN s_suppkey % 5 = 0 THEN '98' || s_suppkey END AS phone FROM supplier)"""


@query(f"WITH {_ENTRIES} SELECT id, canonical_name FROM e WHERE authority_code = 'AISHE' AND external_id = '5'")
def registry_lookup_external(spark, sf_dir):
    return G.lookup_external(_entries(spark, sf_dir), "AISHE", "5").select("id", "canonical_name")


@query("""WITH codes AS (SELECT unnest(['UGC', 'AISHE', 'NMC', 'PCI']) AS code), links AS (SELECT ['UGC', 'AICTE'][s_suppkey % 2 + 1] AS code, count(*) AS n FROM supplier GROUP BY 1),
snaps AS (SELECT ['UGC', 'AISHE', 'INI'][p_partkey % 3 + 1] AS code, max(p_partkey) AS id FROM part GROUP BY 1)
SELECT code, CASE WHEN l.code IS NOT NULL THEN 'identity' WHEN s.code IS NOT NULL THEN 'snapshot' ELSE 'code' END AS known_by, coalesce(l.n, s.id) AS fact FROM codes LEFT JOIN links l USING (code) LEFT JOIN snaps s USING (code)""")
def authority_fallback(spark, sf_dir):
    """What is known of an authority: by identities, else by its latest snapshot, else its code alone."""
    asked = spark.createDataFrame([("UGC",), ("AISHE",), ("NMC",), ("PCI",)], "code string")
    links = _t(spark, sf_dir, "supplier").groupBy(_pick(["UGC", "AICTE"], F.col("s_suppkey")).alias("code")).agg(F.count(F.lit(1)).alias("fact"))
    snaps = _t(spark, sf_dir, "part").groupBy(_pick(["UGC", "AISHE", "INI"], F.col("p_partkey")).alias("code")).agg(F.max("p_partkey").alias("fact"))
    return R.first_known(asked, "code", [("identity", links), ("snapshot", snaps)], "code").select("code", "known_by", "fact")


# Connectors --------------------------------------------------------------------------------------------------


#: Rows of a captured page.
PAGE_ROWS = 400


def _capture(rows: DataFrame, cells: list, link: Column | None = None, by: Column | None = None, path: str | None = None, order: str = "k", page: Column | None = None) -> str:
    """Rows as captured HTML tables, a page for each group ``by`` and stretch of the order, each in a file of its own."""
    tags = [F.concat(F.lit("<td> "), F.coalesce(c.cast("string"), F.lit("")), F.lit(" </td>")) for c in cells]
    if link is not None:
        tags.append(F.concat(F.lit('<td><a href="'), link, F.lit('">site</a></td>')))
    tr = F.concat(F.lit("<tr>"), *tags, F.lit("</tr>"))
    return _pages(rows, tr, [by if by is not None else F.lit(0), page if page is not None else F.floor(F.col(order) / PAGE_ROWS)], path, order, "<tr><th>No</th><th>Name</th></tr>")


def _pages(rows: DataFrame, tr: Column, keys: list[Column], path: str | None, order: str, head: str) -> str:
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), tr.alias("tr"))))
    pages = rows.groupBy(*[k.alias(f"page{i}") for i, k in enumerate(keys)]).agg(F.array_join(F.transform(listed, lambda x: x["tr"]), "").alias("trs"))
    path = path or f"{_folder(rows.sparkSession)}/page"
    pages.select(F.concat(F.lit(f"<table>{head}"), "trs", F.lit("</table>"))).write.option("maxRecordsPerFile", 1).text(path)
    return path


def _k() -> Column:
    return F.col("s_suppkey")


def _name() -> Column:
    return F.concat_ws(" ", F.lit("College"), F.col("s_name"))


_SLUG = "regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
_COLLEGE = "'College ' || s_name"
_STATES = ["Goa", "Kerala", "Tamil Nadu"]
_STATE = "['Goa', 'Kerala', 'Tamil Nadu'][s_suppkey % 3 + 1]"


def _suppliers(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey"))


def _draft(df: DataFrame) -> DataFrame:
    return df.select("external_id", "name", "city", "state", "affiliated_university", "website")


def _drafted(external: str, name: str = _COLLEGE, city: str = "NULL::VARCHAR", state: str = _STATE, university: str = "NULL::VARCHAR", website: str = "NULL::VARCHAR", where: str = "true") -> str:
    return f"SELECT {external} AS external_id, {name} AS name, {city} AS city, {state} AS state, {university} AS affiliated_university, {website} AS website FROM supplier WHERE {where}"


@query(_drafted(_SLUG.format(x=f"{_COLLEGE} || '-' || {_STATE}"), website="'https://u' || s_suppkey || '.ac.in'"))
def connector_ugc_recognized(spark, sf_dir):
    path = _capture(_suppliers(spark, sf_dir), [_k(), _name(), _pick(_STATES, _k()), F.lit("State"), F.lit("Road 1"), F.lit("403001"), F.lit("ok")], F.concat(F.lit("https://u"), _k(), F.lit(".ac.in")), _k() % 3)
    return _draft(connectors.load(spark, "ugc-recognized", path))


@query(_drafted(_SLUG.format(x=f"{_COLLEGE} || '-' || {_STATE}"), city="'District ' || s_nationkey", university="'University ' || s_nationkey"))
def connector_ugc_colleges(spark, sf_dir):
    cells = [_k(), _name(), _pick(_STATES, _k()), F.lit("Road"), F.concat(F.lit("District "), "s_nationkey"), F.concat(F.lit("University "), "s_nationkey"), F.lit("ok"), F.lit("1950"), F.lit("PG"), F.lit("Govt"), F.lit("Aided")]
    return _draft(connectors.load(spark, "ugc-colleges", _capture(_suppliers(spark, sf_dir), cells)))


@query(_drafted(_SLUG.format(x=f"'fake-' || {_COLLEGE} || '-' || {_STATE}")))
def connector_ugc_fake(spark, sf_dir):
    path = _capture(_suppliers(spark, sf_dir), [_k(), F.concat(_name(), F.lit(", Road 7, Town")), _pick(_STATES, _k())])
    return _draft(connectors.load(spark, "ugc-fake", path))


@query(_drafted("'U-' || s_suppkey", city="'D' || s_nationkey", website="'https://a.in/' || s_suppkey"))
def connector_aishe_universities(spark, sf_dir):
    cells = [_k(), F.concat(F.lit("U-"), _k()), _name(), _pick(_STATES, _k()), F.concat(F.lit("D"), "s_nationkey"), F.concat(F.lit("https://a.in/"), _k()), F.lit("1990"), F.lit("Urban")]
    return _draft(connectors.load(spark, "aishe-universities", _capture(_suppliers(spark, sf_dir), cells, by=_k() % 4)))


@query(_drafted("'C-' || s_suppkey", city="'D' || s_nationkey"))
def connector_aishe_colleges(spark, sf_dir):
    cells = [_k(), F.concat(F.lit("C-"), _k()), _name(), _pick(_STATES, _k()), F.concat(F.lit("D"), "s_nationkey"), F.lit("")]
    return _draft(connectors.load(spark, "aishe-colleges", _capture(_suppliers(spark, sf_dir), cells, by=_k() % 4)))


@query(_drafted(_SLUG.format(x=f"{_COLLEGE} || '-' || {_STATE}"), university="'University ' || s_nationkey", where="s_suppkey % 7 <> 0"))
def connector_nmc(spark, sf_dir):
    cells = [_k(), _pick(_STATES, _k()), F.when(_k() % 7 != 0, _name()), F.lit("MBBS"), F.concat(F.lit("University "), "s_nationkey"), F.lit("1990"), F.lit("150"), F.lit("yes"), F.lit("-")]
    return _draft(connectors.load(spark, "nmc", _capture(_suppliers(spark, sf_dir), cells)))


@query(_drafted("coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN 'P-' || s_suppkey END, " + _SLUG.format(x=f"{_COLLEGE} || '-' || {_STATE}") + ")"))
def connector_pci(spark, sf_dir):
    """Tables of both layouts, and each row twice, of which the first counts."""
    rows = _suppliers(spark, sf_dir)
    code = F.when(_k() % 3 != 0, F.concat(F.lit("P-"), _k())).otherwise("-")
    path = _folder(spark)
    for name, cells in (("bpharm", [_k(), _name(), _pick(_STATES, _k()), code, F.lit("-"), F.lit("Board")]), ("dpharm", [_k(), _k(), _name(), _pick(_STATES, _k()), code, F.lit("2020"), F.lit("Board")])):
        _capture(rows, cells, path=f"{path}/{name}")
    return _draft(connectors.load(spark, "pci", path))


@query(_drafted(_SLUG.format(x=f"{_COLLEGE} || '-' || {_STATE}"), city="'City ' || s_nationkey"))
def connector_ini(spark, sf_dir):
    cells = [F.concat(_name(), F.lit("[1]")), F.concat(F.lit("City "), "s_nationkey"), _pick(_STATES, _k()), F.lit("Act of 1961[2]")]
    return _draft(connectors.load(spark, "ini", _capture(_suppliers(spark, sf_dir), cells)))


@query("SELECT 'A-' || s_suppkey AS external_id, 'College ' || s_name AS name, 'District ' || s_nationkey AS city, ['Goa', 'Kerala', 'Tamil Nadu'][s_suppkey % 3 + 1] AS state, NULL::VARCHAR AS affiliated_university, NULL::VARCHAR AS website FROM supplier")
def connector_aicte(spark, sf_dir):
    row = F.to_json(F.array(F.concat(F.lit("A-"), _k()), _name(), F.lit("Road"), F.concat(F.lit("District "), "s_nationkey"), F.lit("Govt"), F.lit("N"), F.lit("N"), F.lit("1")))
    path = _folder(spark)
    pages = _suppliers(spark, sf_dir).groupBy(_pick(_STATES, _k()).alias("state")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(row), ","), F.lit("]")).alias("value"))
    pages.write.partitionBy("state").text(path)
    spark.createDataFrame([("broken [", "Goa")], "value string, state string").write.mode("append").partitionBy("state").text(path)
    return _draft(connectors.load(spark, "aicte", path))


@query("""SELECT 'NAD-' || regexp_replace(lower('College ' || n_name), '\\s+', '-', 'g') AS external_id, 'College ' || n_name AS name, r_name AS state, 'Degree; Diploma' AS kinds FROM nation JOIN region ON n_regionkey = r_regionkey""")
def connector_digilocker(spark, sf_dir):
    """Cells that span rows: the state is told once a region, the institution once, its documents line by line."""
    rows = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_regionkey", "n_nationkey", "n_name", "r_name", F.explode(F.array(F.lit("Diploma"), F.lit("Degree"))).alias("kind"))
    rows = rows.withColumn("k", F.struct("n_nationkey", F.when(F.col("kind") == "Diploma", 0).otherwise(1)))
    lowest = rows.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("lowest"))
    first = F.col("kind") == "Diploma"
    path = _capture(rows.join(lowest, "n_regionkey"), [F.when(first & (F.col("n_nationkey") == F.col("lowest")), F.col("r_name")), F.when(first, F.concat(F.lit("College "), "n_name")), F.col("kind")], by=F.col("n_regionkey"), page=F.lit(0))
    return connectors.load(spark, "digilocker", path).select("external_id", "name", "state", F.col("raw_data")["documentTypes"].alias("kinds"))


def _spanning_tables(spark, sf_dir) -> str:
    """Suppliers by nation in tables where region and nation span all rows, half of the names two columns, and every third row holds
    a table of the supplier's balance; a footer spans three columns. A nation's suppliers go on pages of up to 400 keys."""
    rows = _suppliers(spark, sf_dir).join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.withColumn("p", F.floor(_k() / PAGE_ROWS))
    sizes = rows.groupBy("s_nationkey", "p").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(sizes, ["s_nationkey", "p"])
    span = lambda c: F.concat(F.lit('<td rowspan="'), F.col("n"), F.lit('">'), c, F.lit("</td>"))
    lead = F.when(F.col("k") == F.col("first"), F.concat(span(F.col("r_name")), span(F.concat(F.lit("&quot;"), "n_name", F.lit("&quot;"))))).otherwise("")
    inner = F.when(_k() % 3 == 0, F.concat(F.lit("note<table><tr><td>key<td>"), _k(), F.lit("</table>"))).otherwise("plain")
    named = F.when(_k() % 2 == 0, F.concat(F.lit("<td colspan=2><b>"), _name(), F.lit("</b></td>"))).otherwise(F.concat(F.lit("<td>"), _name(), F.lit("</td><td>odd</td>")))
    foot = F.when(F.col("k") == F.col("last"), F.concat(F.lit("<tbody><tr><td colspan='3'>Total</td><td>"), F.col("n"), F.lit("</td><td></td></tr></tbody>"))).otherwise("")
    tr = F.concat(F.lit("<tr>"), lead, named, F.lit("<td>"), inner, F.lit("</td></tr>"), foot)
    return _pages(rows, tr, [F.col("s_nationkey"), F.col("p")], None, "k", "")


@query("""WITH s AS (SELECT s_suppkey, 'College ' || s_name AS name, n_name, r_name, row_number() OVER w - 1 AS i, row_number() OVER (PARTITION BY s_nationkey, s_suppkey // 400, s_suppkey % 3 ORDER BY s_suppkey) AS j, count(*) OVER (PARTITION BY s_nationkey, s_suppkey // 400) AS n
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WINDOW w AS (PARTITION BY s_nationkey, s_suppkey // 400 ORDER BY s_suppkey))
SELECT '"' || n_name || '"' AS nation, 0 AS table_no, NULL AS parent, i::INT AS row, r_name || '|"' || n_name || '"|' || name || '|' || CASE WHEN s_suppkey % 2 = 0 THEN name ELSE 'odd' END || '|' || CASE WHEN s_suppkey % 3 = 0 THEN 'note' ELSE 'plain' END AS cells,
    CASE WHEN i > 0 THEN 2 ELSE 0 END + (s_suppkey % 2 = 0)::INT AS spanned FROM s
UNION ALL SELECT NULL, j::INT, '0:' || i, 0, 'key|' || s_suppkey, 0 FROM s WHERE s_suppkey % 3 = 0
UNION ALL SELECT 'Total', 0, NULL, n::INT, 'Total|Total|Total|' || n || '|', 2 FROM s WHERE i = n - 1""")
def table_spans(spark, sf_dir):
    """Captured tables with cells that span rows and columns, groups of rows, and nested tables, laid out in full."""
    rows = HT.expand_tables(spark.read.text(_spanning_tables(spark, sf_dir), wholetext=True), "value")
    spanned = F.size(F.filter("spanned", lambda x: x))
    return rows.select(F.when(F.col("parent").isNull(), F.get("cells", F.lit(1))).alias("nation"), "table_no", "parent", "row", F.array_join("cells", "|").alias("cells"), spanned.alias("spanned"))


@query("SELECT 'NAD-' || lower(regexp_replace(n_name, '\\s+', '-', 'g')) AS external_id, n_name AS name, r_name AS state, string_agg('Degree ' || s_suppkey, '; ' ORDER BY 'Degree ' || s_suppkey) AS kinds FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def connector_depository_spans(spark, sf_dir):
    """The depository's own layout: state and institution span the rows of their documents."""
    rows = _suppliers(spark, sf_dir).join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("p", F.floor(_k() / PAGE_ROWS))
    sizes = rows.groupBy("s_nationkey", "p").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(sizes, ["s_nationkey", "p"])
    span = lambda c: F.concat(F.lit("<td rowspan="), F.col("n"), F.lit(">"), c, F.lit("</td>"))
    tr = F.concat(F.lit("<tr>"), F.when(F.col("k") == F.col("first"), F.concat(span(F.col("r_name")), span(F.col("n_name")))).otherwise(""), F.lit("<td>Degree "), _k(), F.lit("</td></tr>"))
    path = _pages(rows, tr, [F.col("s_nationkey"), F.col("p")], None, "k", "<tr><th>State</th><th>Institute Name</th><th>Document Type</th></tr>")
    return connectors.load(spark, "digilocker", path).select("external_id", "name", "state", F.col("raw_data")["documentTypes"].alias("kinds"))


_CODES = [*sorted(connectors.CONNECTORS), "nowhere", "aishe"]
_AUTHORITIES = sorted(set(D.CONNECTOR_AUTHORITIES.values()) | {"WIKIDATA", "WEBSITE", "MANUAL"})
_CODE_FACTS = ", ".join(f"('{c}', {repr(dict(connectors.list_connectors()).get(c)) if c in connectors.CONNECTORS else 'NULL'}, {repr(a) if (a := D.CONNECTOR_AUTHORITIES.get(c, c.upper() if c.upper() in _AUTHORITIES else None)) else 'NULL'})" for c in _CODES)


@query(f"SELECT c_custkey, code, display_name, authority FROM (SELECT c_custkey, {_CODES}[c_custkey % {len(_CODES)} + 1] AS code FROM customer) JOIN (VALUES {_CODE_FACTS}) v(code, display_name, authority) USING (code)")
def connector_codes(spark, sf_dir):
    """Codes that rows name, with their connector and authority; unknown ones have none."""
    known = spark.createDataFrame(connectors.list_connectors(), "code string, display_name string")
    rows = _t(spark, sf_dir, "customer").select("c_custkey", _pick(_CODES, F.col("c_custkey")).alias("code"))
    return rows.join(F.broadcast(known), "code", "left").select("c_custkey", "code", "display_name", G.authority_of(F.col("code")).alias("authority"))


@query("""WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN '' WHEN c_custkey % 50 = 1 THEN repeat('x', 600) ELSE c_name END AS name, row_number() OVER (ORDER BY c_custkey) + 1 AS row_no FROM customer)
SELECT row_no, CASE WHEN name = '' THEN NULL ELSE name END AS institution_name, CASE WHEN name = '' THEN 'institution_name is required' WHEN length(name) > 512 THEN 'institution_name is longer than 512 characters' END AS error FROM r""")
def csv_upload(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 6 == 0, "").when(F.col("c_custkey") % 50 == 1, F.repeat(F.lit("x"), 600)).otherwise(F.col("c_name"))
    path = _folder(spark)
    _t(spark, sf_dir, "customer").orderBy("c_custkey").select(name.alias("institution_name"), F.lit("Goa").alias("state")).coalesce(1).write.csv(path, header=True, emptyValue="")
    good, bad = uploads.read_upload(spark, path)
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad).select("row_no", F.nullif("institution_name", F.lit("")).alias("institution_name"), "error")


@query("""SELECT l_orderkey * 8 + l_linenumber AS row_no, 'order ' || l_orderkey AS input_name, 'done' AS status, o_orderstatus AS verdict, round(o_totalprice, 2)::VARCHAR AS confidence FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderkey % 5 <> 0""")
def batch_results(spark, sf_dir):
    """Results of a batch written as CSV and read again."""
    items = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_no"), F.concat(F.lit("order "), "l_orderkey").alias("input_name"), F.lit("done").alias("state"), F.col("l_orderkey").alias("run_id"))
    runs = _t(spark, sf_dir, "orders").filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("verdict"), F.round("o_totalprice", 2).alias("confidence"))
    path = _folder(spark)
    uploads.write_results(B.results(items, runs), path)
    back = spark.read.csv(path, header=True)
    return back.select(F.col("row_no").cast("long").alias("row_no"), "input_name", "status", "verdict", F.col("confidence").cast("double").cast("string").alias("confidence"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_custkey) AS row_no, ((row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1) // 100)::INT AS chunk FROM customer")
def batch_numbered(spark, sf_dir):
    return B.numbered(_t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment", "c_custkey"], 100).select("c_custkey", "row_no", "chunk")


def _nation_policies(spark, sf_dir) -> DataFrame:
    """A policy for each nation, by the default of engineering: its region is the institution type, and some are not active."""
    one = P.default_policies(spark).filter("id = 'engineering'").drop("id", "institution_type", "version", "active", "threshold_genuine")
    key = F.col("n_nationkey")
    own = _t(spark, sf_dir, "nation").select(F.concat(F.lit("p"), key).alias("id"), F.concat(F.lit("region "), "n_regionkey").alias("institution_type"), (key % 4).cast("int").alias("version"), (key % 7 != 0).alias("active"), (F.lit(0.8) + key / 250.0).alias("threshold_genuine"))
    return own.crossJoin(F.broadcast(one)).select(*P.default_policies(spark).columns)


@query("""SELECT 'p' || n_nationkey AS id, (n_nationkey % 4)::BIGINT AS version, round(0.8 + n_nationkey / 250.0, 6)::DOUBLE AS threshold_genuine, 2.5::DOUBLE AS expected_max FROM nation WHERE n_nationkey % 7 <> 0
QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey % 4 DESC, 'p' || n_nationkey) = 1""")
def stored_policies(spark, sf_dir):
    """Policies of nations, written as a stored table and read under its schema; of each region the active one of the highest version."""
    root = _folder(spark)
    _nation_policies(spark, sf_dir).write.parquet(f"{root}/policies")
    return P.active_policies(uploads.read_table(spark, root, "policies")).select("id", F.col("version").cast("long").alias("version"), F.round("threshold_genuine", 6).alias("threshold_genuine"), "expected_max")


@query("SELECT s_suppkey AS id, s_nationkey::BIGINT AS institution_id, 'UGC' AS source, s_suppkey::VARCHAR AS external_id, s_name AS name_as_source, 0::BIGINT AS contacts FROM supplier")
def stored_tables(spark, sf_dir):
    """All stored tables created empty in a database of their own, and one filled: rows go through its schema."""
    root = _folder(spark)
    database = f"attestry_{uuid.uuid4().hex}"
    uploads.create_tables(spark, database, root)
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("institution_id"), F.lit("UGC").alias("source"), F.col("s_suppkey").cast("string").alias("external_id"), F.col("s_name").alias("name_as_source"))
    target = spark.table(f"{database}.institution_identities")
    rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema]).write.mode("append").insertInto(f"{database}.institution_identities")
    contacts = F.lit(spark.table(f"{database}.institution_contacts").count()).cast("long").alias("contacts")
    return spark.table(f"{database}.institution_identities").select("id", "institution_id", "source", "external_id", "name_as_source", contacts)


@query("""WITH p AS (SELECT n_nationkey AS id, 0.85 - n_nationkey / 50.0 AS g, n_nationkey / 12.0 AS m, (n_nationkey % 4) * 100.0 - 100 AS h FROM nation)
SELECT id, array_to_string(list_filter([CASE WHEN m < 0 OR m > 1 THEN 'weight_mirror' END, CASE WHEN g <= 0.7 THEN 'threshold_genuine' END, CASE WHEN h <= 0 THEN 'evidence_half_life_days' END], lambda x: x IS NOT NULL), ',') AS wrong FROM p""")
def policy_checks(spark, sf_dir):
    """Which fields of a policy are wrong."""
    one = P.default_policies(spark).filter("id = 'engineering'").drop("id", "weight_mirror", "threshold_genuine", "evidence_half_life_days")
    key = F.col("n_nationkey")
    rows = _t(spark, sf_dir, "nation").select(key.alias("id"), (key / 12.0).alias("weight_mirror"), (F.lit(0.85) - key / 50.0).alias("threshold_genuine"), ((key % 4) * 100.0 - 100).alias("evidence_half_life_days")).crossJoin(F.broadcast(one))
    return rows.select("id", F.array_join(F.transform(P.policy_errors(), lambda e: F.element_at(F.split(e, " "), 1)), ",").alias("wrong"))


@query("SELECT n_nationkey::VARCHAR AS key, CASE WHEN n_nationkey % 3 = 0 THEN 7 ELSE n_regionkey END::INT AS value FROM nation")
def flag_upsert(spark, sf_dir):
    """Flags set anew for a third of the keys."""
    flags = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_regionkey").cast("int").alias("value"))
    return I.upsert(flags, flags.filter("cast(key AS int) % 3 = 0").withColumn("value", F.lit(7)), ["key"])


# Identities --------------------------------------------------------------------------------------------------


@query(f"WITH {_LINKS}, o AS (SELECT * FROM l WHERE id % 2 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY institution_id, source, external_id ORDER BY id) AS k FROM l WHERE id % 3 = 0) SELECT id, institution_id, source, external_id FROM n WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.institution_id = n.institution_id AND o.source = n.source AND o.external_id = n.external_id)")
def identity_insert_ignore(spark, sf_dir):
    links = _links(spark, sf_dir)
    return I.insert_ignore(links.filter("id % 2 = 0"), links.filter("id % 3 = 0"), I.KEY, "id").select("id", "institution_id", "source", "external_id")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 <> 0 THEN 'new ' || s_suppkey ELSE s_name END AS name, s_nationkey AS nation FROM supplier")
def identity_update_filled(spark, sf_dir):
    """Filled fields of new rows replace old ones; every fourth comes empty."""
    old = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    new = old.filter("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "").otherwise(F.concat(F.lit("new "), "id")).alias("name"))
    return I.update_filled(old, new, "id", ["name"])


@query(f"WITH {_LINKS} SELECT n_nationkey::BIGINT AS id, n_name AS canonical_name, l.name_as_source AS alias, l.source FROM nation LEFT JOIN l ON n_nationkey = institution_id AND l.id <> 7")
def identity_alias_view(spark, sf_dir):
    """The alias view after one identity was unlinked."""
    inst = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("canonical_name"))
    links = I.unlink(_links(spark, sf_dir), 7).withColumn("normalized_name", F.lower("name_as_source"))
    return I.alias_view(inst, links).select("id", "canonical_name", "alias", "source")


@query(f"WITH {_LINKS} SELECT id, source, 'all' AS asked FROM l WHERE institution_id = 3 UNION ALL SELECT id, source, 'UGC' FROM l WHERE institution_id = 3 AND source = 'UGC' UNION ALL (SELECT institution_id, 'UGC', 'by identity' FROM l WHERE source = 'UGC' AND external_id = '5' ORDER BY 1 LIMIT 1)")
def identity_lookups(spark, sf_dir):
    links = _links(spark, sf_dir).withColumn("created_at", _as_of())
    pick = lambda df, asked: df.select("id", "source", F.lit(asked).alias("asked"))
    one = I.by_identity(links, "UGC", "5").select(F.col("institution_id").alias("id"), F.lit("UGC").alias("source"), F.lit("by identity").alias("asked"))
    return pick(I.identities_of(links, 3), "all").union(pick(I.identities_of(links, 3, "UGC"), "UGC")).union(one)


@query(f"WITH {_LINKS} SELECT institution_id AS run_id, source, string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR) AS ids FROM l GROUP BY ALL")
def identities_by_source(spark, sf_dir):
    links = _links(spark, sf_dir).select(F.col("institution_id").alias("run_id"), "source", F.col("id").cast("string").alias("id"))
    return E.group_lists(links, "source").select("run_id", "source", F.array_join("ids", ",").alias("ids"))


# Lookups in knowledge bases ----------------------------------------------------------------------------------


@query("WITH i AS (SELECT n_name AS name, s_suppkey AS item, ['university', 'river', 'college'][s_suppkey % 3 + 1] AS type, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 1) SELECT name, item, type FROM i WHERE n <= 2")
def knowledge_items(spark, sf_dir):
    names = _t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    items = _t(spark, sf_dir, "supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("name").alias("label"), F.col("s_suppkey").alias("item"), _pick(["university", "river", "college"], _k()).alias("type"))
    return R.knowledge_lookup(names.select("name"), items, ["university", "college"], 2).select("name", "item", "type")


@query("SELECT n_name AS name, arg_min('about ' || s_name, s_suppkey) AS description, arg_min(substr(repeat(s_name || ' ', 20), 1, 200), s_suppkey) AS extract FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
def knowledge_summaries(spark, sf_dir):
    names = _t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    articles = _t(spark, sf_dir, "supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("name").alias("title"), F.col("s_suppkey").alias("pos"), F.concat(F.lit("about "), "s_name").alias("description"), F.repeat(F.concat("s_name", F.lit(" ")), 20).alias("extract"))
    return R.summary_lookup(names.select("name"), articles)


@query("SELECT 'College ' || n_name AS name, sum(3 * l_quantity)::BIGINT AS total_documents, string_agg(DISTINCT year(l_shipdate)::VARCHAR, ',' ORDER BY year(l_shipdate)::VARCHAR) AS years, 'Degree,Diploma' AS kinds FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def depository_totals(spark, sf_dir):
    """Documents by kind and year, kept as nested maps: degrees, and twice as many diplomas."""
    rows = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    by_year = rows.groupBy(F.concat(F.lit("College "), "n_name").alias("name"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").cast("long").alias("n"))
    maps = by_year.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("year", "n"))).alias("m"))
    nested = maps.select("name", F.create_map(F.lit("Degree"), F.col("m"), F.lit("Diploma"), F.transform_values("m", lambda k, v: v * 2)).alias("year_data"))
    out = R.depository_documents(nested)
    return out.select("name", "total_documents", F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"), F.array_join("kinds", ",").alias("kinds"))


# Names and addresses -----------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey, ['Café ', 'ÉCOLE ', 'plain ', 'Señor '][p_partkey % 4 + 1] || p_name || ' (' || p_brand || ')' AS raw FROM part)
SELECT p_partkey, strip_accents(raw) AS plain, lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) AS lookup, regexp_replace(lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))), '[^a-z0-9_\\s]', '', 'g') AS scraped,
CASE WHEN p_partkey % 3 = 0 THEN 'mumbai' END AS city, p_partkey % 2 = 0 AS has_short, CASE WHEN p_partkey % 2 = 0 THEN 'Indian Institute of Technology' END AS long_form, CASE WHEN p_partkey % 5 = 0 THEN 'TIFR' END AS short_form FROM p""")
def name_forms(spark, sf_dir):
    key = F.col("p_partkey")
    raw = F.concat(_pick(["Café ", "ÉCOLE ", "plain ", "Señor "], key), "p_name", F.lit(" ("), "p_brand", F.lit(")"))
    town = F.concat("p_name", F.when(key % 3 == 0, " mumbai").otherwise(" nowhere"))
    short = F.when(key % 2 == 0, "iit").otherwise("zzz")
    long = F.when(key % 5 == 0, "tata institute of fundamental research").otherwise("none such")
    return _t(spark, sf_dir, "part").select("p_partkey", N.unaccent(raw).alias("plain"), N.lookup_form(raw).alias("lookup"), N.scraper_form(raw).alias("scraped"), N.city_of(N.tokens(town)).alias("city"), N.has_short_forms(F.concat_ws(" ", short, "p_name")).alias("has_short"), N.full_form(short).alias("long_form"), N.short_form(long).alias("short_form"))


_WORDS = [k for k in D.SHORT_FORMS if k == k.upper() and " " not in k]
_FORMS = ", ".join(f"('{i}', '{k.lower()}', '{D.SHORT_FORMS[k]}')".replace("King George's", "King George''s") for i, k in enumerate(_WORDS))


@query(f"""WITH f(i, w, long) AS (VALUES {_FORMS}), p AS (SELECT p_partkey, p_name, w, long FROM part JOIN f ON p_partkey % {len(_WORDS)} = i::INT),
v AS (SELECT p_partkey, w || ' ' || p_name AS name, long || ' ' || p_name AS full_name, CASE WHEN w IN ('iit', 'nit') THEN 'Indian Institute of Technology ' || p_name END AS pattern FROM p)
SELECT p_partkey, name, unnest(vs) AS variant, unnest(range(len(vs)))::INT AS pos FROM (SELECT p_partkey, name, CASE WHEN pattern IS NULL OR lower(pattern) = lower(full_name) THEN [full_name] ELSE [full_name, pattern] END AS vs FROM v)""")
def expand_variants(spark, sf_dir):
    """A short form before each name, every one of those in capitals in turn."""
    words = F.array(*[F.lit(w.lower()) for w in _WORDS])
    parts = _t(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", F.get(words, (F.col("p_partkey") % len(_WORDS)).cast("int")), "p_name").alias("name"))
    return parts.select("p_partkey", "name", F.posexplode(N.expand_variants(F.col("name"))).alias("pos", "variant"))


@query("""WITH t AS (SELECT lower(p_name) AS n, min(p_partkey) AS place, count(*) AS c FROM part GROUP BY 1), m AS (SELECT DISTINCT p_name || ' mumbai' AS name, lower(p_name) AS n FROM part)
SELECT m.name, 'The ' || p.p_name || ' University, Bombay' AS target, m.n || ' mumbai' AS variant FROM m JOIN t USING (n) JOIN part p ON p.p_partkey = t.place""")
def depository_match(spark, sf_dir):
    """Names with the new name of a city against titles with its old one: the longest shared variant has both words."""
    target = _t(spark, sf_dir, "part").select(F.concat(F.lit("The "), "p_name", F.lit(" University, Bombay")).alias("target"), F.col("p_partkey").alias("place"))
    names = _t(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" mumbai")).alias("name"))
    return M.variant_index_join(names, target.withColumn("target", F.regexp_replace("target", "^The | University,", "")), "name", "target", "place").withColumn("target", F.concat(F.lit("The "), F.regexp_replace("target", " Bombay$", " University, Bombay")))


@query("""SELECT n_nationkey AS id, 'name' || n_nationkey AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'w' ELSE 'r' END || n_nationkey || '@x.in' AS email, 'r9' || n_nationkey AS phone, CASE WHEN n_nationkey % 2 = 0 THEN 'ok' END AS status FROM nation""")
def contact_merge(spark, sf_dir):
    """Contacts of a site before those of the registry; states of registry rows under several keys."""
    key = F.col("n_nationkey")
    none = F.lit(None).cast("string")
    attrs = F.create_map(F.lit("email"), F.concat(F.lit("r"), key, F.lit("@x.in")), F.lit("tel"), F.concat(F.lit("r9"), key), F.lit("approval_status"), F.when(key % 2 == 0, " ok ").otherwise(" "))
    web = F.struct(F.when(key % 3 == 0, F.concat(F.lit("w"), key, F.lit("@x.in"))).alias("email"), *[none.alias(f) for f in ("phone", "address", "state", "district", "pincode")])
    rows = _t(spark, sf_dir, "nation").select(key, attrs.alias("a"), web.alias("web"))
    merged = rows.withColumn("c", N.merge_contacts(F.col("web"), N.registry_contacts(F.col("a"))))
    return merged.select(key.alias("id"), F.concat(F.lit("name"), key).alias("name"), "c.email", "c.phone", N.registry_status(F.col("a")).alias("status"))


@query("""WITH p AS (SELECT p_partkey, lower(p_name) AS n, regexp_extract_all(lower(p_name), '\\b[a-z0-9_]') AS i, string_split(lower(p_name), ' ')[1] AS f FROM part), g AS (SELECT p_partkey, array_to_string(i, '') AS i, f FROM p)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN length(i) BETWEEN 1 AND 5 THEN 'https://' || i || '.edu.in' END, CASE WHEN length(i) BETWEEN 1 AND 5 THEN 'https://' || i || '.ac.in' END, CASE WHEN length(i) BETWEEN 1 AND 5 THEN 'https://www.' || i || '.edu.in' END,
CASE WHEN length(i) BETWEEN 1 AND 5 THEN 'https://' || i || 'tamil.edu.in' END, CASE WHEN length(i) BETWEEN 1 AND 5 THEN 'https://www.' || i || 'tamil.edu.in' END, CASE WHEN length(f) > 2 THEN 'https://' || f || '.edu.in' END, CASE WHEN length(f) > 2 THEN 'https://www.' || f || '.edu.in' END], lambda x: x IS NOT NULL), ' ') AS guesses, 9 AS n_queries FROM g""")
def domain_guesses(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(U.domain_guesses(F.col("p_name"), F.lit("Tamil Nadu")), " ").alias("guesses"), F.size(U.query_templates(F.col("p_name"))).alias("n_queries"))


@query("""WITH p AS (SELECT p_partkey, lower(p_type) AS a, lower(CASE WHEN p_partkey % 4 = 0 THEN p_type WHEN p_partkey % 4 = 1 THEN 'The ' || p_type ELSE p_name || ' ' || string_split(p_type, ' ')[1] END) AS b FROM part),
w AS (SELECT *, list_distinct(string_split(a, ' ')) AS wa, list_distinct(string_split(b, ' ')) AS wb FROM p), s AS (SELECT p_partkey, CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.85 ELSE len(list_intersect(wa, wb)) / len(wb) * 0.8 END AS m FROM w)
SELECT p_partkey, round(m, 9) AS title_match, CASE WHEN m >= 0.9 THEN 'high' WHEN m >= 0.7 THEN 'medium' WHEN m >= 0.5 THEN 'low' ELSE 'unknown' END AS level FROM s""")
def title_matches(spark, sf_dir):
    key = F.col("p_partkey")
    name = F.when(key % 4 == 0, F.col("p_type")).when(key % 4 == 1, F.concat(F.lit("The "), "p_type")).otherwise(F.concat_ws(" ", "p_name", F.element_at(F.split("p_type", " "), 1)))
    m = S.title_match(F.col("p_type"), name)
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(m, 9).alias("title_match"), S.confidence_level(m).alias("level"))


@query("""WITH i AS (SELECT event_id, [0, 10, 100, 127, 169, 172, 192, 224][event_id % 8 + 1] AS a, [0, 16, 31, 32, 168, 254][event_id % 6 + 1] AS b FROM events)
SELECT event_id, a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 192 AND b = 168) OR (a = 172 AND b BETWEEN 16 AND 31) AS private FROM i""")
def private_addresses(spark, sf_dir):
    key = F.col("event_id")
    ip = F.concat_ws(".", _pick([0, 10, 100, 127, 169, 172, 192, 224], key), _pick([0, 16, 31, 32, 168, 254], key), F.lit("7"), F.lit("1"))
    return _t(spark, sf_dir, "events").select("event_id", U.is_private_ip(ip).alias("private"))


# Scalars -----------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderdate > TIMESTAMP '1998-01-01' THEN CASE WHEN d >= 604800 THEN 'in ' || d // 604800 || 'w' WHEN d >= 86400 THEN 'in ' || d // 86400 || 'd' ELSE 'in 0m' END ELSE CASE WHEN d >= 604800 THEN d // 604800 || 'w ago' WHEN d >= 86400 THEN d // 86400 || 'd ago' ELSE '0m ago' END END AS age,
strftime(o_orderdate, 'k:%Y-%m-%d') AS idem, 'evidence/' || strftime(o_orderdate, '%Y/%m') || '/x' AS blob, epoch(TIMESTAMP '1998-01-01') - epoch(o_orderdate) > 7 * 86400 AS stale, (1000 * 2 ** (o_orderkey % 6))::BIGINT AS backoff,
CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 90) WHEN 1 THEN 3600 END::BIGINT AS retry_after
FROM (SELECT *, abs(epoch(TIMESTAMP '1998-01-01') - epoch(o_orderdate))::BIGINT AS d FROM orders)""")
def date_scalars(spark, sf_dir):
    then, key, now = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey"), F.to_timestamp(F.lit("1998-01-01 00:00:00"))
    header = F.when(key % 3 == 0, (key % 90).cast("string")).when(key % 3 == 1, "Thu, 01 Jan 1998 01:00:00 GMT").otherwise("soon")
    return _t(spark, sf_dir, "orders").select("o_orderkey", X.relative_age(then, now).alias("age"), X.idempotency_key(F.lit("k"), then).alias("idem"), X.blob_key(F.lit("x"), then).alias("blob"), X.is_stale(then, now).alias("stale"), X.backoff_ms(key % 6).alias("backoff"), X.retry_after_seconds(header, now).alias("retry_after"))


@query("""SELECT conv_id, turn, CASE WHEN length(text) <= 40 THEN text ELSE CASE WHEN strpos(reverse(text[1:40]), ' ') BETWEEN 1 AND 7 THEN text[1:40 - strpos(reverse(text[1:40]), ' ')] ELSE text[1:40] END || '…' END AS short,
(length(text) % 101)::VARCHAR || '%' AS percent, CASE WHEN length(text) < 1000 THEN length(text) || 'ms' WHEN length(text) < 60000 THEN (length(text) + 50) // 100 // 10 || '.' || (length(text) + 50) // 100 % 10 || 's' ELSE 'long' END AS took,
regexp_replace(text, ' ([^\\s"]+)\\z', ' token=[REDACTED]') AS redacted, '/a/' || turn AS disallowed, 'Q' || conv_id AS item FROM conversations""")
def text_scalars(spark, sf_dir):
    n = F.length("text")
    robots = F.concat(F.lit("User-agent: *\nDisallow: /a/"), "turn", F.lit("\nAllow: /b"))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", X.truncate_text(F.col("text"), 40).alias("short"), X.format_percent(n % 101 / 100.0).alias("percent"), X.format_duration(n).alias("took"), X.redact_secrets(F.regexp_replace("text", r' ([^\s"]+)\z', " token=$1")).alias("redacted"), F.array_join(X.robots_disallowed(robots), " ").alias("disallowed"), X.knowledge_id(F.concat(F.lit("http://w.org/entity/Q"), "conv_id")).alias("item"))


# Evidence ----------------------------------------------------------------------------------------------------


@query("SELECT 's' || (doc_id % 50) || '-' || doc_id AS id, lang AS kind, sha256(coalesce(text, '')) AS content_hash, CASE WHEN length(text) > 102400 THEN 'evidence/2024/02/' || sha256(text) END AS blob_key, length(text) <= 102400 AS kept FROM documents WHERE doc_id % 3 <> 0")
def evidence_normalize(spark, sf_dir):
    """Documents as stored evidence, and those of a third of them gone by retention."""
    age = F.when(F.col("doc_id") % 3 == 0, 100).otherwise(10)
    items = _t(spark, sf_dir, "documents").select(F.concat(F.lit("s"), F.col("doc_id") % 50).alias("run_id"), F.col("doc_id").alias("_pos"), F.col("lang").alias("category"), F.col("text").alias("content"), F.lit("t").alias("_t"), age.alias("age"))
    rows = E.normalize(items.withColumn("matched_text", F.col("content")), _as_of()).withColumn("created_at", _as_of() - F.make_dt_interval("age"))
    return E.retain(rows, _as_of()).select("id", "kind", "content_hash", "blob_key", F.col("matched_text").isNotNull().alias("kept"))


_PIVOT = ", ".join(f"count(*) FILTER (tier = '{t}') AS tier_{t}" for t in E.TIERS) + ", " + ", ".join(f"count(*) FILTER (kind = '{k}') AS kind_{k}" for k in P.KINDS)


@query(f"WITH e AS (SELECT user_id AS run_id, ['mirror', 'api', 'live'][event_id % 3 + 1] AS tier, {P.KINDS}[event_id % 5 + 1] AS kind, (event_id % 10) / 10.0 AS q FROM events) SELECT run_id, count(*) AS total, {_PIVOT}, round(avg(q), 9) AS avg_quality FROM e GROUP BY 1")
def collector_stats(spark, sf_dir):
    key = F.col("event_id")
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), _pick(E.TIERS, key).alias("tier"), _pick(P.KINDS, key).alias("kind"), (key % 10 / 10.0).alias("quality_score"))
    return E.collector_counts(e).withColumn("avg_quality", F.round("avg_quality", 9))


@query("""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN turn % 4 = 1 THEN 'payload holds HTML' END, CASE WHEN length(text) + CASE WHEN turn % 4 = 1 THEN 6 ELSE 0 END > 200 THEN 'payload too large' END, CASE WHEN turn % 5 = 2 THEN 'quality out of range' END, CASE WHEN turn % 3 = 0 THEN 'references out of order' END], lambda x: x IS NOT NULL), ',') AS errors FROM conversations""")
def payload_checks(spark, sf_dir):
    turn = F.col("turn")
    payload = F.concat(F.when(turn % 4 == 1, "<html>").otherwise(""), "text")
    refs = F.array(F.lit("e1"), F.when(turn % 3 == 0, "e3").otherwise("e2"))
    errors = E.payload_errors(payload, F.lit(0.0), F.when(turn % 5 == 2, 1.5).otherwise(1.0), 200, refs)
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(errors, ",").alias("errors"))


@query("""WITH x AS (SELECT n_nationkey AS id, ['engineering', 'medical', 'school', 'other'][n_nationkey % 4 + 1] AS kind, ['AICTE', 'NMC', 'CBSE', 'UGC', 'AISHE'][n_nationkey % 5 + 1] AS authority FROM nation)
SELECT id, authority = 'AISHE' OR (kind, authority) IN (('engineering', 'AICTE'), ('engineering', 'UGC'), ('medical', 'NMC'), ('medical', 'UGC'), ('school', 'CBSE'), ('other', 'UGC')) AS applies FROM x""")
def authority_applies(spark, sf_dir):
    key = F.col("n_nationkey")
    return _t(spark, sf_dir, "nation").select(key.alias("id"), E.is_applicable(_pick(["engineering", "medical", "school", "other"], key), _pick(["AICTE", "NMC", "CBSE", "UGC", "AISHE"], key)).alias("applies"))


@query("""SELECT o_orderkey, v IN ('Genuine', 'Likely Genuine') AS positive, v IN ('Fake', 'Likely Fake') AS negative, CASE v WHEN 'Genuine' THEN 'green' WHEN 'Likely Genuine' THEN 'lime' WHEN 'Needs Review' THEN 'yellow' WHEN 'Likely Fake' THEN 'orange' ELSE 'red' END AS color,
CASE WHEN age <= days THEN 'fresh' WHEN age <= 2 * days THEN 'stale' ELSE 'expired' END AS freshness FROM (SELECT o_orderkey, v, (epoch(TIMESTAMP '1998-09-01') - epoch(o_orderdate)) / 86400 AS age, CASE v WHEN 'Genuine' THEN 180 WHEN 'Likely Genuine' THEN 90 WHEN 'Needs Review' THEN 14 WHEN 'Likely Fake' THEN 30 ELSE 7 END AS days
FROM (SELECT *, ['Genuine', 'Likely Genuine', 'Needs Review', 'Likely Fake', 'Fake'][o_orderkey % 5 + 1] AS v FROM orders))""")
def verdict_marks(spark, sf_dir):
    v = _pick(["Genuine", "Likely Genuine", "Needs Review", "Likely Fake", "Fake"], F.col("o_orderkey"))
    fresh = A.freshness(v, F.col("o_orderdate").cast("timestamp"), F.to_timestamp(F.lit("1998-09-01 00:00:00")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", P.is_positive(v).alias("positive"), P.is_negative(v).alias("negative"), P.verdict_color(v).alias("color"), fresh.alias("freshness"))


@query("""WITH c AS (SELECT o_custkey % 100 AS input, ['institution', 'registry'][o_orderkey % 2 + 1] AS type, o_orderkey % 9 AS id, max(o_totalprice) AS confidence FROM orders GROUP BY ALL)
SELECT input, type, id, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY input ORDER BY confidence DESC, type, id)::INT AS rank FROM c QUALIFY rank <= 5""")
def candidate_merge(spark, sf_dir):
    key = F.col("o_orderkey")
    found = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("input"), _pick(["institution", "registry"], key).alias("type"), (key % 9).alias("id"), F.col("o_totalprice").alias("confidence"))
    return M.merge_candidates(found, ["input"]).withColumn("confidence", F.round("confidence", 6))


@query("""SELECT (SELECT count(*) FROM orders) AS institutions, (SELECT round(avg(o_totalprice), 4) FROM orders) AS avg_confidence, (SELECT count(*) FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS runs_today, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n_f,
(SELECT count(*) FROM events WHERE event_id % 3 = 0) AS n_mirror, (SELECT max(l_shipdate) FROM lineitem WHERE l_suppkey % 2 = 0) AS last_even, (SELECT max(l_shipdate) FROM lineitem WHERE l_suppkey % 2 = 1) AS last_odd""")
def system_overview(spark, sf_dir):
    """Totals, runs of the day, evidence by tier and last ingestion by authority, as one row."""
    runs = _t(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("verdict"), F.col("o_totalprice").alias("confidence"), F.col("o_orderdate").alias("at"))
    evidence = _t(spark, sf_dir, "events").select(_pick(E.TIERS, F.col("event_id")).alias("tier"))
    ingested = _t(spark, sf_dir, "lineitem").select(_pick(["even", "odd"], F.col("l_suppkey")).alias("authority"), F.col("l_shipdate").alias("at"))
    out = A.system_overview(runs, evidence, ingested, F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")))
    return out.select("institutions", F.round("avg_confidence", 4).alias("avg_confidence"), "runs_today", F.col("by_verdict")["F"].alias("n_f"), F.col("by_tier")["mirror"].alias("n_mirror"), F.col("last_ingest")["even"].alias("last_even"), F.col("last_ingest")["odd"].alias("last_odd"))


# Answers of a language model ---------------------------------------------------------------------------------


@query("""SELECT n_nationkey AS id, 'Name ' || n_nationkey AS name, array_to_string(list_filter([CASE WHEN n_nationkey % 5 = 0 THEN 'confidence' END, CASE WHEN n_nationkey % 4 = 0 THEN 'emails' END, CASE WHEN n_nationkey % 3 = 0 THEN 'urls' END, CASE WHEN n_nationkey % 7 = 0 THEN 'refs' END], lambda x: x IS NOT NULL), ',') AS errors,
n_nationkey % 2 = 0 AS judged FROM nation""")
def structured_answers(spark, sf_dir):
    k = F.col("n_nationkey")
    text = F.format_string(
        '{"officialName":"Name %d","officialNameRefs":["%s"],"extractedAt":1.5,"confidence":%s,"website":"%s","contacts":{"emails":["%s"],"phones":[],"sourceRefs":["e1"]}}',
        k.cast("int"), F.when(k % 7 == 0, "e99").otherwise("e2"), F.when(k % 5 == 0, "1.5").otherwise("0.5"), F.when(k % 3 == 0, "no address").otherwise("https://a.in/x"), F.when(k % 4 == 0, "nobody").otherwise("a@b.in"),
    )
    judged = F.when(k % 2 == 0, '{"keyFindings":["x"],"reasoning":"short","judgedAt":2}').otherwise(F.concat(F.lit('{"keyFindings":["x"],"judgedAt":2,"reasoning":"'), F.repeat(F.lit("y"), 1300), F.lit('"}')))
    rows = _t(spark, sf_dir, "nation").select(k.alias("id"), text.alias("answer"), judged.alias("judgment_answer"))
    facts = T.read_facts(rows, refs=F.array(F.lit("e1"), F.lit("e2"))).select("id", F.col("facts.officialName").alias("name"), F.array_join("errors", ",").alias("errors"), "judgment_answer")
    return T.read_judgment(facts.withColumnRenamed("errors", "wrong"), "judgment_answer").select("id", "name", F.col("wrong").alias("errors"), (F.size("errors") == 0).alias("judged"))


@query("""WITH l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, 'e' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || ' from ' || role || ', tier api, quality 50%' || chr(10) || 'text: ' || CASE WHEN length(text) > 200 THEN text[1:200] || '…' ELSE text END AS line FROM conversations WHERE text <> '')
SELECT conv_id, 'Give the facts about run ' || conv_id || ' that the evidence below states, each with the numbers it rests on.' || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY n) AS prompt FROM l GROUP BY 1""")
def prompt_texts(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").filter("text <> ''")
    capped = E.capped_prefix(c, "conv_id", [F.col("turn")], F.lit(0), E.PAYLOAD_CHARS).select("conv_id", "ref", F.col("role").alias("source"), F.lit("api").alias("tier"), F.lit(0.5).alias("quality_score"), "text", F.lit(None).cast("string").alias("url"))
    names = c.select("conv_id", F.concat(F.lit("run "), "conv_id").alias("name")).distinct()
    return T.prompts(capped, names, "conv_id")


# Validation and enrichment -----------------------------------------------------------------------------------


@query("""WITH i AS (SELECT DISTINCT lower(c_name) AS n, c_custkey AS k FROM customer)
SELECT n AS normalized_name, CASE WHEN k % 5 = 0 THEN 'L0' WHEN k % 5 = 1 THEN 'L1' ELSE 'L1.5' END AS level, CASE WHEN k % 5 = 0 THEN 'Genuine' WHEN k % 5 = 1 THEN 'Fake' WHEN k % 2 = 0 THEN 'Fake' ELSE 'Likely Genuine' END AS verdict FROM i WHERE k % 5 <> 4 AND (k % 5 < 2 OR k % 5 = 2)""")
def fast_path_levels(spark, sf_dir):
    """Cached verdicts, then fresh institutions, then registry entries; stale ones and unknown names are left to the search."""
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("input"), N.lookup_form(F.col("c_name")).alias("normalized_name"))
    key = F.col("c_custkey")
    cached = c.filter(key % 5 == 0).select("normalized_name", F.lit("Genuine").alias("verdict"))
    at = F.when(key % 5 == 1, _as_of()).otherwise(_as_of() - F.make_dt_interval(F.lit(30)))
    inst = c.filter((key % 5 == 1) | (key % 5 == 3)).select(key.alias("id"), "normalized_name", F.lit("Fake").alias("verdict"), F.lit(None).cast("timestamp").alias("deleted_at"), at.alias("last_validated_at"))
    entries = c.filter(key % 5 == 2).select("normalized_name", F.when(key % 2 == 0, "UGC_FAKE").otherwise("UGC").alias("authority_code"))
    return fast_path(c, cached, inst, entries, _as_of())


@query("""WITH p AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1) SELECT name AS input, 'L' || id % 3 AS level, id, CASE WHEN id % 3 = 2 THEN 'doubtful' ELSE 'certain' END AS band, CASE WHEN id % 2 = 0 THEN 'https://p' || id || '.in' END AS website, 1 AS rank FROM p
UNION ALL SELECT s_name, 'none', NULL, 'doubtful', NULL, 1 FROM supplier""")
def discovery_levels(spark, sf_dir):
    """Names that the cache, the institutions, or only the search among candidates know, and names that nothing fits."""
    p = _t(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id")).withColumn("normalized_name", N.lookup_form(F.col("name")))
    pool = p.filter("id % 3 = 2").select(F.lit("registry").alias("type"), "id", "name", F.col("name").alias("match_text"), F.lit("AISHE").alias("source"), F.col("id").cast("string").alias("external_id"))
    sites = p.filter("id % 2 = 0").select("name", F.concat(F.lit("https://p"), "id", F.lit(".in")).alias("url"))
    inputs = p.select(F.col("name").alias("input")).union(_t(spark, sf_dir, "supplier").select("s_name"))
    out = discover(inputs, p.filter("id % 3 = 0"), p.filter("id % 3 = 1"), pool, sites, limit=1)
    return out.select("input", "level", "id", "band", "website", "rank")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'own@x.in' WHEN p_partkey % 3 = 0 THEN 'web@x.in' END AS email, CASE WHEN p_partkey % 3 = 0 THEN '+919800000000' END AS phone, CASE WHEN p_partkey % 3 = 0 THEN '403001' END AS address, CASE WHEN p_partkey % 3 = 0 THEN 'goa' END AS state FROM part""")
def page_fill_in(spark, sf_dir):
    """Missing fields of profiles from the pages of their sites; the postal code stands for a missing address."""
    key = F.col("p_partkey")
    none = F.lit(None).cast("string")
    site = F.concat(F.lit("https://p"), key, F.lit(".in"))
    profiles = _t(spark, sf_dir, "part").select(key.alias("id"), site.alias("website"), F.when(key % 2 == 0, "own@x.in").otherwise("").alias("email"), none.alias("phone"), none.alias("address"), none.alias("state"))
    empty = F.array().cast("array<string>")
    pages = _t(spark, sf_dir, "part").filter(key % 3 == 0).select(site.alias("url"), F.array(F.lit("web@x.in"), F.lit("two@x.in")).alias("emails"), F.array(F.lit("+919800000000")).alias("phones"), empty.alias("addresses"), F.lit("403001").alias("detected_pin_code"), F.lit("goa").alias("detected_state"))
    filled = R.fill_from_page(profiles, pages)
    return filled.select("id", F.nullif("email", F.lit("")).alias("email"), "phone", "address", "state")


@query(f"WITH {_ENTRIES}, c AS (SELECT id, CASE WHEN website IS NOT NULL AND id % 2 = 0 THEN 'web@s.in' ELSE email END AS email, phone, (SELECT min(x.id) FROM e x WHERE x.normalized_name = e.normalized_name AND x.id % 2 = 0) AS institution_id FROM e) SELECT id, email, phone, institution_id, (SELECT count(*) FROM c) AS processed, (SELECT count(*) FROM c WHERE email IS NOT NULL OR phone IS NOT NULL) AS enriched FROM c")
def entry_contacts(spark, sf_dir):
    """Contacts of registry entries from their sites, else from the registry, linked to institutions, and how many got some."""
    entries = _entries(spark, sf_dir)
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    pages = entries.filter("id % 2 = 0").select(N.registry_url(F.col("attributes")).alias("url"), F.array(F.lit("web@s.in")).alias("emails"), empty.alias("phones"), empty.alias("addresses"), none.alias("detected_state"), none.alias("detected_pin_code")).filter("url IS NOT NULL")
    rows = R.link_to_institutions(R.entry_contacts(entries, pages), entries.filter("id % 2 = 0").select("id", "normalized_name"))
    counts = R.bulk_counts(rows)
    return rows.select("id", "email", "phone", "institution_id").crossJoin(F.broadcast(counts))


@query(f"WITH {_ENTRIES}, i AS (SELECT n_nationkey AS id, 'name ' || n_nationkey AS normalized_name FROM nation WHERE n_nationkey % 2 = 0 ORDER BY 1 LIMIT 10) SELECT i.id, arg_min(e.website, e.id) AS found_url FROM i JOIN e USING (normalized_name) WHERE website IS NOT NULL GROUP BY 1")
def missing_sites(spark, sf_dir):
    inst = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("name "), "n_nationkey").alias("normalized_name"), F.when(F.col("n_nationkey") % 2 == 1, "https://known.in").alias("website"))
    return R.missing_sites(inst, _entries(spark, sf_dir), 10).select("id", "found_url")


@query("""SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'https://' || lower(replace(n_name, '_', '')) || '.edu.in' ELSE 'https://hit' || n_nationkey || '.in' END AS url, CASE WHEN n_nationkey % 3 = 0 THEN 0.85 END AS title_match FROM nation WHERE n_nationkey % 3 < 2 AND strpos(n_name, ' ') = 0""")
def site_discovery(spark, sf_dir):
    """Guessed addresses whose page title fits, else the first search hit."""
    key, name = F.col("n_nationkey"), F.replace("n_name", F.lit("_"), F.lit(""))
    rows = _t(spark, sf_dir, "nation").filter("instr(n_name, ' ') = 0")
    inst = rows.select(key.alias("id"), name.alias("canonical_name"), F.lit(None).cast("string").alias("state"))
    titles = rows.filter(key % 3 == 0).select(F.concat(F.lit("https://"), F.lower(name), F.lit(".edu.in")).alias("url"), F.concat(F.lit("Home of "), name).alias("title"))
    hits = rows.filter(key % 3 == 1).select(name.alias("name"), F.explode(F.array(F.struct(F.concat(F.lit("https://hit"), key, F.lit(".in")).alias("url"), F.lit(1).alias("pos")), F.struct(F.lit("https://other.in").alias("url"), F.lit(2).alias("pos")))).alias("h")).select("name", "h.*")
    return R.discover_sites(inst, titles, hits)


@query(f"WITH {_ENTRIES}, f AS (SELECT *, row_number() OVER (PARTITION BY normalized_name ORDER BY id) AS n FROM e), p AS (SELECT normalized_name, count(*) AS n_entries, arg_min(canonical_name, n) AS official_name FROM f WHERE n <= 5 GROUP BY 1) SELECT normalized_name, official_name, n_entries, (SELECT arg_min(website, id) FROM e WHERE e.normalized_name = p.normalized_name AND website IS NOT NULL) AS website FROM p")
def registry_profiles(spark, sf_dir):
    """Profiles of names from their registry entries, with the site that the first entry with one gives."""
    entries = _entries(spark, sf_dir)
    out = R.site_override(R.profile(entries).withColumn("website", F.lit(None).cast("string")), entries)
    return out.select("normalized_name", "official_name", "n_entries", "website")


# Streams and queues ------------------------------------------------------------------------------------------


@query("SELECT event_id, event_id % 3 <> 0 AS valid, CASE WHEN event_id % 3 <> 0 THEN user_id END AS batch FROM events WHERE event_type = 'view'")
def typed_events(spark, sf_dir):
    """Events of one kind with their payload; a third lacks a required field."""
    key = F.col("event_id")
    data = F.when(key % 3 == 0, '{"name":"x"}').otherwise(F.concat(F.lit('{"batchId":'), "user_id", F.lit(',"institutionCount":4}')))
    rows = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "batch/created").otherwise("other").alias("name"), data.alias("data"))
    return V.typed(rows, "batch/created").select("event_id", "valid", F.when(F.col("valid"), F.col("payload.batchId")).alias("batch"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def idempotent_events(spark, sf_dir):
    return V.idempotent(_t(spark, sf_dir, "events"), ["user_id", "event_type"], "ts").select("user_id", "event_type")


@query("""WITH d AS (SELECT event_id, event_type AS kind, (event_id % 5)::INT AS attempts, event_id % 4 = 0 AS resolved, ts FROM events)
SELECT kind, count(*) FILTER (NOT resolved) AS open, count(*) FILTER (NOT resolved AND attempts < 3 AND epoch_ms(ts) + 10000 * 2 ** attempts <= epoch_ms(TIMESTAMP '2024-01-15')) AS due FROM d GROUP BY 1""")
def dead_letters(spark, sf_dir):
    """Open dead letters by kind, and how many of them are due for another attempt."""
    key = F.col("event_id")
    rows = V.as_event_time(_t(spark, sf_dir, "events"), "ts").select(F.col("event_type").alias("kind"), (key % 5).cast("int").alias("attempts"), F.when(key % 4 == 0, _as_of()).alias("resolved_at"), F.col("ts").alias("last_attempt_at"))
    due = A.due_retries(rows, F.to_timestamp(F.lit("2024-01-15 00:00:00"))).groupBy("kind").agg(F.count(F.lit(1)).alias("due"))
    return A.open_dead_letters(rows).join(due, "kind", "left").select("kind", "open", F.coalesce("due", F.lit(0)).alias("due"))


@query("""WITH l AS (SELECT conv_id, list(length(text)::DOUBLE ORDER BY turn) AS v FROM conversations GROUP BY 1) SELECT conv_id, round(list_reduce(v, lambda s, x: (s + x) / 2), 6) AS blended FROM l""")
def blended_latencies(spark, sf_dir):
    lists = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda x: x["n"]).alias("v"))
    return lists.select("conv_id", F.round(A.blended_latency(F.col("v")), 6).alias("blended"))


@query("SELECT o_custkey % 50 AS k, arg_min(o_orderkey, (CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END, o_orderkey)) AS first FROM orders GROUP BY 1")
def priority_rows(spark, sf_dir):
    """The first row of each key in an order of priorities, over the union of two tables."""
    o = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("k"), F.col("o_orderkey").alias("first"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("p"))
    both = M.union_all([o.filter("first % 2 = 0"), o.filter("first % 2 = 1")])
    return M.priority_first(both, ["k"], [F.col("p"), F.col("first")]).select("k", "first")


# Further operators -------------------------------------------------------------------------------------------


@query(f"""WITH {_LINKS}, n AS (SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation WHERE contains(lower(n_name), 'r 00') UNION ALL SELECT institution_id, name_as_source FROM l WHERE contains(lower(name_as_source), '0001')),
m AS (SELECT id, min(name) AS name FROM n GROUP BY 1) SELECT id, name, 0.8 AS confidence, row_number() OVER (ORDER BY id)::INT AS rank FROM m QUALIFY rank <= 5""".replace("'r 00'", "'0001'"))
def name_search(spark, sf_dir):
    inst = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("canonical_name"))
    return L.name_search(inst, _links(spark, sf_dir), "0001")


@query("""WITH p AS (SELECT s_nationkey AS id, 'Supplier ' || s_nationkey AS name, ['UGC', 'LLM', 'AICTE'][s_suppkey % 3 + 1] AS source, 'e' || (s_suppkey % 40) || '@x.in' AS email, CASE WHEN s_suppkey % 2 = 0 THEN 'p' || (s_suppkey % 30) END AS phone FROM supplier), r AS (SELECT * FROM p WHERE source <> 'LLM'),
c AS (SELECT DISTINCT id, 'email' AS kind, email AS value FROM r UNION SELECT DISTINCT id, 'phone', phone FROM r WHERE phone IS NOT NULL), k AS (SELECT id, count(*) AS n FROM c GROUP BY 1)
SELECT r.id, any_value('supplier-' || r.id) AS slug, least(any_value(n), 5)::BIGINT AS contacts, count(DISTINCT source) AS identities FROM r JOIN k USING (id) GROUP BY 1""")
def profile_save(spark, sf_dir):
    """What is kept of profiles: slugs, up to five contacts, one identity per source, nothing that a model made up."""
    key, none = F.col("s_suppkey"), F.lit(None).cast("string")
    profiles = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id"), F.concat(F.lit("Supplier "), "s_nationkey").alias("canonical_name"), _pick(["UGC", "LLM", "AICTE"], key).alias("source"), F.concat(F.lit("e"), key % 40, F.lit("@x.in")).alias("email"), F.when(key % 2 == 0, F.concat(F.lit("p"), key % 30)).alias("phone"), none.alias("website"))
    kept = R.saved_profiles(profiles, _as_of())
    contacts = kept["contacts"].groupBy(F.col("institution_id").alias("id")).agg(F.count(F.lit(1)).alias("contacts"))
    identities = kept["identities"].groupBy(F.col("institution_id").alias("id")).agg(F.count(F.lit(1)).alias("identities"))
    return kept["institutions"].join(contacts, "id").join(identities, "id").select("id", "slug", "contacts", "identities")


@query("""SELECT 'p' || n_nationkey AS id, (CASE WHEN n_nationkey % 3 = 1 THEN n_nationkey % 4 + 10 ELSE n_nationkey % 4 END)::BIGINT AS version, 'kept' AS outcome, '' AS wrong FROM nation
UNION ALL SELECT 'p' || n_nationkey, n_nationkey % 4 + 10, 'wrong', CASE WHEN n_nationkey % 3 = 2 THEN 'threshold_genuine' ELSE 'weight_mirror' END FROM nation WHERE n_nationkey % 3 <> 1""")
def policy_upsert(spark, sf_dir):
    """New versions of all nations' policies: valid ones go over the old, those with a wrong threshold or weight do not."""
    old = _nation_policies(spark, sf_dir)
    number = F.substring("id", 2, 9).cast("int")
    new = old.withColumns({"version": F.col("version") + 10, "threshold_genuine": F.when(number % 3 == 2, 0.2).otherwise(F.col("threshold_genuine")), "weight_mirror": F.when(number % 3 == 0, 1.5).otherwise(F.col("weight_mirror"))})
    kept, wrong = P.upsert_policies(old, new)
    told = F.array_join(F.transform("errors", lambda e: F.element_at(F.split(e, " "), 1)), ",")
    rows = lambda df, outcome, why: df.select("id", F.col("version").cast("long").alias("version"), F.lit(outcome).alias("outcome"), why.alias("wrong"))
    return rows(kept, "kept", F.lit("")).unionByName(rows(wrong, "wrong", told))


@query("""SELECT 1::BIGINT AS snapshot_id, 'published' AS state, count(*) AS added, 0::BIGINT AS changed FROM supplier UNION ALL SELECT 2, 'published', 0, count(*) FILTER (s_suppkey % 4 = 0) FROM supplier UNION ALL SELECT 3, 'unchanged', 0, 0""")
def registry_by_content(spark, sf_dir):
    """Snapshots compared by content: equal counts with other names are published, equal content in another order is unchanged."""
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("external_id"), F.col("s_name").alias("name"), F.create_map(F.lit("status"), F.lit("ok")).alias("raw_data"), F.col("s_suppkey").alias("_pos"))
    renamed = rows.withColumn("name", F.when(F.col("_pos") % 4 == 0, F.concat("name", F.lit(" Hall"))).otherwise(F.col("name")))
    store = G.RegistryStore(spark, _folder(spark))
    reports = [store.ingest(drafts, "UGC", number, NOW, by_content=True) for number, drafts in enumerate([rows, renamed, renamed.withColumn("_pos", -F.col("_pos"))], 1)]
    return spark.createDataFrame([(i, r.state, r.added, r.changed) for i, r in enumerate(reports, 1)], "snapshot_id long, state string, added long, changed long")


@query("SELECT n_name AS name, true AS stale FROM nation")
def stale_on_error(spark, sf_dir):
    """A connector whose files are gone serves what it loaded last."""
    last = _t(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    return connectors.load_or_last(spark, "ugc-fake", f"{_folder(spark)}/gone", last)


@query("SELECT c_custkey AS run_id, 'identity' AS kind, 'WIKIDATA' AS source, 'about ' || c_name AS matched_text FROM customer")
def knowledge_evidence(spark, sf_dir):
    """Evidence from entries of a knowledge base, as it is stored."""
    found = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.concat(F.lit("about "), "c_name").alias("text"), F.lit("https://w.org/Q1").alias("url"))
    items = E.knowledge_evidence(found, "WIKIDATA", _as_of()).withColumn("_pos", F.lit(0))
    return E.dedupe(E.normalize(items, _as_of())).select("run_id", "kind", "source", "matched_text")
