from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from attestry.operators import identity as I
from attestry.operators.chains import chain_ends
from attestry.operators import registry as G
from attestry.sources import connectors, uploads

NOW = dt.datetime(2024, 2, 1)
DRAFT = "external_id string, name string, raw_data map<string,string>, _pos int"


def drafts(spark, n, prefix="x"):
    return spark.createDataFrame([(f"{prefix}{i}", f"College  {i}", {"type": "central", "status": " ok "}, i) for i in range(n)], DRAFT)


def test_gate_and_publication(spark, tmp_path):
    store = G.RegistryStore(spark, f"file://{tmp_path}/mirror")
    first = store.ingest(drafts(spark, 100), "UGC", 1, NOW)
    assert (first.state, first.row_count, first.added) == ("published", 100, 100)
    assert store.ingest(drafts(spark, 100), "UGC", 2, NOW).state == "unchanged"
    assert store.ingest(drafts(spark, 20), "UGC", 3, NOW).state == "rejected"
    live = G.published_entries(store.entries, store.log)
    assert live.count() == 100 and {r["type"] for r in live.collect()} == {"Central University"} and {r["normalized_name"] for r in live.limit(1).collect()} <= {f"college {i}" for i in range(100)}
    more = store.ingest(drafts(spark, 110), "UGC", 4, NOW)
    assert (more.state, more.added, more.removed, more.changed) == ("published", 10, 0, 0)
    assert G.published_entries(store.entries, store.log).count() == 110
    assert G.published_entries(store.entries, store.log, all_published=True).count() == 210
    assert G.rows_per_authority(G.published_entries(store.entries, store.log)).first()["rows"] == 110
    assert G.lookup(G.published_entries(store.entries, store.log), "COLLEGE 10", ["UGC"]).count() == 11
    assert G.lookup_external(G.published_entries(store.entries, store.log), "UGC", "x7").first()["canonical_name"] == "College  7"
    with pytest.raises(ValueError):
        G.lookup_external(store.entries, "NOPE", "x")


def test_content_decides_if_asked(spark, tmp_path):
    store = G.RegistryStore(spark, f"file://{tmp_path}/mirror")
    store.ingest(drafts(spark, 10), "UGC", 1, NOW)
    other = store.ingest(drafts(spark, 10, "y"), "UGC", 2, NOW, by_content=True)
    assert (other.state, other.added, other.removed) == ("published", 10, 10)
    assert store.ingest(drafts(spark, 10, "y"), "UGC", 3, NOW, by_content=True).state == "unchanged"


def test_strict_gate(spark, tmp_path):
    rows = [("a", "n", {}, 0), ("a", "m", {}, 1), ("b", "k", {}, 2), ("", "k", {}, 3), ("c", " ", {}, 4)]
    store = G.RegistryStore(spark, f"file://{tmp_path}/mirror")
    report = store.ingest(spark.createDataFrame(rows, DRAFT), "PCI", 1, NOW, G.Rules(strict=True))
    assert report.state == "rejected" and [c["name"] for c in report.checks if not c["passed"]] == ["Duplicates"]
    dry = G.RegistryStore(spark, f"file://{tmp_path}/dry")
    assert dry.ingest(drafts(spark, 5), "PCI", 1, NOW, dry_run=True).row_count == 5 and dry.entries is None


def test_failure_is_marked(spark, tmp_path):
    store = G.RegistryStore(spark, f"file://{tmp_path}/mirror")
    broken = drafts(spark, 3).withColumn("name", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        store.ingest(broken, "PCI", 1, NOW)
    assert G.latest_state(store.log).first()["state"] == "failed"


def test_authority_codes(spark):
    got = spark.createDataFrame([("ugc-fake",), ("digilocker",), ("wikidata",), ("nope",)], "c string").coalesce(1).select(G.authority_of(F.col("c"))).collect()
    assert [r[0] for r in got] == ["UGC_FAKE", "NAD", "WIKIDATA", None]


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return f"file://{path.parent if path.parent.name.startswith('state=') is False else path.parent.parent}"


def test_html_connectors(spark, tmp_path):
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    fake = write(tmp_path / "fake" / "p.html", "<table><tr><th>No</th><th>Name</th><th>State</th></tr>" + row("1", "Bad <b>Univ</b>, 12 Road, Delhi", "Delhi") + row("2.", "Worse&nbsp;Univ", "UP") + row("x", "skip", "me") + "</table>")
    got = {r["name"]: r for r in connectors.load(spark, "ugc-fake", fake).collect()}
    assert set(got) == {"Bad Univ", "Worse Univ"} and got["Bad Univ"]["raw_data"]["address"] == "12 Road, Delhi" and got["Bad Univ"]["raw_data"]["status"] == "Fake/Fraudulent"
    nmc = write(tmp_path / "nmc" / "p.html", "<table>" + row("1", "Goa", "Goa Medical", "MBBS", "Goa Univ", "1963", "180", "Yes", "-") + row("2", "", "No State", "MBBS", "U", "1", "1", "1", "1") + "</table>")
    assert [(r["name"], r["affiliated_university"]) for r in connectors.load(spark, "nmc", nmc).collect()] == [("Goa Medical", "Goa Univ")]
    wiki = write(tmp_path / "wiki" / "p.html", "<table><tr><th>Name</th></tr>" + row("AIIMS[1]", "Delhi", "Delhi", "since 1956") + row("AIIMS", "Delhi", "Delhi", "1956") + row("Two", "Goa") + "</table>")
    got = connectors.load(spark, "ini", wiki).collect()
    assert sorted((r["name"], r["city"], r["state"]) for r in got) == [("AIIMS", "Delhi", "Delhi"), ("Two", None, "Goa")]
    nad = write(tmp_path / "nad" / "p.html", "<table>" + row("Goa", "Goa Univ", "Degree") + row("", "", "Marksheet") + row("", "", "Degree") + row("UP", "X Univ", "Degree") + "</table>")
    got = {r["name"]: r["raw_data"]["documentTypes"] for r in connectors.load(spark, "digilocker", nad).collect()}
    assert got == {"Goa Univ": "Degree; Marksheet", "X Univ": "Degree"}
    pci = write(tmp_path / "pci" / "bpharm.html", "<table>" + row("1", "A College", "Goa", "P1", "-") + row("2", "77", "B College", "UP", "P2") + row("3", "A College", "goa", "P3", "-") + "</table>")
    got = {r["name"]: (r["state"], r["raw_data"].get("programType")) for r in connectors.load(spark, "pci", pci).collect()}
    assert got == {"A College": ("Goa", "B.Pharm"), "B College": ("UP", "B.Pharm")}


def test_json_connector(spark, tmp_path):
    for state, rows in {"Goa": [["1", "A", "addr", "North", "Govt", "N", "N", "p1"], ["2", " ", "x"]], "Uttar Pradesh": [["3", "B", "addr", "Agra", "Pvt", "N", "N", "p2"]]}.items():
        folder = tmp_path / f"state={state}"
        folder.mkdir()
        (folder / "data.json").write_text(json.dumps(rows))
    (tmp_path / "state=Bad").mkdir()
    (tmp_path / "state=Bad" / "data.json").write_text("<html>")
    got = sorted((r["external_id"], r["name"], r["state"], r["city"]) for r in connectors.load(spark, "aicte", f"file://{tmp_path}").collect())
    assert got == [("1", "A", "Goa", "North"), ("3", "B", "Uttar Pradesh", "Agra")]
    assert len(connectors.list_connectors()) == 10
    with pytest.raises(ValueError):
        connectors.get_connector("nope")


def test_uploads(spark, tmp_path):
    (tmp_path / "u.csv").write_text("institution_name,state\nA College,Goa\n\n,UP\n" + "x" * 600 + ",UP\n")
    good, bad = uploads.read_upload(spark, f"file://{tmp_path}/u.csv")
    assert [(r["institution_name"], r["row_no"]) for r in good.collect()] == [("A College", 2)]
    assert sorted(r["error"] for r in bad.collect()) == ["institution_name is longer than 512 characters", "institution_name is required"]
    (tmp_path / "v.csv").write_text("name\nx\n")
    with pytest.raises(ValueError):
        uploads.read_upload(spark, f"file://{tmp_path}/v.csv")


def test_tables_can_be_made(spark):
    uploads.create_tables(spark, "attestry_test")
    assert spark.table("attestry_test.evidence").columns[:3] == ["id", "run_id", "institution_id"]
    uploads.drop_tables(spark, "attestry_test")


def test_identity_graph(spark):
    schema = "id long, institution_id long, source string, external_id string, name_as_source string"
    links = spark.createDataFrame([(1, 10, "UGC", "a", "Alpha"), (2, 11, "UGC", "a", "Alpha U"), (3, 11, "INI", "b", "Alpha Inst")], schema)
    inst = spark.createDataFrame([(10,), (11,)], "id long")
    merges = spark.createDataFrame([(11, 10)], "from_id long, to_id long")
    out = I.merge_institutions(inst, links, spark.createDataFrame([(11, 5)], "institution_id long, run int"), merges, F.current_timestamp())
    assert [r["id"] for r in out["institutions"].collect()] == [10] and sorted(r["id"] for r in out["identities"].collect()) == [1, 3]
    assert out["runs"].first()["institution_id"] == 10 and out["audit_log"].count() == 1
    assert I.canonical_names(out["identities"]).first()["canonical_name"] == "Alpha Inst"
    assert {r["alias"] for r in I.aliases(out["identities"]).collect()} == {"Alpha", "Alpha Inst"}
    new = spark.createDataFrame([(9, 10, "UGC", "a", "Beta"), (8, 12, "UGC", "z", "Zeta")], schema)
    up = {r["institution_id"]: tuple(r) for r in I.upsert(links.filter("id = 1"), new, keep=["id"]).collect()}
    assert up == {10: (1, 10, "UGC", "a", "Beta"), 12: (8, 12, "UGC", "z", "Zeta")}
    assert I.insert_ignore(links, new, I.KEY).count() == 1
    filled = I.update_filled(spark.createDataFrame([(1, "a", "b")], "id long, x string, y string"), spark.createDataFrame([(1, "", "c")], "id long, x string, y string"), "id", ["x", "y"])
    assert tuple(filled.first()) == (1, "a", "c")


def slow_ends(steps):
    to = {}
    for a, b in steps:
        if a is not None and b is not None and a != b:
            to[a] = min(b, to.get(a, b))
    out = {}
    for start in to:
        path, at = [start], to[start]
        while at in to and at not in path:
            path.append(at)
            at = to[at]
        end = min(path[path.index(at) :]) if at in to else at
        if end != start:
            out[start] = end
    return out


@pytest.mark.parametrize("seed", range(4))
def test_chains_and_cycles_end(spark, seed):
    rng = random.Random(seed)
    n = [6, 30, 120, 120][seed]
    steps = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)] + [(None, 3), (3, None)]
    if seed == 3:
        steps = [(i, i + 1) for i in range(90)] + [(200 + i, 200 + (i + 1) % 64) for i in range(64)] + [(300 + i, 299 + i if i else 210) for i in range(20)]
    rows = chain_ends(spark.createDataFrame(steps, "from_id long, to_id long")).collect()
    assert {r["from_id"]: r["to_id"] for r in rows} == slow_ends(steps) and len(rows) == len(slow_ends(steps))
    assert chain_ends(spark.createDataFrame([], "from_id long, to_id long")).count() == 0


def test_merges_leave_no_reference_to_a_deleted_row(spark):
    inst = spark.range(1, 9)
    merges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4), (6, 6), (7, 99), (98, 1)], "from_id long, to_id long")
    links = spark.createDataFrame([(i, i, "UGC", "x") for i in range(1, 9)], "id long, institution_id long, source string, external_id string")
    out = I.merge_institutions(inst, links, links.select("institution_id", "id"), merges, F.current_timestamp())
    left = {r["id"] for r in out["institutions"].collect()}
    assert left == {3, 4, 6, 7, 8}
    assert {r["institution_id"] for r in out["runs"].collect()} == left and {(r["institution_id"], r["id"]) for r in out["identities"].collect()} == {(3, 1), (4, 4), (6, 6), (7, 7), (8, 8)}
    told = {r["entity_id"]: (r["before"], r["after"]) for r in out["audit_log"].collect()}
    assert told["1"] == ('{"id":1,"merged_into":3}', '{"id":3,"received_identities":true}') and set(told) == {"1", "2", "5"}


def test_a_snapshot_may_be_ingested_again(spark, tmp_path):
    store = G.RegistryStore(spark, f"file://{tmp_path}/mirror")
    first = [store.ingest(drafts(spark, 10), "UGC", 1, NOW) for _ in range(2)]
    assert first[0] == first[1] and store.entries.count() == 10 and store.log.count() == 2
    broken = drafts(spark, 11).withColumn("name", F.when(F.col("_pos") == 9, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        store.ingest(broken, "UGC", 2, NOW)
    assert G.published_entries(store.entries, store.log).count() == 10
    store._write(G.to_entries(drafts(spark, 40), "UGC", 2), "UGC", 2)  # rows that a lost attempt left behind
    again = [store.ingest(drafts(spark, 11), "UGC", 2, NOW) for _ in range(2)]
    assert again[0] == again[1] and again[0].state == "published" and again[0].added == 1
    assert store.entries.count() == 21 and G.published_entries(store.entries, store.log).count() == 11
    assert {r["id"]: r["state"] for r in G.latest_state(store.log).collect()} == {1: "published", 2: "published"}
