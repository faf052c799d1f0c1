from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from attestry.functions import scalars as X
from attestry.operators import evidence as E
from attestry.operators import scoring as P

NOW = dt.datetime(2024, 2, 1)
EVIDENCE = "id string, run_id string, kind string, source string, tier string, url string, quality_score double, confidence double, observed_at timestamp, institution_type string"


def item(i, run="r", kind="legitimacy", source="AISHE", tier="mirror", url="https://a.gov.in", q=1.0, days=0, kind_of="engineering"):
    return (str(i), run, kind, source, tier, url, q, 0.9, NOW - dt.timedelta(days=days), kind_of)


def scored(spark, items, conflicts=None):
    as_of = F.to_timestamp(F.lit("2024-02-01"))
    e = spark.createDataFrame(items, EVIDENCE)
    c = P.contributions(e, P.active_policies(P.default_policies(spark)), as_of)
    k = None if conflicts is None else spark.createDataFrame(conflicts, "run_id string, n_conflicts int")
    d = P.decide(P.score_runs(c, k), as_of)
    return {r["run_id"]: r for r in P.explain(d, c).collect()}


def test_fake_list_ends_the_scoring(spark):
    r = scored(spark, [item(1), item(2, source="UGC_FAKE")])["r"]
    assert (r["score"], r["verdict"], r["terminal_rule"]) == (0.0, "Fake", "UGC_FAKE")
    assert r["links"][0]["type"] == "terminal_rule" and r["remarks"] == ["named on the list of fakes"]
    r = scored(spark, [item(1), item(2, source="UGC_FAKE", kind="unavailable")])["r"]
    assert r["terminal_rule"] is None


def test_withdrawn_is_negative(spark):
    assert scored(spark, [item(1, source="WITHDRAWN_AUTHORITY")])["r"]["score"] == -0.5


def test_contribution_and_decay(spark):
    r = scored(spark, [item(1, q=0.5)])["r"]
    assert r["total_contribution"] == pytest.approx(0.8 * 0.5 * 1.0 * 0.5)
    old = scored(spark, [item(1, q=0.5, days=365)])["r"]
    assert old["total_contribution"] / r["total_contribution"] == pytest.approx(math.exp(-1))


def test_monotone_in_quality_and_age(spark):
    by_quality = scored(spark, [item(i, run=f"q{i}", q=i / 10) for i in range(11)])
    assert all(by_quality[f"q{i}"]["score"] < by_quality[f"q{i + 1}"]["score"] for i in range(10))
    by_age = scored(spark, [item(i, run=f"a{i}", days=100 * i) for i in range(8)])
    assert all(by_age[f"a{i}"]["score"] > by_age[f"a{i + 1}"]["score"] for i in range(7))


def test_bands_and_caps(spark):
    strong = [item(i) for i in range(8)]
    r = scored(spark, strong)["r"]
    assert r["verdict"] == "Genuine" and r["recheck_days"] == 365 and not r["needs_review"]
    api = scored(spark, [item(i, tier="api") for i in range(60)])["r"]
    assert api["verdict"] == "Likely Genuine" and api["remarks"] == ["no mirror or live item, so no higher verdict"]
    few = scored(spark, [item(1, tier="api")])["r"]
    assert few["insufficient_reasons"] == ["fewer than three items were found", "all items are of the api tier"] and few["verdict"] == "Likely Fake"
    torn = scored(spark, strong, [("r", 2)])["r"]
    assert torn["score"] == pytest.approx(0.8) and torn["needs_review"] and torn["confidence"] == pytest.approx(0.6 * 0.8)
    assert "Open conflicts: 2" in torn["summary"] and torn["verdict"] == "Likely Genuine"


def test_unavailable_counts_for_nothing(spark):
    r = scored(spark, [item(1, kind="unavailable")])["r"]
    assert r["score"] == 0 and r["n_available"] == 0 and r["n_evidence"] == 1


def test_policy_errors(spark):
    good = P.default_policies(spark)
    assert [r[0] for r in good.select(P.policy_errors()).collect()] == [[], []]
    bad = good.withColumn("weight_api", F.lit(2.0)).withColumn("threshold_fake", F.lit(0.9)).withColumn("expected_max", F.lit(0.0))
    assert len(bad.select(P.policy_errors()).first()[0]) == 3


def test_quality_values(spark):
    rows = [("mirror", "AISHE", "legitimacy", "https://x.gov.in", 0.0, 1.0), ("api", "WEBSITE", "contact", None, 400.0, 0.24 + 0.285 + 0.1 + 0.05), ("other", "X", "identity", "https://en.wikipedia.org", 8.0, 0.24 + 0.225 + 0.08 + 0.09)]
    got = spark.createDataFrame(rows, "t string, s string, c string, u string, a double, want double").select(E.quality(F.col("t"), F.col("s"), F.col("c"), F.col("u"), F.col("a")).alias("q"), "want").collect()
    assert all(r["q"] == pytest.approx(r["want"]) for r in got)


def test_stored_form_and_duplicates(spark):
    rows = [("r", 0, "contact", "u", "text", "long" * 30_000), ("r", 1, "contact", "u", "text", ""), ("r", 2, "contact", None, "text", "")]
    items = spark.createDataFrame(rows, "run_id string, _pos int, category string, url string, matched_text string, content string")
    stored = E.normalize(items, F.to_timestamp(F.lit("2024-02-01")))
    kept = {r["id"]: r for r in E.dedupe(stored).collect()}
    assert set(kept) == {"r-0", "r-2"} and kept["r-0"]["matched_text"] is None and kept["r-0"]["blob_key"].startswith("evidence/2024/02/")


def test_prefix_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([("r", i, s) for i, s in enumerate([50, 60, 10])], "run_id string, i int, size int")
    assert [r["i"] for r in E.capped_prefix(rows, "run_id", [F.col("i")], F.col("size"), 100).collect()] == [0]
    assert [r["i"] for r in E.capped_prefix(rows, "run_id", [F.col("i")], F.col("size"), 40).collect()] == [0]


def test_applicability(spark):
    ids = spark.createDataFrame([(1, "City Law College", "Delhi"), (2, "Model School", "Maharashtra")], "id int, canonical_name string, st string")
    got = {(r["id"], r["authority"]) for r in E.relevant_sources(ids, state="st").collect()}
    always = {"UGC_FAKE", "AISHE", "WIKIDATA", "WEBSITE", "NAD"}
    assert {a for i, a in got if i == 1} == always | {"BCI", "UGC"} and {a for i, a in got if i == 2} == always | {"CBSE", "CISCE", "NIOS"}
    pairs = spark.createDataFrame([("law", "BCI"), ("law", "NMC"), ("law", "NAD")], "k string, a string")
    assert [r[0] for r in pairs.select(E.is_applicable(F.col("k"), F.col("a"))).collect()] == [True, False, True]


def test_scalars(spark):
    one = spark.range(1).select(
        X.round_half_up(F.lit(-2.5)).alias("a"),
        X.decode_cursor(X.encode_cursor(F.lit(42))).alias("b"),
        X.decode_cursor(F.lit("??")).alias("c"),
        X.truncate_text(F.lit("hello wide world"), 12).alias("d"),
        X.redact_secrets(F.lit("api_key=abc x")).alias("e"),
        X.retry_after_seconds(F.lit("Thu, 01 Feb 2024 00:01:00 GMT"), F.to_timestamp(F.lit("2024-02-01"))).alias("f"),
        X.retry_after_seconds(F.lit("7"), F.to_timestamp(F.lit("2024-02-01"))).alias("g"),
        X.relative_age(F.to_timestamp(F.lit("2024-01-10")), F.to_timestamp(F.lit("2024-02-01"))).alias("h"),
        X.backoff_ms(F.lit(3)).alias("i"),
        X.strip_html(F.lit("<p>a&nbsp;&amp; b</p>\n c")).alias("j"),
        X.idempotency_key(F.lit("n"), F.to_date(F.lit("2024-02-01"))).alias("k"),
        X.format_percent(F.lit(0.256), 1).alias("l"),
        X.robots_disallowed(F.lit("User-agent: *\nDisallow: /a\nAllow: /\ndisallow: /b")).alias("m"),
    ).first()
    assert tuple(one) == (-2, 42, None, "hello wide…", "api_key=[REDACTED] x", 60, 7, "3w ago", 8000, "a & b c", "n:2024-02-01", "25.6%", ["/a", "/b"])
