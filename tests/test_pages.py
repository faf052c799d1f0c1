from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from attestry import dictionaries as D
from attestry.functions import contacts as C
from attestry.functions import html as H
from attestry.functions import urls as U
from attestry.operators import enrichment as R
from attestry.operators import evidence as E

PAGE = """<html><head><title>Plain</title><meta property="og:title" content="Best College"><meta name="description" content="About us">
<script type="application/ld+json">{"@type": "College"}</script><script type="application/ld+json">{bad</script></head><body>
<nav><a href="/home">Home</a></nav><h1>Best <b>College</b></h1><main>Affiliated to Anna University, Chennai. Approved by AICTE. Located in Pune, Maharashtra 411001.
<div class="address">12 Long Road, Pune</div><a href="https://facebook.com/best">Face</a><a href="/about">About</a><a href="https://other.org/x">Other</a></main>
<footer><a href="https://x.com/best">X</a> info@best.ac.in +91 9876543210 022-2576-7086</footer></body></html>"""


@pytest.fixture(scope="module")
def page(spark):
    rows = [("https://best.ac.in/", PAGE), ("https://spa.example/", '<div id="root"></div>'), (None, None)]
    return {r["url"]: r for r in H.extract_pages(spark.createDataFrame(rows, "url string, html string")).collect()}


def test_page_record(page):
    p = page["https://best.ac.in/"]
    assert (p["title"], p["description"], p["headings"]) == ("Best College", "About us", ["Best College"])
    assert p["emails"] == ["info@best.ac.in"] and p["phones"] == ["+919876543210", "+912225767086"]
    assert p["addresses"] == ["12 Long Road, Pune"] and p["detected_state"] == "maharashtra" and p["detected_pin_code"] == "411001"
    assert p["affiliation"]["text"] == "Anna University" and p["approval"]["text"].startswith("AICTE") and p["affiliation"]["snippet"].startswith("Affiliated to")
    assert [s["platform"] for s in p["social_links"]] == ["facebook"]  # the footer is gone by then
    assert [(x["url"], x["type"]) for x in p["outbound_links"]] == [("https://facebook.com/best", "external"), ("https://best.ac.in/about", "internal"), ("https://other.org/x", "external")]
    assert p["json_ld"] == ['{"@type": "College"}'] and p["meta_tags"]["description"] == "About us" and not p["needs_javascript"]


def test_script_pages_and_nulls(page):
    assert page["https://spa.example/"]["needs_javascript"] and page[None]["main_text"] == "" and page[None]["emails"] == []


def values(spark, texts, fn):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(fn(F.col("t"))).collect()]


def test_phones(spark):
    raw = ["9876543210", "+91-9876543210", "098765 43210", "02225767086", "0222576708", "2225767086", "12345", "5876543210", "911234567890"]
    assert values(spark, raw, C.normalize_phone) == ["+919876543210", "+919876543210", "+919876543210", "+912225767086", "+91222576708", "+912225767086", "", "", "+911234567890"]


def test_places(spark):
    assert values(spark, ["pin 012345 and 411001", "x 560001.", "1234567"], C.pin_code) == [None, "560001", None]
    assert values(spark, ["Goa first. Our campus is in Kerala", "punjab" + " x" * 400, None], C.detect_state) == ["kerala", "punjab", None]  # of several states nearby, the first in the list


def test_urls(spark):
    assert values(spark, ["a.gov.in", "b.ac.in", "c.edu", "d.nic.in", "shodhganga.org", "x.com", "en.wikipedia.org", "foo.blogspot.com", None], U.domain_priority) == [1000, 800, 600, 400, 500, 100, -100, -100, 0]
    assert values(spark, ["https://x.ac.in/", "https://x.ac.in/alumni", "https://library.x.in", "https://x.in/a/b/c", "nonsense"], U.is_main_site) == [True, False, False, False, True]
    assert values(spark, ["10.1.2.3", "172.20.0.1", "172.32.0.1", "8.8.8.8", "::1", "fd00::1"], U.is_private_ip) == [True, True, False, False, True, True]
    assert values(spark, ["Anna University"], lambda c: U.domain_guesses(c, F.lit("Tamil Nadu")))[0][:4] == ["https://au.edu.in", "https://au.ac.in", "https://www.au.edu.in", "https://autamil.edu.in"]
    assert len(values(spark, ["X"], U.query_templates)[0]) == 9


def test_site_discovery(spark):
    inst = spark.createDataFrame([(1, "Anna University", "Tamil Nadu"), (2, "Nowhere Hall", None)], "id int, canonical_name string, state string")
    pages = spark.createDataFrame([("https://au.ac.in/", "Anna University Chennai"), ("https://au.edu.in/", "Other")], "url string, title string")
    hits = spark.createDataFrame([("Nowhere Hall", "https://b", 2), ("Nowhere Hall", "https://a", 1)], "name string, url string, pos int")
    got = {r["id"]: (r["url"], r["title_match"]) for r in R.discover_sites(inst, pages, hits).collect()}
    assert got == {1: ("https://au.ac.in/", 0.85), 2: ("https://a", None)}


def test_pin_code_has_ascii_borders(spark):
    rows = spark.createDataFrame([("PIN é560001",), ("id_560001 then 560002",), ("5600011",), ("060001",), (None,)], "t string")
    assert [r[0] for r in rows.select(C.pin_code(F.col("t"))).collect()] == ["560001", "560002", None, None, None]


def long_page(words):
    """What a page tells comes after ``words`` words of its main text."""
    return f"<html><body><article>{'word ' * words}Affiliated to Anna University, approved by AICTE. Located in Kerala 560001. Last words</article></body></html>"


def test_claims_far_into_a_page(spark):
    pages = spark.createDataFrame([(i, "https://a.in/", long_page(n)) for i, n in enumerate([0, 1630, 1640, 200_000])], "page_id int, url string, html string")
    told = {(r["page_id"], r["claim_type"]): r["matched_text"] for r in E.website_evidence(H.extract_pages(pages), F.current_timestamp()).collect()}
    assert set(told) == {(i, c) for i in range(4) for c in ("affiliated", "approved")}
    assert all("Affiliated to Anna University, approved by AICTE. Located" in text for text in told.values())
    assert told[3, "affiliated"] == "word " * 10 + "Affiliated to Anna University, approved by AICTE. Located in Kerala 560001. Las"


def test_fields_far_into_a_page(spark):
    counts = [0, 1630, 1640, 200_000]
    pages = spark.createDataFrame([(i, "https://a.in/", long_page(n)) for i, n in enumerate(counts)], "page_id int, url string, html string")
    rows = H.extract_pages(pages).select("page_id", "main_text", "detected_state", "detected_pin_code", "affiliation.text").collect()
    assert {r[0]: r[1] for r in rows} == {i: re.search("<article>(.*)</article>", long_page(n))[1] for i, n in enumerate(counts)}
    assert {tuple(r[2:]) for r in rows} == {("kerala", "560001", "Anna University")}


def test_states_near_words_for_places(spark):
    rng = random.Random(3)

    def text():
        parts = [*D.PAGE_STATES[:6], *(w.upper() if rng.random() < 0.5 else w for w in D.LOCATION_WORDS), "\u0130", "\U0001f600", "\n", "\u2028"]
        return "".join(rng.choice(parts) + rng.choice("x. ") * rng.choice([0, 1, 40, 99, 100, 101, 150, 199, 200, 201, 300, 700]) for _ in range(rng.randint(1, 12)))

    def expected(t):
        held = lambda c: next((s for s in D.PAGE_STATES if s in c.lower()), None)
        around = [c for w in D.LOCATION_WORDS for c in re.findall(f"(?ai)[^\n\r\x85\u2028\u2029]{{0,100}}{w}[^\n\r\x85\u2028\u2029]{{0,100}}", t)]
        return next(filter(None, map(held, around)), None) or held(t.lower()[:500]) or held(t)

    texts = [text() for _ in range(2000)]
    assert values(spark, texts, C.detect_state) == [expected(t) for t in texts]
