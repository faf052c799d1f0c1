"""Addresses of pages: hosts, authority and priority scores, main sites, guesses, private networks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dictionaries as D


def host(url: Column) -> Column:
    """Lower-cased host, null if the text is no address."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def domain_authority(url: Column) -> Column:
    """Score of the first part in the list that occurs anywhere in the address."""
    text = F.lower(url)
    out = F.when(F.coalesce(url, F.lit("")) == "", F.lit(D.DOMAIN_AUTHORITY_DEFAULT))
    for part, score in D.DOMAIN_AUTHORITY:
        out = out.when(F.contains(text, F.lit(part)), F.lit(score))
    return out.when(F.endswith(text, F.lit(".gov")), F.lit(1.0)).otherwise(F.lit(D.DOMAIN_AUTHORITY_DEFAULT))


def domain_priority(domain: Column) -> Column:
    """Priority for search results: aggregators lowest, government highest; null and empty hosts 0."""
    d = F.lower(domain)
    listed = []
    for entry in D.AGGREGATORS:
        listed.append(F.endswith(d, F.lit(entry[2:])) if entry.startswith("*.") else (d == entry) | F.endswith(d, F.lit("." + entry)))
    ends = lambda *parts: reduce(lambda a, b: a | b, [F.endswith(d, F.lit(p)) for p in parts])
    holds = lambda *parts: reduce(lambda a, b: a | b, [F.contains(d, F.lit(p)) for p in parts])
    return (
        F.when(F.coalesce(domain, F.lit("")) == "", 0)
        .when(reduce(lambda a, b: a | b, listed), -100)
        .when(ends(".gov.in"), 1000)
        .when(ends(".ac.in"), 800)
        .when(ends(".edu.in", ".edu"), 600)
        .when(ends(".nic.in"), 400)
        .when(holds("shodhganga", "aicte", "ugc.ac.in", "naac.gov.in"), 500)
        .otherwise(100)
    )


def _path_parts(url: Column) -> Column:
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.filter(F.split(path, "/"), lambda p: p != "")


def is_main_site(url: Column) -> Column:
    """No side page in the path or as sub-domain, and at most two path parts. What is no address passes."""
    path, name = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))), host(url)
    side = "|".join(D.SIDE_PAGES)
    return F.when(name.isNull(), True).otherwise(~F.rlike(path, F.lit(f"/({side})")) & ~F.rlike(name, F.lit(rf"^({side})\.")) & (F.size(_path_parts(url)) <= 2))


def site_priority(url: Column) -> Column:
    """Fewer host labels, then shorter paths, first."""
    return F.size(F.split(host(url), r"\.")) * -10 - F.size(_path_parts(url))


def domain_guesses(name: Column, state: Column) -> Column:
    """Likely addresses of an institution's site from its initials (five at most), its state and its first word."""
    low = F.trim(F.lower(name))
    initials = F.array_join(F.regexp_extract_all(low, F.lit(r"(?<![A-Za-z0-9_])([A-Za-z0-9_])"), F.lit(1)), "")
    area = F.element_at(F.split(F.lower(state), r"\s+"), 1)
    first = F.element_at(F.split(low, r"\s+"), 1)
    short = F.length(initials).between(1, 5)
    long = F.length(first) > 2
    some = lambda cond, *parts: F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    both = short & (F.coalesce(state, F.lit("")) != "")
    guesses = [
        some(short, "https://", initials, ".edu.in"),
        some(short, "https://", initials, ".ac.in"),
        some(short, "https://www.", initials, ".edu.in"),
        some(both, "https://", initials, area, ".edu.in"),
        some(both, "https://www.", initials, area, ".edu.in"),
        some(long, "https://", first, ".edu.in"),
        some(long, "https://www.", first, ".edu.in"),
    ]
    return F.array_compact(F.array(*guesses))


def is_private_ip(ip: Column) -> Column:
    """Loopback, private, link-local and unspecified networks, version 4 and 6."""
    return F.rlike(F.lower(ip), F.lit(r"^(127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2\d|3[01])\.)|^(::1$|::$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)"))


#: Label, priority and text of the search queries; NAME stands for the institution's name.
QUERY_TEMPLATES = [
    ("official-site", "high", 'site:ac.in OR site:edu.in "NAME" official website'),
    ("approval-status", "high", '"NAME" "approved by" "AICTE" OR "UGC" OR "NAAC"'),
    ("fake-warning", "high", '"NAME" "fake" OR "spurious" OR "not recognized"'),
    ("affiliation", "medium", '"NAME" "affiliated to" OR "affiliated with"'),
    ("location", "medium", '"NAME" location address contact'),
    ("digilocker", "medium", '"NAME" digilocker registry'),
    ("news", "low", '"NAME" news announcement'),
    ("board", "low", '"NAME" board governance'),
    ("social", "low", '"NAME" facebook OR twitter OR linkedin'),
]


def query_templates(name: Column) -> Column:
    """Search queries as (label, priority, query), high priority first."""
    return F.array(*[F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.replace(F.lit(text), F.lit("NAME"), name).alias("query")) for label, priority, text in QUERY_TEMPLATES])
