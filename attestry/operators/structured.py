"""Answers of a language model as typed rows: schemas, checks, and the prompts that ask for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.contacts import EMAIL

# Fields of the two answers. Fields of facts name the evidence that they rest on in ``...Refs``.
ADDRESS = "STRUCT<street: STRING, city: STRING, state: STRING, postal_code: STRING, country: STRING, sourceRefs: ARRAY<STRING>>"
CONTACTS = "STRUCT<emails: ARRAY<STRING>, phones: ARRAY<STRING>, website: STRING, sourceRefs: ARRAY<STRING>>"
SOCIAL = "STRUCT<facebook: STRING, twitter: STRING, linkedin: STRING, youtube: STRING, instagram: STRING, sourceRefs: ARRAY<STRING>>"
CITED = {
    "officialName": "STRING",
    "aliases": "ARRAY<STRING>",
    "institutionType": "STRING",
    "establishedYear": "INT",
    "website": "STRING",
    "affiliatedTo": "ARRAY<STRING>",
    "approvals": "ARRAY<STRING>",
    "accreditations": "ARRAY<STRING>",
    "conflicts": "ARRAY<STRING>",
}
FACTS = ", ".join([f"{f} {t}, {f}Refs ARRAY<STRING>" for f, t in CITED.items()] + [f"address {ADDRESS}, contacts {CONTACTS}, socialLinks {SOCIAL}, extractedAt DOUBLE, confidence DOUBLE"])
JUDGMENT = "keyFindings ARRAY<STRING>, contradictions ARRAY<STRING>, missingEvidence ARRAY<STRING>, reasoning STRING, redFlags ARRAY<STRING>, judgedAt DOUBLE"
REASONING_CHARS = 1200
PROMPT_CHARS = 200
URL = r"^https?://[^\s/$.?#].[^\s]*$"


def _told(bad: Column, text: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.lit(text))


def _bad_url(col: Column) -> Column:
    return col.isNotNull() & ~F.rlike(col, F.lit(URL))


def read_facts(answers: DataFrame, col: str = "answer", refs: Column | None = None) -> DataFrame:
    """``answers`` plus ``facts`` (null if the answer does not parse) and ``errors``: required fields, addresses, range of
    the confidence, and, with the known ``refs``, citations of evidence that does not exist."""
    out = answers.withColumn("facts", F.from_json(col, FACTS, {"mode": "PERMISSIVE"}))
    f = lambda name: F.col(f"facts.{name}")
    urls = [f("website"), f("contacts.website"), *[f(f"socialLinks.{p}") for p in ("facebook", "twitter", "linkedin", "youtube", "instagram")]]
    cited = F.array_distinct(F.flatten(F.array(*[F.coalesce(f(c), F.array().cast("array<string>")) for c in [*[f"{n}Refs" for n in CITED], "address.sourceRefs", "contacts.sourceRefs", "socialLinks.sourceRefs"]])))
    checks = [
        _told(F.col("facts").isNull() | (f("officialName").isNull() & f("extractedAt").isNull()), "no facts"),
        _told(f("officialName").isNull() | f("officialNameRefs").isNull(), "officialName"),
        _told(f("extractedAt").isNull(), "extractedAt"),
        _told(f("confidence").isNull() | ~f("confidence").between(0, 1), "confidence"),
        _told(f("address").isNotNull() & f("address.city").isNull(), "address"),
        _told(F.exists(F.coalesce(f("contacts.emails"), F.array().cast("array<string>")), lambda e: ~F.rlike(e, F.lit(f"^{EMAIL}$"))), "emails"),
        _told(F.exists(F.array(*urls), lambda u: F.coalesce(_bad_url(u), F.lit(False))), "urls"),
    ]
    if refs is not None:
        checks.append(_told(F.size(F.array_except(cited, refs)) > 0, "refs"))
    return out.withColumn("errors", F.array_compact(F.array(*checks)))


def read_judgment(answers: DataFrame, col: str = "answer") -> DataFrame:
    """``answers`` plus ``judgment`` and ``errors``: required fields and the length of the reasoning."""
    out = answers.withColumn("judgment", F.from_json(col, JUDGMENT, {"mode": "PERMISSIVE"}))
    j = lambda name: F.col(f"judgment.{name}")
    checks = [_told(j("keyFindings").isNull(), "keyFindings"), _told(j("reasoning").isNull() | (F.length(j("reasoning")) > REASONING_CHARS), "reasoning"), _told(j("judgedAt").isNull(), "judgedAt")]
    return out.withColumn("errors", F.array_compact(F.array(*checks)))


def evidence_line(ref: Column, source: Column, tier: Column, quality: Column, text: Column, url: Column) -> Column:
    """One item of evidence as a prompt shows it; texts are cut at ``PROMPT_CHARS`` characters."""
    shown = F.when(F.length(text) > PROMPT_CHARS, F.concat(F.substring(text, 1, PROMPT_CHARS), F.lit("…"))).otherwise(text)
    part = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{name}: "), value))
    head = F.concat(ref, F.lit(" from "), source, F.lit(", tier "), tier, F.lit(", quality "), F.format_string("%.0f%%", quality * 100))
    return F.concat_ws("\n", head, part("text", shown), part("url", url))


def prompts(evidence: DataFrame, names: DataFrame, key: str = "run_id") -> DataFrame:
    """One prompt a run: the institution's name and its numbered evidence. ``evidence`` is what fits a payload
    (``capped_prefix``), so a run's list is bounded."""
    line = evidence_line(F.col("ref"), F.col("source"), F.col("tier"), F.col("quality_score"), F.col("text"), F.col("url"))
    no = F.substring("ref", 2, 9).cast("int")
    lists = evidence.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(no.alias("n"), line.alias("line")))), lambda x: x["line"]), "\n\n").alias("lines"))
    ask = F.concat(F.lit("Give the facts about "), F.col("name"), F.lit(" that the evidence below states, each with the numbers it rests on.\n\n"), F.col("lines"))
    return names.join(lists, key).select(key, ask.alias("prompt"))
