"""Filling in what is known about institutions: cascades over sources, contacts, sites, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import similarity as S
from ..functions import urls as U
from .matching import priority_first

FIELDS = ["email", "phone", "website", "address", "state", "district", "pincode"]


def cascade(sources: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Per key, each field's first filled value in the order of sources."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = sources.select(key, order, *[F.first(F.nullif(F.col(f), F.lit("")), ignorenulls=True).over(w).alias(f) for f in fields])
    return priority_first(out, [key], [F.col(order)]).drop(order)


def is_complete() -> Column:
    """E-mail, phone and website are known, so a cascade can stop."""
    filled = lambda f: F.coalesce(F.col(f), F.lit("")) != ""
    return filled("email") & filled("phone") & filled("website")


def profile(entries: DataFrame, key: str = "normalized_name", order: str = "id", most: int = 5, compat: bool = True) -> DataFrame:
    """Profile from up to five registry entries of a name: the first gives the official name; of the other fields the last
    entry's value stands, even if null, or, without ``compat``, the last filled one."""
    w = Window.partitionBy(key).orderBy(order)
    few = entries.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    c = N.registry_contacts(F.col("attributes"))
    rows = few.select(key, "_n", "canonical_name", "type", "status", N.registry_url(F.col("attributes")).alias("website"), *[c[f].alias(f) for f in ("email", "phone", "address", "state", "district", "pincode")])
    pick = lambda f: F.max_by(f, F.col("_n")) if compat else F.max_by(f, F.when(F.col(f).isNotNull(), F.col("_n")))
    return rows.groupBy(key).agg(F.min_by("canonical_name", "_n").alias("official_name"), *[pick(f).alias(f) for f in ("type", "status", "website", "email", "phone", "address", "state", "district", "pincode")], F.count(F.lit(1)).alias("n_entries"))


def fill_from_page(profiles: DataFrame, pages: DataFrame, key: str = "website") -> DataFrame:
    """Missing fields from the extracted page of the profile's site: first e-mail, phone, address, then state and code."""
    p = pages.select(F.col("url").alias(key), F.get("emails", F.lit(0)).alias("_email"), F.get("phones", F.lit(0)).alias("_phone"), F.coalesce(F.get("addresses", F.lit(0)), F.col("detected_pin_code")).alias("_address"), F.col("detected_state").alias("_state"))
    p = priority_first(p, [key], [F.to_json(F.struct(*p.columns))])
    met = profiles.join(p, key, "left")
    fill = lambda f: F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"_{f}"))
    return met.select(*[fill(c).alias(c) if c in ("email", "phone", "address", "state") else F.col(c) for c in profiles.columns])


def entry_contacts(entries: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Contacts of registry entries, from their site where there is one, else from the entry: entry columns and fields."""
    base = entries.withColumn("website", N.registry_url(F.col("attributes"))).withColumn("_registry", N.registry_contacts(F.col("attributes")))
    none = F.lit(None).cast("string")
    if pages is None:
        web = F.struct(*[none.alias(f) for f in ("email", "phone", "address", "state", "district", "pincode")])
        out = base
    else:
        p = pages.select(F.col("url").alias("website"), F.struct(F.get("emails", F.lit(0)).alias("email"), F.get("phones", F.lit(0)).alias("phone"), F.get("addresses", F.lit(0)).alias("address"), F.col("detected_state").alias("state"), none.alias("district"), F.col("detected_pin_code").alias("pincode")).alias("_web"))
        p = priority_first(p, ["website"], [F.to_json("_web")])
        out, web = base.join(p, "website", "left"), F.col("_web")
    merged = out.withColumn("_c", N.merge_contacts(web, F.col("_registry")))
    return merged.select(*entries.columns, "website", "_c.*")


def first_match(left: DataFrame, right: DataFrame, on: str, order: str | list[str], columns: list[str], cond: Column | None = None) -> DataFrame:
    """Left rows with the columns of the first right row of equal key that meets the condition (null without one).

    ``order`` is a column or several; where it leaves ties open, which of them comes first may differ from run to run."""
    pool = right if cond is None else right.filter(cond)
    first = priority_first(pool.filter(F.col(on).isNotNull()), [on], [F.col(c) for c in ([order] if isinstance(order, str) else order)])
    return left.join(first.select(on, *columns), on, "left")


def link_to_institutions(contacts: DataFrame, institutions: DataFrame) -> DataFrame:
    """Entries with the id of the first institution of equal normal form."""
    return first_match(contacts, institutions.select("normalized_name", F.col("id").alias("institution_id")), "normalized_name", "institution_id", ["institution_id"])


def missing_sites(institutions: DataFrame, entries: DataFrame, limit: int = 100) -> DataFrame:
    """Institutions without a site, with the first address that a registry entry of their name gives."""
    with_url = entries.select("normalized_name", F.col("id").alias("entry_id"), N.registry_url(F.col("attributes")).alias("found_url")).filter("found_url IS NOT NULL")
    return first_match(institutions.filter("website IS NULL").orderBy("id").limit(limit), with_url, "normalized_name", "entry_id", ["found_url"]).filter("found_url IS NOT NULL")


def bulk_counts(contacts: DataFrame) -> DataFrame:
    """How many entries were processed, and how many got an e-mail, phone or address."""
    got = F.coalesce("email", "phone", "address").isNotNull()
    return contacts.agg(F.count(F.lit(1)).alias("processed"), F.count_if(got).alias("enriched"))


def contact_rows(profiles: DataFrame) -> DataFrame:
    """One row per contact of each institution: (institution_id, kind, value)."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("email", "phone", "website")])
    return profiles.select("institution_id", F.explode(kinds).alias("c")).select("institution_id", "c.kind", "c.value").filter("value IS NOT NULL AND value <> ''")


def document(parents: DataFrame, children: dict[str, tuple[DataFrame, str, list[str]]], key: str) -> DataFrame:
    """Parents with a list of structs for each child table: name -> (table, foreign key, columns). A parent's children
    are few; they are gathered per parent after one shuffle each."""
    out = parents
    for name, (table, foreign, columns) in children.items():
        lists = table.groupBy(F.col(foreign).alias(key)).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def discover_sites(institutions: DataFrame, pages: DataFrame, hits: DataFrame | None = None, least: float = 0.6, most: int = 8) -> DataFrame:
    """Official sites: guessed addresses (``most``) whose page title fits the name, in guessing order; else the first
    search hit (name, url, pos). Pages are matched by host."""
    guesses = institutions.select("id", "canonical_name", F.posexplode(F.slice(U.domain_guesses(F.col("canonical_name"), F.col("state")), 1, most)).alias("pos", "guess")).withColumn("host", U.host(F.col("guess")))
    titled = pages.select(U.host(F.col("url")).alias("host"), F.col("url"), "title").filter("host IS NOT NULL AND title IS NOT NULL")
    fit = guesses.join(titled, "host").withColumn("title_match", S.title_match(F.col("title"), F.col("canonical_name"))).filter(F.col("title_match") >= least)
    best = priority_first(fit, ["id"], [F.col("pos"), F.desc("title_match"), F.col("url")]).select("id", "url", "title_match")
    if hits is None:
        return best
    rest = institutions.join(best, "id", "left_anti").join(hits, institutions["canonical_name"] == hits["name"])
    return best.unionByName(priority_first(rest, ["id"], [F.col("pos")]).select("id", "url", F.lit(None).cast("double").alias("title_match")))


def depository_documents(institutions: DataFrame) -> DataFrame:
    """Documents and years of each depository row: total over kinds and years, sorted years."""
    years = institutions.select("name", F.explode("year_data").alias("kind", "by_year")).select("name", "kind", F.explode("by_year").alias("year", "n"))
    return years.groupBy("name").agg(F.sum("n").alias("total_documents"), F.sort_array(F.collect_set("year")).alias("years"), F.sort_array(F.collect_set("kind")).alias("kinds"))


def knowledge_lookup(names: DataFrame, items: DataFrame, types: list[str], limit: int = 10) -> DataFrame:
    """Items of a knowledge base whose label is the name and whose type is wanted; ``limit`` each, by item."""
    w = Window.partitionBy("name").orderBy("item")
    return names.join(items.filter(F.col("type").isin(types)), names["name"] == items["label"]).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")


def summary_lookup(names: DataFrame, articles: DataFrame) -> DataFrame:
    """The first article of each name with the first 200 characters of its text."""
    return first_match(names, articles.select(F.col("title").alias("name"), "pos", "description", F.substring("extract", 1, 200).alias("extract")), "name", "pos", ["description", "extract"])


def response_confidence(verdict: Column, contacts: list[Column], places: list[Column], n_authorities: Column) -> Column:
    """Confidence of a response: one half, more for the verdict, for known contacts and places, and for authorities."""
    share = lambda cols: sum((F.when(F.coalesce(c, F.lit("")) != "", 1).otherwise(0) for c in cols), F.lit(0)) / len(cols)
    bonus = F.when(verdict.isin("genuine", "Genuine"), 0.3).when(verdict.isin("likely_genuine", "Likely Genuine"), 0.2).when(verdict.isin("NEEDS_REVIEW", "Needs Review"), 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), F.lit(0.5) + bonus + share(contacts) * 0.1 + share(places) * 0.1 + F.least(F.lit(0.1), F.coalesce(n_authorities, F.lit(0)) * 0.05))


def first_known(asked: DataFrame, key: str, sources: list[tuple[str, DataFrame]], last: str) -> DataFrame:
    """``asked`` with ``fact`` from the first of the sources (key, fact) that knows the key, and its name in ``known_by``;
    keys that none knows are kept under ``last``. Of several facts of one source the smallest counts."""
    out = asked
    for i, (_, table) in enumerate(sources):
        out = out.join(table.groupBy(key).agg(F.min("fact").alias(f"_fact{i}"), F.lit(True).alias(f"_has{i}")), key, "left")
    known, fact = F.lit(last), F.lit(None)
    for i, (name, _) in reversed(list(enumerate(sources))):
        known, fact = F.when(F.col(f"_has{i}"), F.lit(name)).otherwise(known), F.when(F.col(f"_has{i}"), F.col(f"_fact{i}")).otherwise(fact)
    return out.select(*asked.columns, known.alias("known_by"), fact.alias("fact"))


def site_override(profiles: DataFrame, entries: DataFrame, key: str = "normalized_name") -> DataFrame:
    """Profiles whose site is replaced by the first address that a registry entry of the name gives."""
    listed = entries.select(key, F.col("id").alias("_id"), N.registry_url(F.col("attributes")).alias("_url")).filter("_url IS NOT NULL")
    first = listed.groupBy(key).agg(F.min_by("_url", "_id").alias("_url"))
    return profiles.join(first, key, "left").withColumn("website", F.coalesce("_url", "website")).drop("_url")


def saved_profiles(profiles: DataFrame, as_of: Column, days: int = 180, most: int = 5) -> dict[str, DataFrame]:
    """What is kept of enriched profiles (``id``, ``canonical_name``, contacts, ``source``): institutions with a slug and the
    time until which they are valid, up to ``most`` contacts each, and one identity per source. Profiles that a
    language model made up (source LLM) are not kept."""
    real = profiles.filter("source <> 'LLM'")
    first = priority_first(real, ["id"], [F.col("source")])
    institutions = first.select("id", "canonical_name", N.slug(F.col("canonical_name")).alias("slug"), (as_of + F.make_dt_interval(F.lit(days))).alias("valid_until"))
    rows = contact_rows(real.withColumnRenamed("id", "institution_id")).distinct()
    few = Window.partitionBy("institution_id").orderBy("kind", "value")
    contacts = rows.withColumn("_n", F.row_number().over(few)).filter(F.col("_n") <= most).drop("_n")
    identities = real.groupBy(F.col("id").alias("institution_id"), "source").agg(F.min("canonical_name").alias("name_as_source"))
    return {"institutions": institutions, "contacts": contacts, "identities": identities}
