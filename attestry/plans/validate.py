"""The flagship plan: names to resolved identities, evidence, scores, verdicts and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import scalars as X
from ..operators import evidence as E
from ..operators import matching as M
from ..operators import scoring as S
from ..session import saved, small


def fast_path(inputs: DataFrame, cached: DataFrame | None, institutions: DataFrame, entries: DataFrame, as_of: Column, text: str = "input") -> DataFrame:
    """What is known without search: a cached verdict, else a fresh institution, else a registry entry of the name.

    Each tier sees only what the ones before it left over. Rows (``normalized_name``, ``level``, ``verdict``)."""
    asked = inputs.select(N.lookup_form(F.col(text)).alias("normalized_name")).filter("normalized_name <> ''").distinct()
    parts, rest = [], asked
    if cached is not None:
        hit = rest.join(cached.groupBy("normalized_name").agg(F.min("verdict").alias("verdict")), "normalized_name")
        parts.append(hit.select("normalized_name", F.lit("L0").alias("level"), "verdict"))
        rest = rest.join(hit.select("normalized_name"), "normalized_name", "left_anti")
    fresh = institutions.filter("deleted_at IS NULL").filter(~X.is_stale(F.col("last_validated_at"), as_of))
    one = M.priority_first(fresh.select("normalized_name", "verdict", "id"), ["normalized_name"], [F.col("id")])
    parts.append(rest.join(one, "normalized_name").select("normalized_name", F.lit("L1").alias("level"), "verdict"))
    rest = rest.join(one.select("normalized_name"), "normalized_name", "left_anti")
    listed = entries.groupBy("normalized_name").agg(F.bool_or(F.col("authority_code") == "UGC_FAKE").alias("fake"))
    parts.append(rest.join(listed, "normalized_name").select("normalized_name", F.lit("L1.5").alias("level"), F.when(F.col("fake"), S.FAKE).otherwise(S.LIKELY_GENUINE).alias("verdict")))
    return M.union_all(parts)


def discover(inputs: DataFrame, cached: DataFrame, institutions: DataFrame, candidates: DataFrame, sites: DataFrame | None = None, limit: int = 5, text: str = "input") -> DataFrame:
    """Candidates of each name from the first level that settles it: (``input``, ``level``, ``type``, ``id``, ``name``,
    ``confidence``, ``band``, ``website``, ``rank``).

    A cached identity (``normalized_name``, ``id``, ``name``) settles a name (L0), and so does an institution of the same
    normal form (L1). The others are resolved against all candidates (L2) and merged, ``limit`` each. Bands: certain
    from 0.9, likely from 0.7, else doubtful; names that nothing fits have level none. ``sites`` (name, url) add the
    website of what was found."""
    asked = inputs.select(F.col(text).alias("input")).filter("input IS NOT NULL").distinct().withColumn("normalized_name", N.lookup_form(F.col("input")))
    known = cached.groupBy("normalized_name").agg(F.min(F.struct("id", "name")).alias("k")).select("normalized_name", "k.*")
    l0 = asked.join(known, "normalized_name").select("input", F.lit("L0").alias("level"), F.lit("institution").alias("type"), "id", "name", F.lit(1.0).alias("confidence"))
    rest = asked.join(l0.select("input"), "input", "left_anti")
    own = institutions.groupBy("normalized_name").agg(F.min(F.struct("id", "name")).alias("k")).select("normalized_name", "k.*")
    l1 = rest.join(own, "normalized_name").select("input", F.lit("L1").alias("level"), F.lit("institution").alias("type"), "id", "name", F.lit(1.0).alias("confidence"))
    rest = rest.join(l1.select("input"), "input", "left_anti")
    l2 = saved(M.resolve(rest, candidates, limit=limit).select("input", F.lit("L2").alias("level"), "type", "id", "name", "confidence"), "discovered")
    none = rest.join(l2.select("input").distinct(), "input", "left_anti").select("input", F.lit("none").alias("level"), *[F.lit(None).cast(t).alias(c) for c, t in (("type", "string"), ("id", "long"), ("name", "string"), ("confidence", "double"))])
    found = M.merge_candidates(M.union_all([l0, l1, l2]), ["input"], limit).unionByName(none.withColumn("rank", F.lit(1)))
    band = F.when(F.col("confidence") >= 0.9, "certain").when(F.col("confidence") >= 0.7, "likely").otherwise("doubtful")
    web = F.lit(None).cast("string")
    if sites is not None:
        found, web = found.join(sites.groupBy("name").agg(F.min("url").alias("_url")), "name", "left"), F.col("_url")
    return found.select("input", "level", "type", "id", "name", "confidence", band.alias("band"), web.alias("website"), "rank")


def validate(
    inputs: DataFrame,
    candidates: DataFrame,
    entries: DataFrame,
    policies: DataFrame,
    as_of: Column,
    pages: DataFrame | None = None,
    sites: DataFrame | None = None,
    manual: DataFrame | None = None,
    max_tier: str = "live",
    default_type: str = "engineering",
    text: str = "input",
) -> DataFrame:
    """One row per distinct input name with verdict, score, confidence, explanation and the identity it resolved to.

    ``pages`` (extracted) and ``sites`` (name, url) add website evidence. Types without a policy of their own use the
    one of ``default_type``. Evidence of tiers after ``max_tier``, or after the tier that settles the matter, is left
    out. Names that nothing resolves get verdict "Insufficient Evidence".
    """
    asked = inputs.select(F.col(text).alias("input")).filter("input IS NOT NULL").distinct().withColumn("run_id", F.sha2("input", 256))
    best = M.resolve(asked, candidates, manual).filter("rank = 1").select("input", "id", F.col("name").alias("canonical_name"), F.col("confidence").alias("match_confidence"), "method", F.col("needs_review").alias("match_review"))
    best = saved(best, "resolved")  # used three times below
    resolved = asked.join(best, "input")
    have = policies.filter("active").select("institution_type").distinct()
    relevant = E.relevant_sources(resolved)
    found = E.mirror_evidence(relevant, entries, as_of)
    typed = relevant.select("run_id", "institution_type", "canonical_name").distinct()
    if pages is not None and sites is not None:
        own = typed.join(sites, typed["canonical_name"] == sites["name"]).select("run_id", "institution_type", "url").join(pages, "url")
        found = M.union_all([found, E.website_evidence(own, as_of).drop("_pos").withColumn("content", F.lit(""))])
    tiers = E.TIERS[: E.TIERS.index(max_tier) + 1]
    items = found.filter(F.col("tier").isin(tiers)).withColumn("_pos", F.xxhash64("source", "category", "url", "matched_text"))
    scored = E.dedupe(E.normalize(items, as_of)).withColumn("quality_score", E.quality(F.col("tier"), F.col("source"), F.col("kind"), F.col("url"), X.age_days(F.col("observed_at"), as_of)))
    kept = E.stop_tiers(scored)
    policed = kept.join(small(have.withColumn("_own", F.lit(True))), "institution_type", "left").withColumn("institution_type", F.when(F.col("_own"), F.col("institution_type")).otherwise(default_type)).drop("_own")
    contributed = S.contributions(policed, S.active_policies(policies), as_of)
    decided = S.decide(S.score_runs(contributed), as_of)
    told = S.explain(decided, contributed).select("run_id", "verdict", "score", "confidence", F.col("needs_review").alias("verdict_review"), "terminal_rule", "n_evidence", "remarks", "summary", "sentences", "next_check_at")
    out = asked.join(best, "input", "left").join(told, "run_id", "left")
    return out.select(
        "input",
        "canonical_name",
        "match_confidence",
        "method",
        F.coalesce("verdict", F.lit("Insufficient Evidence")).alias("verdict"),
        "score",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce(F.col("verdict_review") | F.col("match_review"), F.lit(True)).alias("needs_review"),
        "terminal_rule",
        F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"),
        "summary",
        "sentences",
        "next_check_at",
    )
