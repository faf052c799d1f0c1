"""Evidence rows: quality, normal form, duplicates, groups, payloads, applicability, tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..functions import names as N
from ..functions import scalars as X
from ..functions import urls as U
from .matching import priority_first
from .running import running

BLOB_CHARS = 102_400
PAYLOAD_CHARS = 24 * 1024
STOP_SCORE = 0.85
TIERS = ["mirror", "api", "live"]


def tier_quality(tier: Column) -> Column:
    return reduce(lambda c, kv: c.when(tier == kv[0], F.lit(kv[1])), D.TIER_QUALITY.items(), F.when(F.lit(False), F.lit(0.0))).otherwise(D.TIER_QUALITY["api"])


def directness(source: Column, category: Column) -> Column:
    """How directly a source speaks: registries, then official sites, authorities, public sources, mentions."""
    return (
        F.when(source.isin(D.REGISTRY_SOURCES), 1.0)
        .when(source == "WEBSITE", F.when(category.isin("contact", "approval"), 0.95).otherwise(0.75))
        .when(source == "WIKIDATA", F.when(category == "identity", 0.4).otherwise(0.3))
        .when(source.isin(D.AUTHORITY_SOURCES), 0.9)
        .otherwise(0.75)
    )


def recency(age: Column) -> Column:
    out = F.when(age == D.RECENCY_STEPS[0][0], D.RECENCY_STEPS[0][1])
    for days, value in D.RECENCY_STEPS[1:]:
        out = out.when(age <= days, value)
    return out.otherwise(D.RECENCY_OLD)


def quality(tier: Column, source: Column, category: Column, url: Column, age: Column) -> Column:
    """0.4 tier, 0.3 directness, 0.2 domain, 0.1 recency."""
    return X.clamp(tier_quality(tier) * 0.4 + directness(source, category) * 0.3 + U.domain_authority(url) * 0.2 + recency(age) * 0.1)


def quality_with_confidence(score: Column, confidence: Column) -> Column:
    return score * 0.7 + X.truthy(confidence, 0.5) * 0.3


def quality_level(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def quality_rationale(tier: Column, source: Column, category: Column, url: Column, age: Column) -> Column:
    part = lambda name, value: F.concat(name, F.lit(": "), F.format_string("%.0f%%", value * 100))
    return F.concat_ws(" | ", part(F.concat(F.lit("Tier ("), tier, F.lit(")")), tier_quality(tier)), part(F.lit("Domain"), U.domain_authority(url)), part(F.lit("Directness"), directness(source, category)), part(F.lit("Recency"), recency(age)))


def normalize(items: DataFrame, as_of: Column) -> DataFrame:
    """Collected items (run_id, _pos, category, content, ...) as stored evidence: hash, and a blob key for long content,
    whose text is then left out."""
    content = F.coalesce("content", F.lit(""))
    digest = F.sha2(F.coalesce(F.nullif(F.col("matched_text"), F.lit("")), content), 256)
    long = F.length(content) > BLOB_CHARS
    return items.select(
        *[c for c in items.columns if c not in ("category", "content", "matched_text", "id", "content_hash", "blob_key", "created_at")],
        F.concat_ws("-", "run_id", F.col("_pos").cast("string")).alias("id"),
        F.col("category").alias("kind"),
        digest.alias("content_hash"),
        F.when(long, X.blob_key(digest, as_of)).alias("blob_key"),
        F.when(~long, F.col("matched_text")).alias("matched_text"),
        as_of.alias("created_at"),
    )


def dedupe(evidence: DataFrame, order: str = "_pos") -> DataFrame:
    """Of equal (run, kind, url, content hash) the first stays."""
    return priority_first(evidence, ["run_id", "kind", "url", "content_hash"], [F.col(order)])


def retain(evidence: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    return evidence.filter(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days)))


def group_counts(evidence: DataFrame, key: str = "run_id") -> DataFrame:
    """Per run: number by tier and by quality band, unavailable items, mean quality."""
    real = F.col("kind") != "unavailable"
    q = F.col("quality_score")
    return evidence.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in TIERS],
        F.count_if(real & (q >= 0.8)).alias("high"),
        F.count_if(real & (q >= 0.5) & (q < 0.8)).alias("medium"),
        F.count_if(real & (q < 0.5)).alias("low"),
        F.count_if(~real).alias("unavailable"),
        F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("avg_quality"),
    )


def collector_counts(evidence: DataFrame, key: str = "run_id") -> DataFrame:
    """Per run: items in all, by tier and by kind (0 where there are none), and the mean quality."""
    kinds = D.EVIDENCE_KINDS
    return evidence.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("tier") == t).alias(f"tier_{t}") for t in TIERS],
        *[F.count_if(F.col("kind") == k).alias(f"kind_{k}") for k in kinds],
        F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("avg_quality"),
    )


def group_lists(evidence: DataFrame, by: str, key: str = "run_id") -> DataFrame:
    """Evidence ids by run and ``by`` (kind, source or tier); a run's evidence is small."""
    return evidence.groupBy(key, by).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def legitimacy_score(evidence: DataFrame, key: str = "run_id") -> DataFrame:
    """Mean of quality times confidence over legitimacy and identity evidence, one at most."""
    return evidence.filter(F.col("kind").isin("legitimacy", "identity")).groupBy(key).agg(F.least(F.avg(F.col("quality_score") * X.truthy(F.col("confidence"), 0.5)), F.lit(1.0)).alias("legitimacy_score"))


def capped_prefix(rows: DataFrame, key: str, order: list[Column], size: Column, cap: int) -> DataFrame:
    """Rows of each key in order up to the first that would pass the cap; the first row always stays. Adds ``ref``.

    Sizes are not negative, so once the sum has passed the cap it stays above."""
    out = running(rows, [key], order, {"_no": F.lit(1), "_sum": size}).withColumn("_size", size)
    kept = out.filter((F.col("_no") == 0) | (F.col("_sum") + F.col("_size") <= cap))
    return kept.withColumn("ref", F.concat(F.lit("e"), (F.col("_no") + 1).cast("string"))).drop("_no", "_sum", "_size")


def llm_payload(evidence: DataFrame, key: str = "run_id", cap: int = PAYLOAD_CHARS) -> DataFrame:
    """One JSON payload a run: evidence by quality, tags stripped, as many items as fit the cap, and a summary.

    The mean is that of decimals, so it does not depend on the order of the items."""
    item = evidence.withColumn("text", X.strip_html(F.coalesce("matched_text", F.lit(""))))
    shown = F.struct("kind", "source", "tier", "text", F.col("quality_score").alias("quality"), "url")
    sized = item.withColumn("_item", F.to_json(shown))
    kept = capped_prefix(sized, key, [F.desc("quality_score"), F.col("id")], F.length("_item") + 2, cap)
    out = kept.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.substring("ref", 2, 9).cast("int").alias("n"), "ref", shown.alias("item")))).alias("evidence"),
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in TIERS],
        F.avg(F.col("quality_score").cast("decimal(18,9)")).cast("double").alias("avg_quality"),
        F.sum(F.length("_item") + 2).alias("chars"),
    )
    totals = evidence.groupBy(key).agg(F.count(F.lit(1)).alias("_all"))
    return out.join(totals, key).select(key, F.to_json("evidence").alias("payload"), "total", *[f"n_{t}" for t in TIERS], "avg_quality", X.token_estimate(F.col("chars")).alias("token_estimate"), (F.col("_all") > F.col("total")).alias("truncated"))


def payload_errors(payload: Column, quality_min: Column, quality_max: Column, cap: int = PAYLOAD_CHARS, refs: Column | None = None) -> Column:
    """What is wrong with a payload: tags in it, its size, its range of quality, and references that do not count e1, e2, ..."""
    tell = lambda bad, text: F.when(bad, F.lit(text))
    checks = [tell(F.rlike(payload, F.lit("(?i)<html|<!DOCTYPE")), "payload holds HTML"), tell(F.length(payload) > cap, "payload too large"), tell((quality_min < 0) | (quality_max > 1), "quality out of range")]
    if refs is not None:
        checks.append(tell(F.exists(F.transform(refs, lambda r, i: r != F.concat(F.lit("e"), (i + 1).cast("string"))), lambda wrong: wrong), "references out of order"))
    return F.array_compact(F.array(*checks))


# Applicability ----------------------------------------------------------------------------------------------


def authority_table(spark: SparkSession) -> DataFrame:
    """Authorities by institution type: (institution_type, authority, tier, rationale, pos), those always asked first."""
    rows = []
    for kind, own in D.TYPE_AUTHORITIES.items():
        for authority in D.ALWAYS_ASKED:
            rows.append((kind, authority, D.AUTHORITY_TIERS[authority], "asked for every type"))
        for authority in own:
            if authority not in D.ALWAYS_ASKED:
                rows.append((kind, authority, D.AUTHORITY_TIERS[authority], f"{authority} answers for {kind}"))
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "institution_type string, authority string, tier string, rationale string, pos int")


def relevant_sources(identities: DataFrame, name: str = "canonical_name", state: str | None = None) -> DataFrame:
    """Authorities to ask for each identity: ``identities`` plus institution_type, authority, tier, rationale.

    The table of authorities is fixed and tiny, hence broadcast. Schools get their state's board, unless it is there
    already."""
    typed = identities.withColumn("institution_type", N.infer_type(F.col(name)))
    out = typed.join(F.broadcast(authority_table(identities.sparkSession)), "institution_type")
    if state is None:
        return out.drop("pos")
    board = reduce(lambda c, b: c.when(F.contains(F.lower(state), F.lit(b[0])), F.lit(b[1])), D.STATE_BOARDS, F.when(F.lit(False), F.lit("")))
    extra = typed.filter("institution_type = 'school'").withColumn("authority", board).filter(F.col("authority").isNotNull() & ~F.col("authority").isin(D.ALWAYS_ASKED + D.TYPE_AUTHORITIES["school"]))
    extra = extra.withColumn("tier", F.lit("mirror")).withColumn("rationale", F.concat(F.lit("board of "), F.col(state)))
    return out.drop("pos").unionByName(extra)


def is_applicable(kind: Column, authority: Column) -> Column:
    pairs = [f"{k}/{a}" for k, own in D.TYPE_AUTHORITIES.items() for a in own]
    return authority.isin(D.ALWAYS_ASKED) | F.concat_ws("/", kind, authority).isin(pairs)


def mirror_evidence(identities: DataFrame, entries: DataFrame, as_of: Column) -> DataFrame:
    """Legitimacy evidence from published registry entries whose normal form is the identity's, for its authorities.

    ``identities`` has run_id, canonical_name, institution_type, authority, tier (as ``relevant_sources`` gives)."""
    asked = identities.filter("tier = 'mirror' OR tier = 'live'").withColumn("normalized_name", N.lookup_form(F.col("canonical_name")))
    held = entries.select(F.col("authority_code").alias("authority"), "normalized_name", "external_id", "canonical_name", "status", N.registry_url(F.col("attributes")).alias("url"))
    met = asked.drop("canonical_name").join(held, ["authority", "normalized_name"])
    return met.select("run_id", "institution_type", F.lit("legitimacy").alias("category"), F.col("authority").alias("source"), F.lit("mirror").alias("tier"), "url", F.col("canonical_name").alias("matched_text"), F.lit(0.9).alias("confidence"), as_of.alias("observed_at"), F.lit("").alias("content"))


def knowledge_evidence(found: DataFrame, source: str, as_of: Column) -> DataFrame:
    """Identity evidence of the api tier from entries of a knowledge base (``run_id``, ``item``, ``text``, ``url``)."""
    return found.select("run_id", F.lit("identity").alias("category"), F.lit(source).alias("source"), F.lit("api").alias("tier"), "url", F.col("text").alias("matched_text"), F.lit(0.6).alias("confidence"), as_of.alias("observed_at"), F.lit("").alias("content"))


def website_evidence(pages: DataFrame, as_of: Column) -> DataFrame:
    """Up to five items from an extracted page (``extract_pages``): e-mail, phone, affiliation, approval, title."""
    make = lambda cond, category, text, confidence, claim: F.when(cond, F.struct(F.lit(category).alias("category"), text.alias("matched_text"), F.lit(confidence).alias("confidence"), F.lit(claim).alias("claim_type")))
    items = F.array_compact(
        F.array(
            make(F.size("emails") > 0, "contact", F.get("emails", F.lit(0)), 0.9, None),
            make(F.size("phones") > 0, "contact", F.get("phones", F.lit(0)), 0.85, None),
            make(F.col("affiliation").isNotNull(), "affiliation", F.col("affiliation.snippet"), 0.75, "affiliated"),
            make(F.col("approval").isNotNull(), "approval", F.col("approval.snippet"), 0.8, "approved"),
            make(F.col("title").isNotNull(), "identity", F.col("title"), 0.7, None),
        )
    )
    keep = [c for c in ("run_id", "page_id", "institution_type") if c in pages.columns]
    return pages.select(*keep, "url", F.posexplode(items).alias("_pos", "_item")).select(*keep, "url", "_pos", "_item.*", F.lit("WEBSITE").alias("source"), F.lit("api").alias("tier"), as_of.alias("observed_at"))


def stop_tiers(evidence: DataFrame, key: str = "run_id", stop_score: float = STOP_SCORE) -> DataFrame:
    """Evidence that is gathered before the search stops: after the mirror tier if it holds a fake-list hit, before the
    live tier if mirror and api evidence reach the score. Means are of decimals, so that those that just reach the score do so
    in any order of the rows."""
    real = F.col("kind") != "unavailable"
    proof = F.col("kind").isin("legitimacy", "identity")
    facts = evidence.groupBy(key).agg(
        F.bool_or((F.col("source") == "UGC_FAKE") & (F.col("tier") == "mirror") & real).alias("_fake"),
        F.least(F.avg(F.when((F.col("tier") != "live") & proof, (F.col("quality_score") * X.truthy(F.col("confidence"), 0.5)).cast("decimal(20,12)"))).cast("double"), F.lit(1.0)).alias("_early"),
    )
    last = F.when(F.col("_fake"), 1).when(F.coalesce("_early", F.lit(0.0)) >= stop_score, 2).otherwise(3)
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    return evidence.join(facts.select(key, last.alias("_last")), key).filter(rank <= F.col("_last")).withColumn("stopped_after", F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("_last"))).drop("_last")
