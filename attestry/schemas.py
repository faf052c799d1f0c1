"""Schemas of stored tables, parsed registry rows, evidence and events."""

from __future__ import annotations

#: Tables, in Spark DDL.
SCHEMAS = {
    "institutions": "id LONG NOT NULL, canonical_name STRING, normalized_name STRING, slug STRING, type STRING, state STRING, district STRING, pincode STRING, address STRING, website STRING, lat FLOAT, lng FLOAT, parent_institution_id LONG, verdict STRING, confidence FLOAT, policy_id LONG, first_validated_at TIMESTAMP, last_validated_at TIMESTAMP, valid_until TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP, deleted_at TIMESTAMP",
    "institution_identities": "id LONG NOT NULL, institution_id LONG, source STRING, external_id STRING, name_as_source STRING, normalized_name STRING, match_score FLOAT, match_method STRING, created_at TIMESTAMP",
    "institution_contacts": "id LONG NOT NULL, institution_id LONG, kind STRING, value STRING, verified_at TIMESTAMP",
    "institution_links": "id LONG NOT NULL, institution_id LONG, platform STRING, url STRING, title STRING",
    "authorities": "authority_code STRING NOT NULL, display_name STRING, website STRING, data_url STRING, rank INT",
    "registry_snapshots": "id LONG NOT NULL, authority_code STRING, state STRING, seq LONG, row_count LONG, published_count LONG, validation_report STRING, error_message STRING, started_at TIMESTAMP, completed_at TIMESTAMP, valid_to TIMESTAMP, created_at TIMESTAMP",
    "registry_entries": "id LONG, authority_code STRING, snapshot_id LONG, external_id STRING, canonical_name STRING, normalized_name STRING, type STRING, status STRING, attributes MAP<STRING,STRING>",
    "entry_draft": "external_id STRING, name STRING, city STRING, state STRING, affiliated_university STRING, website STRING, email STRING, phone_number STRING, raw_data MAP<STRING,STRING>",
    "validation_runs": "id LONG NOT NULL, institution_id LONG, input_name STRING, input_university STRING, trigger STRING, state STRING, verdict STRING, confidence FLOAT, score_breakdown STRING, policy_id LONG, prompt_version STRING, snapshot_ids STRING, embedding_space STRING, code_version STRING, started_at TIMESTAMP, finished_at TIMESTAMP, duration_ms LONG, cost_usd FLOAT, error STRING, created_at TIMESTAMP",
    "run_steps": "id LONG NOT NULL, run_id LONG, seq INT, name STRING, status STRING, started_at TIMESTAMP, duration_ms LONG, cache_hit INT, provider STRING, attempt INT, error STRING",
    "evidence": "id STRING NOT NULL, run_id STRING, institution_id LONG, kind STRING, source STRING, tier STRING, url STRING, matched_text STRING, blob_key STRING, content_hash STRING, quality_score DOUBLE, confidence DOUBLE, observed_at TIMESTAMP, snapshot_date TIMESTAMP, claim_type STRING, metadata MAP<STRING,STRING>, created_at TIMESTAMP, updated_at TIMESTAMP",
    "llm_calls": "id LONG NOT NULL, run_id LONG, stage STRING, model STRING, prompt_hash STRING, tokens_in LONG, tokens_out LONG, latency_ms LONG, cost_usd DOUBLE, cache_hit BOOLEAN, repaired BOOLEAN, error STRING",
    "batches": "id LONG NOT NULL, name STRING, state STRING, total LONG, succeeded LONG, failed LONG, created_at TIMESTAMP",
    "batch_items": "id LONG NOT NULL, batch_id LONG, row_no LONG, input_name STRING, input_university STRING, state STRING, run_id LONG, error STRING, attempts INT",
    "dead_letters": "id LONG NOT NULL, kind STRING, payload STRING, error STRING, attempts INT, last_attempt_at TIMESTAMP, resolved_at TIMESTAMP",
    "provider_health": "provider STRING NOT NULL, state STRING, failures INT, opened_at TIMESTAMP, last_success_at TIMESTAMP, p50_ms DOUBLE, p95_ms DOUBLE, engine_failures STRING",
    "metrics_hourly": "hour TIMESTAMP, tier STRING, verdict STRING, count LONG, p50_ms DOUBLE, p95_ms DOUBLE, cache_hits LONG, cost_usd DOUBLE",
    "audit_log": "id LONG, actor STRING, action STRING, entity STRING, entity_id STRING, before STRING, after STRING, reason STRING, at TIMESTAMP",
    "feature_flags": "key STRING NOT NULL, value INT",
    "embedding_spaces": "model_name STRING NOT NULL, dimensions INT, is_active BOOLEAN",
    "policies": "id STRING NOT NULL, name STRING, institution_type STRING, version INT, active BOOLEAN, weight_mirror DOUBLE, weight_api DOUBLE, weight_live DOUBLE, weight_legitimacy DOUBLE, weight_identity DOUBLE, weight_contact DOUBLE, weight_affiliation DOUBLE, weight_approval DOUBLE, weight_gov_in DOUBLE, weight_ac_in DOUBLE, weight_edu_in DOUBLE, weight_aggregator DOUBLE, evidence_half_life_days DOUBLE, fake_list_score DOUBLE, withdrawn_authority_score DOUBLE, threshold_genuine DOUBLE, threshold_likely_genuine DOUBLE, threshold_likely_fake DOUBLE, threshold_fake DOUBLE, recheck_interval_days INT, recheck_interval_high_risk_days INT, expected_max DOUBLE",
    "pages": "page_id LONG, url STRING, html STRING",
}


def fields(name: str) -> list[str]:
    """Column names of a table."""
    return [part.split(" ")[0] for part in SCHEMAS[name].split(", ")]


#: Payloads of the typed events.
EVENT_PAYLOADS = {
    "validation/requested": "normalizedName STRING, inputVariant STRING, tags ARRAY<STRING>, maxTier STRING, priority STRING",
    "validation/completed": "runId STRING, normalizedName STRING, verdict STRING, score DOUBLE, confidence DOUBLE, validationRunId LONG, duration LONG, tierReachedAt STRING",
    "validation/failed": "runId STRING, normalizedName STRING, error STRING, code STRING, stage STRING, retryCount INT",
    "batch/created": "batchId LONG, institutionCount LONG, source STRING, createdAt STRING",
    "batch/item.queued": "batchId LONG, itemId LONG, normalizedName STRING",
    "registry/ingest.requested": "authority STRING, since STRING",
    "revalidation/due": "institutionId LONG, normalizedName STRING, verdict STRING",
    "deadletter/retry": "deadLetterId LONG, kind STRING, attempts INT",
}
REQUIRED_FIELDS = {
    "validation/requested": ["normalizedName"], "validation/completed": ["runId", "normalizedName", "verdict"], "validation/failed": ["normalizedName", "error"],
    "batch/created": ["batchId", "institutionCount"], "batch/item.queued": ["batchId", "normalizedName"], "registry/ingest.requested": ["authority"],
    "revalidation/due": ["normalizedName"], "deadletter/retry": ["deadLetterId"],
}
