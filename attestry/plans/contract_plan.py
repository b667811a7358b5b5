"""Queries of the stricter suite. The tables are derived with faults in many rows; the SQL evaluates the rules on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestry.operators import contract as c
from attestry.plans.fixtures import plain, sql

DOSSIERS = """
SELECT c_custkey AS request_id, CASE c_custkey % 5 WHEN 0 THEN 'complete_within_scope' WHEN 1 THEN 'partial' WHEN 2 THEN 'needs_clarification' WHEN 3 THEN 'insufficient_evidence' ELSE 'technical_failure' END AS status,
  CASE c_nationkey % 7 WHEN 0 THEN 'ambiguous' WHEN 1 THEN 'insufficient_context' WHEN 2 THEN 'not_found_within_scope' ELSE 'resolved' END AS identity_status, CASE c_nationkey % 3 WHEN 0 THEN 'silence' WHEN 1 THEN 'technical_error' ELSE 'dossier' END AS mode,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'E' END AS error, concat('"', CASE WHEN c_nationkey = 11 THEN 'Progress_value' ELSE 'note' END, '": "progress"') AS body,
  cast(c_acctbal AS double) AS total_duration_ms, CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE c_nationkey END AS latency_ms, c_custkey % 3 AS provider_calls, c_custkey % 50 AS input_tokens, c_nationkey AS output_tokens, c_custkey % 60 AS total_tokens,
  cast(c_nationkey AS double) - 1 AS amount_usd FROM {customer}
"""
CLAIMS = """
SELECT o_custkey AS request_id, cast(o_orderkey AS string) AS claim_id, CASE WHEN o_orderkey % 9 = 0 THEN 'k1' ELSE 'k0' END AS subject_id,
  CASE o_orderkey % 8 WHEN 0 THEN 'rejected' WHEN 1 THEN 'contested' WHEN 2 THEN 'historical' WHEN 3 THEN 'ambiguous' WHEN 4 THEN NULL ELSE 'supported' END AS state,
  CASE o_orderkey % 5 WHEN 0 THEN 'reject' WHEN 1 THEN 'display_ambiguity' ELSE 'display_fact' END AS decision, CASE o_orderkey % 3 WHEN 0 THEN 'current' WHEN 1 THEN 'historical' ELSE 'unknown' END AS temporal_status,
  CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' WHEN 2 THEN 'derived' ELSE 'stated' END AS period_status, o_orderkey % 4 > 0 AS has_marker, o_orderstatus = 'F' AS is_number, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'EUR' END AS unit,
  CASE WHEN o_orderkey % 11 = 0 THEN 'undetermined' ELSE 'company' END AS scope_type, o_totalprice AS value FROM {orders}
"""
EVIDENCE = """
SELECT o_custkey AS request_id, concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string)) AS evidence_id, cast(CASE WHEN l_linenumber = 4 THEN l_orderkey + 1 ELSE l_orderkey END AS string) AS claim_id, cast(l_suppkey AS string) AS source_id,
  CASE WHEN l_orderkey % 9 = 0 THEN 'k1' ELSE 'k0' END AS entity_id, CASE WHEN l_returnflag = 'N' THEN 'supports' ELSE 'context_only' END AS relation, CASE WHEN l_linenumber % 2 = 0 THEN 'search_snippet' ELSE 'source_content' END AS method, 'company' AS scope_type
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""
CITED = "SELECT o_custkey AS request_id, cast(l_orderkey AS string) AS claim_id, concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string)) AS evidence_id FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_linenumber < 6 AND l_orderkey % 12 > 0"
SOURCES = """
SELECT DISTINCT o_custkey AS request_id, cast(l_suppkey AS string) AS source_id, CASE WHEN l_suppkey % 10 = 0 THEN 'ftp://a.example.com' END AS provider_url, CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'https://vertexaisearch.cloud.google.com/x' ELSE 'HTTPS://a.example.com/x' END AS resolved_url,
  CASE WHEN l_suppkey % 5 = 0 THEN 'https://b.example.com' WHEN l_suppkey % 5 = 1 THEN 'b.example.com' END AS canonical_url, CASE WHEN l_suppkey % 8 = 0 THEN 'blocked' ELSE 'accessible' END AS access, 'permitted' AS compliance,
  CASE WHEN l_suppkey % 9 = 0 THEN 'search_result' ELSE 'press' END AS kind, 'k0' AS assumed_id FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
"""
CONFLICTS = "SELECT o_custkey AS request_id, concat('x', cast(o_orderkey AS string)) AS contradiction_id, CASE WHEN o_orderkey % 3 = 0 THEN 'explainable_difference' ELSE 'contradiction' END AS classification, o_orderkey % 4 > 0 AS visible, o_orderkey % 5 > 0 AS nature_checked FROM {orders}"
VERSIONS = """
SELECT o_custkey AS request_id, concat('x', cast(l_orderkey AS string)) AS contradiction_id, cast(l_orderkey + l_linenumber % 3 AS string) AS claim_id, CASE WHEN l_linenumber % 4 > 0 THEN l_quantity END AS normalized_value, concat(cast(l_orderkey AS string), '-', cast(l_linenumber + l_suppkey % 2 AS string)) AS evidence_id
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_linestatus <> 'F' OR l_partkey % 3 = 0
"""
INFERENCES = "SELECT o_custkey AS request_id, concat('i', cast(o_orderkey AS string)) AS inference_id, cast(o_orderkey AS string) AS claim_id FROM {orders} WHERE o_orderpriority = '1-URGENT'"
LISTS = """
SELECT o_custkey AS request_id, CASE o_orderkey % 4 WHEN 0 THEN 'key_fact' WHEN 1 THEN 'recent_signal' WHEN 2 THEN 'ambiguity' ELSE 'summary' END AS list, CASE WHEN o_orderkey % 4 = 3 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'inference' ELSE 'claim' END END AS kind,
  concat(CASE WHEN o_orderkey % 4 = 3 AND o_orderkey % 3 = 0 THEN 'i' ELSE '' END, cast(o_orderkey + CASE WHEN o_orderkey % 14 = 0 THEN 1000000000 ELSE 0 END AS string)) AS id FROM {orders} WHERE o_orderstatus <> 'P' OR o_orderkey % 2 = 0
"""
UNKNOWNS = "SELECT c_custkey AS request_id, CASE WHEN c_custkey % 4 = 0 THEN 'other' ELSE 'no_reliable_source' END AS category, CASE WHEN c_custkey % 6 = 0 THEN 'Rien.' ELSE 'Aucune source suffisamment fiable n’a été trouvée dans le périmètre de cette recherche.' END AS description FROM {customer}"
STEPS = """
SELECT user_id AS request_id, concat('s', cast(event_id AS string)) AS step_id, concat('n', cast(event_id AS string)) AS invocation_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' WHEN 'view' THEN 'completed' ELSE 'skipped' END AS status,
  event_id % 3 AS attempt, CASE WHEN event_id % 4 < 2 THEN concat('n', cast(event_id - event_id % 5 AS string)) END AS retry_of, value - 1 AS duration_ms FROM {events}
"""


IDS = "SELECT c_custkey AS request_id, 'subject' AS kind, CASE c_custkey % 40 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE cast(c_custkey AS string) END AS record_id FROM {customer}"


def v11_dossier_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.dossier_states(sql(spark, sf_dir, DOSSIERS)).unionByName(c.empty_ids(sql(spark, sf_dir, IDS)))


V11_DOSSIER = f"""
WITH d AS ({plain(DOSSIERS)}),
m AS (UNPIVOT (SELECT request_id, coalesce(total_duration_ms, -1)::DOUBLE AS total_duration_ms, coalesce(latency_ms, -1)::DOUBLE AS latency_ms, provider_calls::DOUBLE AS provider_calls, input_tokens::DOUBLE AS input_tokens, output_tokens::DOUBLE AS output_tokens,
  total_tokens::DOUBLE AS total_tokens, coalesce(amount_usd, -1)::DOUBLE AS amount_usd FROM d) ON COLUMNS(* EXCLUDE request_id) INTO NAME id VALUE v)
SELECT request_id, 'clarification_requires_ambiguous_or_insufficient_identity' AS code, NULL::VARCHAR AS id FROM d WHERE status = 'needs_clarification' AND identity_status NOT IN ('ambiguous', 'insufficient_context')
UNION ALL SELECT request_id, 'insufficient_evidence_requires_silence_mode', NULL FROM d WHERE status = 'insufficient_evidence' AND mode <> 'silence'
UNION ALL SELECT request_id, 'insufficient_evidence_has_incompatible_identity_state', NULL FROM d WHERE status = 'insufficient_evidence' AND identity_status NOT IN ('resolved', 'not_found_within_scope')
UNION ALL SELECT request_id, 'technical_failure_requires_error', NULL FROM d WHERE status = 'technical_failure' AND (mode <> 'technical_error' OR error IS NULL)
UNION ALL SELECT request_id, 'technical_error_must_use_technical_failure', NULL FROM d WHERE status <> 'technical_failure' AND error IS NOT NULL
UNION ALL SELECT request_id, 'silence_must_be_nontechnical_insufficient_evidence', NULL FROM d WHERE mode = 'silence' AND (status <> 'insufficient_evidence' OR error IS NOT NULL)
UNION ALL SELECT request_id, 'total_tokens_below_input_plus_output', NULL FROM d WHERE total_tokens < input_tokens + output_tokens
UNION ALL SELECT request_id, 'forbidden_progress_property', NULL FROM d WHERE regexp_matches(body, '(?i)"[^"]*(percent|progress)[^"]*"\\s*:')
UNION ALL SELECT request_id, 'negative_or_missing_measurement', id FROM m WHERE v < 0
UNION ALL SELECT request_id, 'empty_id', kind FROM ({plain(IDS)}) WHERE trim(coalesce(record_id, '')) = ''
"""


def v11_claim_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: sql(spark, sf_dir, t)
    claims, sources = read(CLAIMS), read(SOURCES)
    return c.claim_states(claims, read(CITED), read(EVIDENCE), sources).unionByName(c.source_urls(sources)).unionByName(c.inference_states(read(INFERENCES), claims))


V11_CLAIM = f"""
WITH c AS ({plain(CLAIMS)}), t AS ({plain(CITED)}), e AS ({plain(EVIDENCE)}), s AS ({plain(SOURCES)}), i AS ({plain(INFERENCES)}),
f AS (
  SELECT t.claim_id, coalesce(bool_or(e.relation = 'supports' AND e.method = 'source_content' AND s.access = 'accessible' AND s.kind <> 'search_result' AND e.entity_id = c.subject_id AND s.assumed_id = c.subject_id AND e.scope_type = c.scope_type
    AND (coalesce(s.resolved_url ILIKE 'https://%' AND s.resolved_url NOT LIKE '%//vertexaisearch.cloud.google.com/%', false) OR coalesce(s.canonical_url LIKE 'https://%', false))), false) AS final
  FROM t JOIN c USING (claim_id) JOIN e ON e.evidence_id = t.evidence_id JOIN s ON s.request_id = e.request_id AND s.source_id = e.source_id GROUP BY 1),
d AS (SELECT c.*, f.claim_id IS NOT NULL AS cited, coalesce(f.final, false) AS final, decision = 'display_fact' AS shown FROM c LEFT JOIN f USING (claim_id))
SELECT request_id, 'displayed_claim_has_forbidden_state' AS code, claim_id AS id FROM d WHERE shown AND (state IS NULL OR state IN ('rejected', 'ambiguous'))
UNION ALL SELECT request_id, 'displayed_claim_without_evidence', claim_id FROM d WHERE shown AND NOT cited UNION ALL SELECT request_id, 'displayed_claim_without_final_support', claim_id FROM d WHERE shown AND NOT final
UNION ALL SELECT request_id, 'displayed_claim_without_temporal_qualification', claim_id FROM d WHERE shown AND period_status IS NULL
UNION ALL SELECT request_id, 'current_claim_without_temporal_qualification', claim_id FROM d WHERE shown AND temporal_status = 'current' AND period_status IS NOT NULL AND (period_status = 'unknown' OR NOT has_marker)
UNION ALL SELECT request_id, 'quantitative_claim_without_unit', claim_id FROM d WHERE shown AND is_number AND trim(coalesce(unit, '')) = '' UNION ALL SELECT request_id, 'quantitative_claim_without_scope', claim_id FROM d WHERE shown AND is_number AND scope_type = 'undetermined'
UNION ALL SELECT request_id, 'quantitative_claim_without_period', claim_id FROM d WHERE shown AND is_number AND coalesce(period_status, 'unknown') = 'unknown'
UNION ALL SELECT request_id, 'ambiguous_claim_outside_ambiguity', claim_id FROM d WHERE state = 'ambiguous' AND decision <> 'display_ambiguity' UNION ALL SELECT request_id, 'rejected_claim_presented', claim_id FROM d WHERE state = 'rejected' AND decision <> 'reject'
UNION ALL SELECT request_id, 'historical_claim_not_temporally_historical', claim_id FROM d WHERE state = 'historical' AND temporal_status <> 'historical'
UNION ALL SELECT request_id, 'invalid_http_url', source_id || ':provider_url' FROM s WHERE provider_url LIKE 'ftp%' UNION ALL SELECT request_id, 'invalid_http_url', source_id || ':canonical_url' FROM s WHERE canonical_url = 'b.example.com'
UNION ALL SELECT i.request_id, 'inference_based_on_non_displayable_claim', inference_id || ':' || claim_id FROM i JOIN c USING (claim_id) WHERE state IS NULL OR state IN ('rejected', 'ambiguous')
"""


def v11_conflict_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = sql(spark, sf_dir, VERSIONS)
    return c.conflict_states(sql(spark, sf_dir, CONFLICTS), versions.drop("evidence_id"), versions.drop("normalized_value"), sql(spark, sf_dir, CLAIMS), sql(spark, sf_dir, EVIDENCE))


V11_CONFLICT = f"""
WITH x AS ({plain(CONFLICTS)}), v AS ({plain(VERSIONS)}), c AS ({plain(CLAIMS)}), e AS ({plain(EVIDENCE)}),
g AS (SELECT contradiction_id, count(*) AS n, count(DISTINCT claim_id) AS k, count(DISTINCT normalized_value) + max(CASE WHEN normalized_value IS NULL THEN 1 ELSE 0 END) AS z FROM v GROUP BY 1),
d AS (SELECT x.*, coalesce(n, 0) AS n, coalesce(k, 0) AS k, coalesce(z, 0) AS z FROM x LEFT JOIN g USING (contradiction_id)),
w AS (SELECT v.*, c.claim_id IS NOT NULL AS there, c.state FROM v LEFT JOIN c ON c.request_id = v.request_id AND c.claim_id = v.claim_id),
p AS (SELECT w.*, e.evidence_id IS NOT NULL AS has, e.claim_id AS of FROM w LEFT JOIN e ON e.request_id = w.request_id AND e.evidence_id = w.evidence_id WHERE there)
SELECT request_id, 'conflict_needs_two_versions' AS code, contradiction_id AS id FROM d WHERE n < 2 UNION ALL SELECT request_id, 'conflict_versions_must_reference_distinct_claims', contradiction_id FROM d WHERE k < n
UNION ALL SELECT request_id, 'contradiction_must_be_visible', contradiction_id FROM d WHERE classification = 'contradiction' AND NOT visible
UNION ALL SELECT request_id, 'contradiction_requires_published_estimated_check', contradiction_id FROM d WHERE classification = 'contradiction' AND NOT nature_checked
UNION ALL SELECT request_id, 'contradiction_requires_distinct_values', contradiction_id FROM d WHERE classification = 'contradiction' AND z < 2
UNION ALL SELECT request_id, 'conflict_missing_claim', contradiction_id || ':' || claim_id FROM w WHERE NOT there UNION ALL SELECT request_id, 'conflict_claim_not_contested', contradiction_id || ':' || claim_id FROM w WHERE there AND state IS DISTINCT FROM 'contested'
UNION ALL SELECT request_id, 'conflict_missing_evidence', contradiction_id || ':' || evidence_id FROM p WHERE NOT has UNION ALL SELECT request_id, 'conflict_evidence_claim_mismatch', contradiction_id || ':' || evidence_id FROM p WHERE has AND of <> claim_id
"""


def v11_presentation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: sql(spark, sf_dir, t)
    claims, lists = read(CLAIMS), read(LISTS)
    return c.listed_states(lists, claims, read(INFERENCES)).unionByName(c.silence_states(read(DOSSIERS), claims, lists, read(UNKNOWNS)))


V11_PRESENTATION = f"""
WITH c AS ({plain(CLAIMS)}), l AS ({plain(LISTS)}), i AS ({plain(INFERENCES)}), d AS ({plain(DOSSIERS)}), u AS ({plain(UNKNOWNS)}),
j AS (SELECT l.*, c.claim_id IS NOT NULL AS there, c.state, coalesce(c.state IN ('supported', 'contested', 'historical'), false) AS may, c.decision, i.inference_id IS NOT NULL AS inferred
  FROM l LEFT JOIN c ON c.request_id = l.request_id AND c.claim_id = l.id LEFT JOIN i ON i.request_id = l.request_id AND i.inference_id = l.id),
k AS (SELECT request_id FROM c WHERE decision = 'display_fact' UNION SELECT request_id FROM l WHERE list <> 'ambiguity')
SELECT request_id, 'presentation_missing_claim' AS code, list || ':' || id AS id FROM j WHERE list IN ('key_fact', 'recent_signal') AND NOT there
UNION ALL SELECT request_id, 'presentation_non_displayable_claim', list || ':' || id FROM j WHERE list IN ('key_fact', 'recent_signal') AND there AND NOT (may AND decision = 'display_fact')
UNION ALL SELECT request_id, 'presentation_missing_ambiguity_claim', id FROM j WHERE list = 'ambiguity' AND NOT there UNION ALL SELECT request_id, 'presentation_ambiguity_requires_ambiguous_claim', id FROM j WHERE list = 'ambiguity' AND there AND state IS DISTINCT FROM 'ambiguous'
UNION ALL SELECT request_id, 'summary_missing_or_non_displayable_claim', id FROM j WHERE list = 'summary' AND kind = 'claim' AND NOT may UNION ALL SELECT request_id, 'summary_missing_inference', id FROM j WHERE list = 'summary' AND kind = 'inference' AND NOT inferred
UNION ALL SELECT request_id, 'silence_forbids_displayed_claims', NULL FROM d WHERE mode = 'silence' AND request_id IN (SELECT request_id FROM k)
UNION ALL SELECT request_id, 'silence_requires_bounded_canonical_statement', NULL FROM d WHERE mode = 'silence' AND request_id NOT IN (SELECT request_id FROM u WHERE category = 'no_reliable_source' AND description LIKE 'Aucune%')
"""


def v11_step_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.step_states(sql(spark, sf_dir, DOSSIERS), sql(spark, sf_dir, STEPS))


V11_STEP = f"""
WITH d AS ({plain(DOSSIERS)}), s AS ({plain(STEPS)}), g AS (SELECT request_id, bool_or(status = 'failed') AS failed, bool_or(status NOT IN ('completed', 'skipped')) AS o FROM s GROUP BY 1),
j AS (SELECT d.*, coalesce(failed, false) AS failed, coalesce(o, false) AS o FROM d LEFT JOIN g USING (request_id)), k AS (SELECT s.*, t.invocation_id IS NOT NULL AS known FROM s LEFT JOIN s AS t ON t.request_id = s.request_id AND t.invocation_id = s.retry_of)
SELECT request_id, 'technical_event_must_not_be_insufficient_evidence' AS code, NULL::VARCHAR AS id FROM j WHERE (failed OR error IS NOT NULL) AND status <> 'technical_failure'
UNION ALL SELECT request_id, 'technical_failure_requires_failed_step', NULL FROM j WHERE status = 'technical_failure' AND NOT failed UNION ALL SELECT request_id, 'complete_dossier_has_unfinished_step', NULL FROM j WHERE status = 'complete_within_scope' AND o
UNION ALL SELECT request_id, 'negative_step_duration', step_id FROM s WHERE duration_ms < 0 UNION ALL SELECT request_id, 'retry_missing_prior_invocation', invocation_id FROM k WHERE attempt > 1 AND NOT known
UNION ALL SELECT request_id, 'first_attempt_cannot_be_retry', invocation_id FROM k WHERE attempt <= 1 AND retry_of IS NOT NULL
"""

QUERIES = {q.__name__: q for q in (v11_dossier_states, v11_claim_states, v11_conflict_states, v11_presentation_states, v11_step_states)}
ORACLES = {"v11_dossier_states": V11_DOSSIER, "v11_claim_states": V11_CLAIM, "v11_conflict_states": V11_CONFLICT, "v11_presentation_states": V11_PRESENTATION, "v11_step_states": V11_STEP}
