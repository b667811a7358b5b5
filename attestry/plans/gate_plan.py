"""The reader's gate over dossiers derived from customers, orders, order lines and suppliers: three dossiers a customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestry.operators import gate
from attestry.plans.fixtures import plain, sql

DOSSIERS = """
SELECT c_custkey * 3 + r AS request_id, CASE WHEN c_custkey % 31 = 0 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN c_custkey % 37 = 0 THEN 'silence' ELSE 'standard' END AS result_mode,
  CASE WHEN r = 0 THEN 'complete_within_scope' ELSE 'partial' END AS global_status, CASE WHEN c_custkey % 41 = 0 THEN 'kx' ELSE 'k0' END AS selected_key
FROM {customer} CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 1 UNION ALL SELECT 2) t
"""
CANDIDATES = f"SELECT request_id, 'k0' AS subject_key FROM ({DOSSIERS}) d UNION ALL SELECT request_id, 'k1' FROM ({DOSSIERS}) d WHERE request_id % 43 = 0"
CLAIMS = """
SELECT o_custkey * 3 + o_orderkey % 3 AS request_id, concat('c', cast(o_orderkey AS string)) AS claim_id, o_orderkey AS ord, 'k0' AS subject_key, CASE o_orderkey % 5 WHEN 0 THEN 'identity.name' WHEN 1 THEN 'metric.revenue' WHEN 2 THEN 'role.ceo' ELSE 'activity.x' END AS predicate,
  concat('Statement  ', cast(o_orderkey AS string)) AS statement, CASE WHEN o_orderkey % 47 = 0 THEN 'contested' ELSE 'supported' END AS state, CASE WHEN o_orderkey % 53 = 0 THEN 'indetermination' ELSE 'confirmation' END AS reconciliation,
  CASE WHEN o_orderkey % 29 = 0 THEN 'reject' WHEN o_orderkey % 23 = 0 THEN 'display_ambiguity' ELSE 'display_fact' END AS decision, o_orderkey % 19 <> 0 AS dated, 'company' AS scope_type, CASE WHEN o_orderkey % 17 <> 0 THEN 'L' END AS scope_label
FROM {orders}
"""
EVIDENCE = """
SELECT concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string)) AS evidence_id, concat('c', cast(l_orderkey AS string)) AS claim_id, CASE WHEN l_partkey % 97 = 0 THEN 'k9' ELSE 'k0' END AS entity_key, l_suppkey AS source_id,
  CASE WHEN l_linenumber % 4 = 3 OR l_orderkey % 59 = 0 THEN 'context_only' ELSE 'supports' END AS relation, CASE WHEN l_partkey % 101 = 0 THEN 'hearsay' ELSE 'source_content' END AS method,
  CASE WHEN l_partkey % 103 = 0 THEN ' ' WHEN l_linenumber % 3 = 2 OR l_orderkey % 61 = 0 THEN 'Other words' ELSE concat(' Statement ', cast(l_orderkey AS string)) END AS excerpt
FROM {lineitem}
"""
LINKS = "SELECT concat('c', cast(l_orderkey AS string)) AS claim_id, l_linenumber AS pos, concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string), CASE WHEN l_partkey % 107 = 0 THEN 'x' ELSE '' END) AS evidence_id FROM {lineitem} WHERE l_orderkey % 67 <> 0"
SOURCES = "SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 71 = 0 THEN 'k9' ELSE 'k0' END AS assumed_key, CASE WHEN s_suppkey % 73 = 0 THEN ' ' ELSE 'T' END AS title, concat(CASE WHEN s_suppkey % 13 = 0 THEN 'http' ELSE 'https' END, '://www.p', cast(s_suppkey % 3 AS string), '.com/', cast(s_suppkey % 7 AS string)) AS url FROM {supplier}"
SUMMARY = f"SELECT request_id, ord AS pos, CASE WHEN ord % 79 = 0 THEN 'inference' ELSE 'claim' END AS kind, concat(claim_id, CASE WHEN ord % 83 = 0 THEN 'x' ELSE '' END) AS ref_id FROM ({CLAIMS}) c WHERE ord % 5 <> 0 AND decision = 'display_fact' AND (state = 'supported' OR ord % 2 = 0)"
LISTED = f"SELECT request_id, ord AS pos, claim_id FROM ({CLAIMS}) c WHERE decision = 'display_fact' AND (reconciliation = 'confirmation' OR ord % 2 = 1)"
CONTRADICTIONS = "SELECT c_custkey * 3 + c_custkey % 3 AS request_id, concat('x', cast(c_custkey AS string)) AS id, c_custkey % 4 = 0 AS visible, c_custkey % 8 = 0 AS broken FROM {customer}"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = [sql(spark, sf_dir, q) for q in (DOSSIERS, CANDIDATES, CLAIMS, LINKS, EVIDENCE, SOURCES, SUMMARY, LISTED, CONTRADICTIONS)]
    return gate.issues(*t[:8], t[8].where("visible AND broken").select("request_id", "id"), t[8])


def v10_display_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("request_id", "code", "id")


def v10_reader_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.display_issue(_found(spark, sf_dir))


FOUND = f"""
WITH d AS ({plain(DOSSIERS)}), cand AS ({plain(CANDIDATES)}), cl AS ({plain(CLAIMS)}), ln AS ({plain(LINKS)}), ev AS ({plain(EVIDENCE)}), so AS ({plain(SOURCES)}), su AS ({plain(SUMMARY)}), li AS ({plain(LISTED)}), co AS ({plain(CONTRADICTIONS)}),
c AS (SELECT *, decision = 'display_fact' AS fact, decision = 'display_fact' AND predicate NOT LIKE 'identity.%' AS biz, state = 'contested' OR reconciliation = 'indetermination' AS open FROM cl),
k AS (SELECT d.*, (SELECT count(*) FROM c WHERE c.request_id = d.request_id AND fact) AS facts, (SELECT count(*) FROM c WHERE c.request_id = d.request_id AND biz) AS biz,
  (SELECT count(DISTINCT split_part(predicate, '.', 1)) FROM c WHERE c.request_id = d.request_id AND biz) AS cats, (SELECT count(*) FROM cand WHERE cand.request_id = d.request_id) AS n, global_status LIKE 'complete%' AS whole FROM d),
l AS (
  SELECT c.*, ln.pos, ln.evidence_id, e.evidence_id IS NOT NULL AND e.claim_id = c.claim_id AND e.entity_key = c.subject_key AND e.method <> 'hearsay' AS fine, e.relation = 'supports' AS sup, e.entity_key,
    trim(e.excerpt) AS shown, trim(e.excerpt) = replace(c.statement, '  ', ' ') AS same, s.source_id, s.assumed_key, s.title, CASE WHEN s.url LIKE 'https:%' THEN s.url END AS page
  FROM c JOIN ln USING (claim_id) LEFT JOIN ev e ON e.evidence_id = ln.evidence_id LEFT JOIN so s ON s.source_id = e.source_id WHERE decision <> 'reject'),
f AS (SELECT c.request_id, c.claim_id, c.ord, c.predicate, c.dated, c.scope_label, count(l.evidence_id) AS n, bool_or(coalesce(sup, false)) AS sup, bool_or(coalesce(sup AND same, false)) AS exact FROM c LEFT JOIN l USING (claim_id) WHERE c.fact GROUP BY ALL),
b AS (SELECT request_id, count(DISTINCT coalesce(page, '')) AS pages, count(DISTINCT coalesce(regexp_extract(page, 'p[0-9][.]com'), '')) AS pubs FROM l WHERE biz AND source_id IS NOT NULL GROUP BY 1),
i AS (
  SELECT request_id, 0 AS place, 0 AS ord, 0 AS step, 0 AS sub, 'facts_without_identity' AS code, NULL AS id FROM k WHERE status <> 'resolved' AND facts > 0
  UNION ALL SELECT request_id, 1, 0, 1, 0, 'facts_in_other_mode', NULL FROM k WHERE result_mode <> 'standard' AND facts > 0 UNION ALL SELECT request_id, 2, 0, 2, 0, 'complete_without_fact', NULL FROM k WHERE whole AND facts = 0
  UNION ALL SELECT request_id, 3, 0, 3, 0, 'resolved_without_one_candidate', NULL FROM k WHERE status = 'resolved' AND (n <> 1 OR selected_key <> 'k0') UNION ALL SELECT request_id, 4, 0, 4, 0, 'complete_fact_count', NULL FROM k WHERE whole AND biz NOT BETWEEN 3 AND 6
  UNION ALL SELECT request_id, 5, 0, 5, 0, 'complete_category_count', NULL FROM k WHERE whole AND cats < 2 UNION ALL SELECT request_id, 6, 0, 6, 0, 'summary_too_long', NULL FROM su GROUP BY request_id HAVING count(*) > 3
  UNION ALL SELECT su.request_id, 7, pos, 7, 0, 'summary_not_a_business_fact', ref_id FROM su LEFT JOIN c ON c.claim_id = ref_id WHERE kind <> 'claim' OR NOT coalesce(biz, false)
  UNION ALL SELECT su.request_id, 7, pos, 8, 0, 'summary_unreconciled', ref_id FROM su JOIN c ON c.claim_id = ref_id WHERE kind = 'claim' AND biz AND open
  UNION ALL SELECT li.request_id, 9, pos, 9, 0, 'key_fact_unreconciled', li.claim_id FROM li JOIN c USING (claim_id) WHERE NOT (fact AND NOT open)
  UNION ALL SELECT request_id, 10, ord, 10, 0, 'fact_without_evidence', claim_id FROM f WHERE n = 0 UNION ALL SELECT request_id, 10, ord, 11, pos, 'evidence_incoherent', evidence_id FROM l WHERE NOT coalesce(fine, false)
  UNION ALL SELECT request_id, 10, ord, 12, 0, 'fact_without_support', claim_id FROM f WHERE n > 0 AND NOT sup UNION ALL SELECT request_id, 10, ord, 13, 0, 'fact_without_exact_citation', claim_id FROM f WHERE sup AND NOT exact
  UNION ALL SELECT request_id, 10, ord, 14, 0, 'metric_without_period_and_scope', claim_id FROM f WHERE predicate LIKE 'metric.%' AND (NOT dated OR scope_label IS NULL)
  UNION ALL SELECT request_id, 15, 0, 15, 0, 'conflict_not_controlled', id FROM co WHERE visible AND broken
  UNION ALL SELECT request_id, 16, ord, 16, pos, 'evidence_empty', evidence_id FROM l WHERE coalesce(shown, '') = ''
  UNION ALL SELECT request_id, 16, ord, 17, pos, 'evidence_without_page', evidence_id FROM l WHERE shown <> '' AND NOT (source_id IS NOT NULL AND assumed_key = entity_key AND trim(title) <> '' AND page IS NOT NULL)
  UNION ALL SELECT request_id, 18, 0, 18, 0, 'complete_without_two_pages', NULL FROM k LEFT JOIN b USING (request_id) WHERE whole AND coalesce(pages, 0) < 2 UNION ALL SELECT request_id, 19, 0, 19, 0, 'complete_without_two_publishers', NULL FROM k LEFT JOIN b USING (request_id) WHERE whole AND coalesce(pubs, 0) < 2
  UNION ALL SELECT request_id, 20, 0, 20, 0, 'complete_hides_contradiction', NULL FROM k WHERE whole AND request_id IN (SELECT request_id FROM co WHERE visible))"""
V10_ISSUES = FOUND + " SELECT request_id, code, id FROM i"
V10_GATE = FOUND + " SELECT request_id, code, id FROM i QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY place, ord, step, sub, coalesce(id, '')) = 1"

QUERIES = {q.__name__: q for q in (v10_display_issues, v10_reader_gate)}
ORACLES = {"v10_display_issues": V10_ISSUES, "v10_reader_gate": V10_GATE}
