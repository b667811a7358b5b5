"""Contradictions of supplier years, whose versions are the sentences that three sources state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestry.operators import grounding
from attestry.plans.fixtures import METRIC_FACTS, plain, sql

FACTS = METRIC_FACTS
KEY = "concat('x-', cast(supp AS string), '-', cast(true_year AS string))"
#: Every rule is broken for suppliers of its own residue.
CONTRADICTIONS = f"""
SELECT DISTINCT supp AS request_id, {KEY} AS contradiction_id, supp % 41 <> 0 AS visible, scope_label AS display_name, fact_period_label AS period, CASE WHEN supp % 43 = 0 THEN 'unknown' ELSE 'stated' END AS period_status,
  fact_period_label AS period_text, 'company' AS scope_type, scope_label FROM ({FACTS}) f
"""
VERSIONS = f"SELECT {KEY} AS contradiction_id, fact_id AS claim_id, cast(true_value AS double) * 1000000 + CASE WHEN supp % 7 = 0 THEN 1 ELSE 0 END AS normalized_value, CASE WHEN supp % 47 = 0 THEN 'kg' ELSE unit END AS unit, currency FROM ({FACTS}) f"
CLAIMS = f"""
SELECT fact_id AS claim_id, 'k0' AS subject_key, CASE WHEN supp % 11 = 0 THEN 'profit' ELSE predicate END AS predicate, excerpt AS statement, CASE WHEN supp % 13 = 0 THEN 'another' ELSE fact_period_label END AS period, 'company' AS scope_type,
  CASE WHEN supp % 17 = 0 THEN 'Other' ELSE scope_label END AS scope_label FROM ({FACTS}) f
"""
CITED = f"SELECT {KEY} AS contradiction_id, fact_id AS claim_id, concat('e-', fact_id) AS evidence_id FROM ({FACTS}) f"
LINKS = f"SELECT fact_id AS claim_id, concat('e-', fact_id) AS evidence_id FROM ({FACTS}) f WHERE supp % 37 <> 0"
EVIDENCE = f"""
SELECT concat('e-', fact_id) AS evidence_id, fact_id AS claim_id, 'k0' AS entity_key, concat('s-', fact_id) AS source_id, CASE WHEN supp % 23 = 0 THEN 'another' ELSE fact_period_label END AS period, CASE WHEN supp % 29 = 0 THEN 'group' ELSE 'company' END AS scope_type,
  scope_label, 'supports' AS relation, CASE WHEN supp % 19 = 0 THEN 'search_snippet' ELSE 'source_content' END AS method, excerpt, url, sha2(digest, 256) AS digest FROM ({FACTS}) f
"""
SOURCES = f"SELECT concat('s-', fact_id) AS source_id, 'k0' AS assumed_key, CASE WHEN supp % 31 = 0 THEN 'group' ELSE 'company' END AS scope_type, scope_label, true AS accessible, url FROM ({FACTS}) f"


def v6_grounding_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.grounding_rules(*(sql(spark, sf_dir, q) for q in (CONTRADICTIONS, VERSIONS, CLAIMS, LINKS, CITED, EVIDENCE, SOURCES)))


V6_GROUNDING = f"""
WITH f AS (SELECT *, {KEY} AS x, supp % 17 <> 0 AND variant <> 3 AS seen FROM ({plain(FACTS)}) t WHERE supp % 41 <> 0),
k AS (SELECT *, seen AND supp % 11 <> 0 AND supp % 47 <> 0 AS metric, seen AND supp % 43 <> 0 AS period, supp % 19 <> 0 AND supp % 37 <> 0 AND supp % 31 <> 0 AS good FROM f),
g AS (
  SELECT supp, x, max(variant) AS variant, count(*) FILTER (good) AS pages, count(DISTINCT digest) FILTER (good) AS digests, count(DISTINCT currency) FILTER (metric) AS metrics, count(DISTINCT true_year) FILTER (period) AS periods, count(DISTINCT variant) FILTER (seen) AS natures FROM k GROUP BY 1, 2),
r AS (
  SELECT supp AS request_id, 'period_mismatch' AS code, x || ':' || fact_id AS id FROM k WHERE supp % 13 = 0 UNION ALL SELECT supp, 'scope_mismatch', x || ':' || fact_id FROM k WHERE supp % 17 = 0
  UNION ALL SELECT supp, 'metric_not_grounded', x || ':' || fact_id FROM k WHERE NOT metric UNION ALL SELECT supp, 'period_not_grounded', x || ':' || fact_id FROM k WHERE NOT period
  UNION ALL SELECT supp, 'value_nature_not_grounded', x || ':' || fact_id FROM k WHERE NOT seen UNION ALL SELECT supp, 'value_not_grounded', x || ':' || fact_id FROM k WHERE NOT seen OR supp % 7 = 0
  UNION ALL SELECT supp, 'invalid_evidence', x || ':e-' || fact_id FROM k WHERE supp % 37 = 0 UNION ALL SELECT supp, 'evidence_period_mismatch', x || ':e-' || fact_id FROM k WHERE supp % 23 = 0
  UNION ALL SELECT supp, 'evidence_scope_mismatch', x || ':e-' || fact_id FROM k WHERE supp % 29 = 0 UNION ALL SELECT supp, 'source_scope_mismatch', x || ':s-' || fact_id FROM k WHERE supp % 31 = 0
  UNION ALL SELECT supp, 'version_requires_qualifying_page', x || ':' || fact_id FROM k WHERE NOT good UNION ALL SELECT supp, 'requires_two_source_pages', x FROM g WHERE pages < 2 UNION ALL SELECT supp, 'requires_two_source_documents', x FROM g WHERE digests < 2
  UNION ALL SELECT supp, 'requires_same_grounded_metric', x FROM g WHERE metrics <> 1 UNION ALL SELECT supp, 'requires_same_grounded_period', x FROM g WHERE periods <> 1 UNION ALL SELECT supp, 'requires_same_grounded_value_nature', x FROM g WHERE natures <> 1)
SELECT request_id, 'visible_contradiction_' || code AS code, id FROM r
"""

QUERIES = {"v6_grounding_rules": v6_grounding_rules}
ORACLES = {"v6_grounding_rules": V6_GROUNDING}
