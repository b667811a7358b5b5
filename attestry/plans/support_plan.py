"""Queries of what supports an identity, over people derived from customers and pages derived from whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestry.operators import support as s
from attestry.plans.fixtures import plain, sql

NAMED = "SELECT c_custkey, n_name, concat('Jeanne M', lower(translate(cast(c_custkey AS string), '0123456789', 'ABCDEFGHIJ'))) AS name FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey"
CANDIDATES = f"SELECT c_custkey AS request_id, 'k' AS candidate_key, name AS display_name, 'person' AS entity_type, n_name AS city, 'Utopia' AS country, 'Robotique' AS industry, 'Nordix' AS employer, '123' AS legal_identifier, '2019' AS year, 'www.site.fr' AS official_site FROM ({NAMED}) n"
PROOFS = f"""
SELECT c_custkey AS request_id, 'k' AS candidate_key, 2 * c_custkey + p AS proof_id, CASE WHEN p = 0 AND c_custkey % 2 = 0 THEN 'https://a.site.fr/x' ELSE 'https://other.fr/x' END AS url, cast(p AS string) AS digest, 'x' AS title,
  concat(name, CASE WHEN p = 0 THEN CASE c_custkey % 6 WHEN 0 THEN ' travaille chez Nordix' WHEN 1 THEN ' est directrice générale de Nordix' WHEN 2 THEN ' rencontre Nordix' WHEN 3 THEN concat(' mise à jour le 3 mai 2024 à ', n_name) WHEN 4 THEN ' et Paul Durand works at Nordix' ELSE ' depuis 2019' END
    ELSE concat(CASE c_custkey % 4 WHEN 0 THEN ' est experte en' WHEN 1 THEN ' est spécialiste de' WHEN 2 THEN ' aime la' ELSE ' is an expert in' END, ' robotique', CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE ' numéro ' END, '123') END) AS excerpt
FROM ({NAMED}) n CROSS JOIN (SELECT 0 AS p UNION ALL SELECT 1) t
"""


def i4_verify_discriminators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.verify_discriminators(sql(spark, sf_dir, CANDIDATES), sql(spark, sf_dir, PROOFS))


I4 = """
SELECT c_custkey AS request_id, 'k' AS candidate_key, CASE WHEN c_custkey % 6 = 3 THEN n_name END AS city, NULL::VARCHAR AS country, CASE WHEN c_custkey % 4 <> 2 THEN 'Robotique' END AS industry, CASE WHEN c_custkey % 6 < 2 THEN 'Nordix' END AS employer,
  CASE WHEN c_custkey % 5 > 0 THEN '123' END AS legal_identifier, CASE WHEN c_custkey % 6 = 5 THEN '2019' END AS year, CASE WHEN c_custkey % 2 = 0 THEN 'site.fr' END AS official_site FROM customer JOIN nation ON n_nationkey = c_nationkey
"""

WHO = f"SELECT c_custkey AS request_id, 'k' AS candidate_key, name AS display_name, CASE WHEN c_custkey % 11 = 0 THEN 'company' ELSE 'person' END AS entity_type, CAST(NULL AS string) AS employer, CAST(NULL AS string) AS known, c_custkey % 7 > 0 AS exact_name, c_custkey % 6 <> 1 AS has_context FROM ({NAMED}) n"
READ = f"""
SELECT c_custkey AS request_id, 'k' AS candidate_key, 4 * c_custkey + p AS proof_id, concat('https://', CASE WHEN c_custkey % 3 = 0 THEN 'same' ELSE concat('p', cast(p AS string)) END, '.fr/nordix/', cast(p AS string)) AS url, concat('d', cast(p AS string)) AS digest, 'Nordix news' AS title,
  concat(name, CASE WHEN c_custkey % 5 = 0 AND p = 2 THEN ' rencontre la' ELSE ' est experte en' END, ' robotique numero ', cast(p AS string)) AS excerpt FROM ({NAMED}) n CROSS JOIN (SELECT 1 AS p UNION ALL SELECT 2) t
"""
ASKED = "SELECT c_custkey AS request_id, 'k' AS candidate_key, 0 AS ord, 'Robotique' AS term, 'industry' AS key FROM {customer} UNION ALL SELECT c_custkey, 'k', 1, '1', 'legal_identifier' FROM {customer} WHERE c_custkey % 4 = 0"
BACKING = f"""
SELECT c_custkey AS request_id, 'k' AS candidate_key, 4 * c_custkey + 3 AS proof_id, 'https://p3.fr/nordix/3' AS url, 'd3' AS digest, 'Nordix team' AS title, concat(name, ' est directrice de ', CASE WHEN c_custkey % 8 = 6 THEN 'Autre' ELSE 'Nordix' END) AS excerpt,
  3 AS fact_id, 1 AS ord, 'role' AS category FROM ({NAMED}) n WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'k', 4 * c_custkey + 1, 'https://p1.fr/nordix/1', 'd1', 'x', 'y', 1, 0, 'activity' FROM {{customer}} WHERE c_custkey % 9 > 0
"""


def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.bind_terms(sql(spark, sf_dir, WHO), sql(spark, sf_dir, READ), sql(spark, sf_dir, ASKED))


def i8_corroborate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.corroborate(sql(spark, sf_dir, WHO), _bound(spark, sf_dir), sql(spark, sf_dir, READ))


#: A person of exactly the name, two publishers, and both proofs bind the term.
SURE = "c_custkey % 11 > 0 AND c_custkey % 7 > 0 AND c_custkey % 3 > 0 AND c_custkey % 5 > 0"
I8 = f"SELECT c_custkey AS request_id, 'k' AS candidate_key, 'robotique' AS fingerprint, 'Robotique' AS value FROM customer WHERE {SURE}"


def i9_traceable_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.traceable_role(sql(spark, sf_dir, BACKING), sql(spark, sf_dir, WHO)).select("request_id", "fact_id", "traceable")


I9 = "SELECT c_custkey AS request_id, 3 AS fact_id, c_custkey % 11 > 0 AND c_custkey % 8 <> 6 AS traceable FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 1, false FROM customer WHERE c_custkey % 9 > 0"


def i10_role_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.role_anchor(sql(spark, sf_dir, BACKING), sql(spark, sf_dir, READ), sql(spark, sf_dir, WHO)).select("request_id", "fact_id", "proof_id")


I10 = "SELECT c_custkey AS request_id, 3 AS fact_id, 4 * c_custkey + 3 AS proof_id FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 8 <> 6"


def i11_fact_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.fact_support(sql(spark, sf_dir, WHO), _bound(spark, sf_dir), sql(spark, sf_dir, READ), sql(spark, sf_dir, BACKING))


I11 = f"""
WITH k AS (SELECT c_custkey AS c, {SURE} AND c_custkey % 6 <> 1 AS cor, c_custkey % 4 = 0 AS second, c_custkey % 2 = 0 AND c_custkey % 8 <> 6 AS role, c_custkey % 9 > 0 AS known, c_custkey % 7 > 0 AND c_custkey % 11 > 0 AS sure FROM customer),
m AS (SELECT *, cor AND ((second AND known) OR (role AND NOT second)) AS main FROM k)
SELECT c AS request_id, 'k' AS candidate_key, 'corroborated' AS basis, 4 * c + p AS proof_id FROM m CROSS JOIN (VALUES (1), (2)) v (p) WHERE main UNION ALL SELECT c, 'k', 'corroborated', 4 * c + 3 FROM m WHERE main AND NOT second
UNION ALL SELECT c, 'k', 'single_role', 4 * c + 3 FROM m WHERE NOT main AND role AND sure
"""

PEOPLE = """
SELECT doc_id AS request_id, 'k' AS candidate_key, 'Jeanne Martin' AS display_name, 'https://nordix.fr/equipe' AS url, 'Nordix' AS title, 'Jeanne Martin' AS excerpt,
  concat(coalesce(text, ''), chr(10), 'Jeanne Martin', chr(10), CASE WHEN doc_id % 3 = 0 THEN 'Chante' ELSE 'Directrice de Nordix' END, CASE WHEN doc_id % 2 = 0 THEN concat(chr(10), 'Jeanne Martin travaille chez Nordix depuis longtemps.') ELSE '' END) AS text FROM {documents}
"""


def j11_derive_role_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.derive_role_facts(sql(spark, sf_dir, PEOPLE))


J11 = """
WITH d AS (SELECT doc_id AS i FROM documents)
SELECT i AS request_id, 'k' AS candidate_key, 'role' AS category, CASE WHEN i % 3 > 0 THEN 'Jeanne Martin' || chr(10) || 'Directrice de Nordix' ELSE 'Jeanne Martin travaille chez Nordix depuis longtemps.' END AS excerpt FROM d WHERE i % 3 > 0 OR i % 2 = 0
UNION ALL SELECT i, 'k', 'activity', 'Jeanne Martin travaille chez Nordix depuis longtemps.' FROM d WHERE i % 2 = 0 AND i % 3 > 0
"""

QUERIES = {q.__name__: q for q in (i4_verify_discriminators, i8_corroborate, i9_traceable_role, i10_role_anchor, i11_fact_support, j11_derive_role_facts)}
ORACLES = {"i4_verify_discriminators": I4, "i8_corroborate": I8, "i9_traceable_role": I9, "i10_role_anchor": I10, "i11_fact_support": I11, "j11_derive_role_facts": J11}
