"""Queries of identity resolution: customers are requests, nations and orders make their candidates and proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import facts as f
from attestry.operators import identity as i
from attestry.plans import support_plan as s
from attestry.plans.fixtures import plain, sql
from attestry.sources.tables import settled

#: Candidates: one to three a customer; the third of every fifth repeats the first one's key.
CANDIDATES = """
SELECT c_custkey AS request_id, o AS ord, concat(CASE WHEN c_custkey % 13 = 0 AND o = 1 THEN 'K' ELSE 'k' END, cast(CASE WHEN c_custkey % 5 = 0 AND o = 2 THEN 0 ELSE o END AS string)) AS candidate_key,
  concat(CASE WHEN o = 1 AND c_custkey % 4 = 0 THEN 'Other ' ELSE '' END, name, CASE WHEN o = 0 AND c_custkey % 11 = 0 THEN ' Holding' ELSE '' END) AS display_name,
  CASE WHEN o = 2 THEN 'person' ELSE 'company' END AS entity_type, n_name AS country, name
FROM (SELECT c_custkey, c_nationkey, concat('Firm ', translate(cast(c_custkey AS string), '0123456789', 'ABCDEFGHIJ')) AS name FROM {customer}) c
JOIN {nation} ON n_nationkey = c_nationkey JOIN (SELECT 0 AS o UNION ALL SELECT 1 UNION ALL SELECT 2) s ON o <= c_custkey % 3
"""
PROOFS = f"""
SELECT request_id, candidate_key, CASE WHEN p = 0 THEN 'identity' ELSE 'fact' END AS kind, p AS ord,
  concat('https://', CASE WHEN request_id % 6 = 0 THEN 'www.linkedin.com/in/' ELSE 'news.example.com/' END, cast(request_id AS string), '/', cast(p % 2 AS string)) AS url,
  CASE WHEN request_id % 4 = 1 THEN display_name ELSE 'Home' END AS title,
  concat(CASE WHEN (request_id + p) % 4 IN (1, 2) THEN 'The firm' ELSE display_name END, CASE request_id % 7 WHEN 1 THEN ' is a brand' WHEN 2 THEN ' est une filiale' WHEN 3 THEN ' is the group' ELSE ' is known' END, ' in ', country) AS excerpt,
  concat('d', cast(p % 2 AS string)) AS digest, CASE WHEN request_id % 8 = 1 THEN 'search_snippet' ELSE 'source_content' END AS method
FROM ({CANDIDATES}) c JOIN (SELECT 0 AS p UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) s ON p <= request_id % 5 WHERE NOT (request_id % 5 = 0 AND ord = 2)
"""
REQUESTS = """
SELECT c_custkey AS request_id, concat('Firm ', translate(cast(c_custkey AS string), '0123456789', 'ABCDEFGHIJ')) AS name, CASE c_custkey % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'auto' END AS entity_type,
  CASE WHEN c_custkey % 2 = 0 THEN concat(n_name, ', ', lower(c_mktsegment), CASE WHEN c_custkey % 10 = 4 THEN ', see www.news.example.com/about' ELSE '' END) END AS context,
  CASE WHEN c_custkey % 9 = 2 THEN 'known' END AS role, c_custkey % 2 = 0 AS has_context
FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey
"""
VERIFIED = f"""
SELECT DISTINCT c.request_id, candidate_key, CASE WHEN candidate_key <> 'k1' THEN country END AS country, c_mktsegment AS industry, cast(NULL AS string) AS city, cast(NULL AS string) AS year,
  CASE WHEN c.request_id % 14 = 6 THEN 'Alpha Works' END AS employer, CASE WHEN c.request_id % 17 = 3 AND candidate_key = 'k0' THEN concat('id', cast(c.request_id AS string)) END AS legal_identifier,
  CASE WHEN c.request_id % 12 = 5 AND candidate_key = 'k0' THEN concat('www.firm', lower(translate(cast(c.request_id AS string), '0123456789', 'ABCDEFGHIJ')), '.com') END AS official_site
FROM ({CANDIDATES}) c JOIN {{customer}} ON c_custkey = c.request_id
"""
#: What SQL needs of both: a proof names its candidate in its excerpt, or, where the page was not read, in its title.
NAMES = "((request_id + p) % 4 NOT IN (1, 2) OR (request_id % 8 = 1 AND request_id % 4 = 1))"
SCOPE = "CASE WHEN entity_type = 'person' THEN 'person' WHEN request_id % 4 IN (0, 3) AND request_id % 7 = 1 THEN 'brand' WHEN request_id % 4 IN (0, 3) AND request_id % 7 = 2 THEN 'subsidiary' WHEN (request_id % 4 IN (0, 3) AND request_id % 7 = 3) OR (ord = 0 AND request_id % 11 = 0) THEN 'group' ELSE 'company' END"


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.derive_scope(sql(spark, sf_dir, CANDIDATES), sql(spark, sf_dir, PROOFS))


def i2_derive_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scoped(spark, sf_dir).select("request_id", "candidate_key", F.col("ord").cast("long").alias("ord"), "entity_scope")


I2 = f"SELECT request_id, candidate_key, ord::BIGINT AS ord, {SCOPE} AS entity_scope FROM ({plain(CANDIDATES)}) c"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.assemble_evidence(sql(spark, sf_dir, CANDIDATES), sql(spark, sf_dir, PROOFS))


def i3_assemble_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("request_id", "candidate_key", "kind", F.col("ord").cast("long").alias("ord"), "names", "basis", "primary")


EVIDENCE = f"""
WITH c AS ({plain(CANDIDATES)}), q AS (
  SELECT request_id, candidate_key, p, {NAMES} AS names,
    concat(p % 2, CASE WHEN (request_id + p) % 4 IN (1, 2) THEN 'f' ELSE 'n' END) AS same
  FROM (SELECT *, row_number() OVER (PARTITION BY request_id, candidate_key ORDER BY ord) AS nth FROM c) JOIN (SELECT unnest([0, 1, 2, 3]) AS p) s ON p <= request_id % 5 WHERE nth = 1),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, candidate_key, same ORDER BY p) AS n FROM q WHERE p = 0 OR names) WHERE n = 1),
e AS (
  SELECT request_id, candidate_key, CASE WHEN p = 0 THEN 'identity' ELSE 'fact' END AS kind, p AS ord, names,
    CASE WHEN bool_or(p = 0 AND names) OVER w THEN 'dedicated' ELSE 'verified_facts' END AS basis,
    row_number() OVER (PARTITION BY request_id, candidate_key ORDER BY CASE WHEN p = 0 AND names THEN 0 WHEN p > 0 THEN 1 ELSE 2 END, p) = 1 AS "primary"
  FROM d WINDOW w AS (PARTITION BY request_id, candidate_key))"""
I3 = EVIDENCE + ' SELECT request_id, candidate_key, kind, ord::BIGINT AS ord, names, basis, "primary" FROM e'


def _signals(spark: SparkSession, sf_dir: str, evidence: DataFrame) -> DataFrame:
    return i.context_signals(sql(spark, sf_dir, REQUESTS), sql(spark, sf_dir, VERIFIED), evidence)


def i5_context_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir, settled(_evidence(spark, sf_dir), "evidence"))


SIGNALS = EVIDENCE + f""",
r AS ({plain(REQUESTS)}), v AS ({plain(VERIFIED).replace('{customer}', 'customer')}),
s AS (
  SELECT request_id, candidate_key, 'country' AS kind, country AS value, 'medium' AS strength FROM v WHERE country IS NOT NULL AND request_id % 2 = 0
  UNION ALL SELECT request_id, candidate_key, 'industry', industry, 'medium' FROM v WHERE request_id % 2 = 0
  UNION ALL SELECT DISTINCT request_id, candidate_key, 'source_domain', 'news.example.com', 'strong' FROM e WHERE request_id % 10 = 4 AND request_id % 6 <> 0
  UNION ALL SELECT DISTINCT request_id, candidate_key, 'role', 'known', 'medium' FROM e WHERE request_id % 9 = 2 AND request_id % 7 NOT IN (1, 2, 3))"""
I5 = SIGNALS + " SELECT request_id, candidate_key, kind, value, strength FROM s"


def _eligible(spark: SparkSession, sf_dir: str, evidence: DataFrame) -> DataFrame:
    requests, candidates = sql(spark, sf_dir, REQUESTS), _scoped(spark, sf_dir)
    names = candidates.select(F.concat_ws("/", "request_id", "candidate_key").alias("candidate_key"), "display_name").distinct()
    pairs = f.match_names(requests, names).where(F.col("candidate_key").startswith(F.concat(F.col("request_id").cast("string"), F.lit("/"))))
    return i.eligible(requests, candidates, evidence, pairs.select("request_id", F.substring_index("candidate_key", "/", -1).alias("candidate_key")))


def i12_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eligible(spark, sf_dir, _evidence(spark, sf_dir)).select("request_id", "candidate_key", F.col("ord").cast("long").alias("ord"), "eligible", F.array_join("reasons", ",").alias("reasons"))


ELIGIBLE = SIGNALS + """,
named AS (SELECT request_id, candidate_key, bool_or(names) AS named FROM e GROUP BY 1, 2),
el AS (
  SELECT c.request_id, c.ord, c.candidate_key, c.entity_type, c.display_name, concat_ws(',', CASE WHEN c.candidate_key LIKE 'K%' THEN 'candidate_key_invalid' END,
    CASE WHEN c.request_id % 3 = 0 AND c.entity_type <> 'company' THEN 'candidate_type_mismatch' END, CASE WHEN NOT coalesce(named, false) THEN 'candidate_proof_name_missing' END) AS reasons
  FROM c LEFT JOIN named USING (request_id, candidate_key))"""
I12 = ELIGIBLE + " SELECT request_id, candidate_key, ord::BIGINT AS ord, reasons = '' AS eligible, reasons FROM el"


def _flagged(spark: SparkSession, sf_dir: str, evidence: DataFrame) -> DataFrame:
    return i.match_flag(sql(spark, sf_dir, REQUESTS), _eligible(spark, sf_dir, evidence), sql(spark, sf_dir, VERIFIED), _signals(spark, sf_dir, evidence))


def i13_match_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir, settled(_evidence(spark, sf_dir), "evidence")).select("request_id", "candidate_key", F.col("ord").cast("long").alias("ord"), "matched", "strong", "medium", "priority")


FLAGGED = ELIGIBLE + f""",
g AS (
  SELECT request_id, candidate_key, bool_or(strength = 'strong') AS strong, count(DISTINCT CASE WHEN strength = 'medium' THEN kind END) AS medium,
    sum(CASE kind WHEN 'source_domain' THEN 5 WHEN 'role' THEN 2 ELSE 1 END) AS priority
  FROM s GROUP BY 1, 2),
fl AS (
  SELECT el.request_id, el.candidate_key, el.ord, el.reasons, coalesce(strong, false) AS strong, coalesce(medium, 0)::BIGINT AS medium, coalesce(priority, 0)::BIGINT AS priority,
    CASE WHEN el.request_id % 2 = 0 THEN coalesce(strong, false) OR coalesce(medium, 0) >= 2
      WHEN el.entity_type = 'person' THEN el.display_name = 'Firm ' || translate(cast(el.request_id AS varchar), '0123456789', 'ABCDEFGHIJ')
      ELSE sc.entity_scope <> 'brand' AND (v.legal_identifier IS NOT NULL OR (v.official_site IS NOT NULL AND el.display_name NOT LIKE '%Holding')) END AS matched
  FROM el LEFT JOIN g USING (request_id, candidate_key) LEFT JOIN v USING (request_id, candidate_key)
  JOIN (SELECT request_id, ord, {SCOPE} AS entity_scope FROM c) sc ON sc.request_id = el.request_id AND sc.ord = el.ord)"""
I13 = FLAGGED + " SELECT request_id, candidate_key, ord::BIGINT AS ord, matched, strong, medium, priority FROM fl"


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = settled(_evidence(spark, sf_dir), "evidence")
    first = evidence.where('primary').select("request_id", "candidate_key", "method", "url")
    return i.decide(sql(spark, sf_dir, REQUESTS), _flagged(spark, sf_dir, evidence).join(first, ["request_id", "candidate_key"], "left"))


def i15_decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir)


I15 = FLAGGED + """,
ww AS (SELECT *, reasons = '' AS ok, row_number() OVER o AS r, lead(CASE WHEN reasons = '' THEN priority END) OVER o AS nx FROM fl WINDOW o AS (PARTITION BY request_id ORDER BY CASE WHEN reasons = '' THEN priority END DESC NULLS LAST, ord)),
k AS (
  SELECT request_id, count(*) > count(DISTINCT candidate_key) AS twice, count(*) FILTER (ok) AS n, count(*) FILTER (ok AND matched) AS m,
    max(CASE WHEN ok AND r = 1 AND priority - nx >= 2 AND (strong OR medium >= 2) THEN candidate_key END) AS winner, max(CASE WHEN ok AND matched THEN candidate_key END) AS only_,
    max(CASE WHEN ok THEN candidate_key END) AS single
  FROM ww GROUP BY 1),
dd AS (
  SELECT request_id, request_id % 2 = 0 AS has, CASE WHEN twice THEN 1 WHEN n = 0 THEN 2 WHEN winner IS NOT NULL THEN 3 WHEN m = 1 AND (request_id % 2 = 0 OR n = 1) THEN 4
    WHEN m = 0 AND n = 1 AND (request_id % 2 = 0 OR request_id % 6 = 0) THEN 5 WHEN m > 1 OR (request_id % 2 = 1 AND n > 1) THEN 6 ELSE 7 END AS step, winner, only_, single FROM k)
SELECT request_id, CASE WHEN step IN (1, 7) THEN 'insufficient_context' WHEN step = 2 THEN 'not_found_within_scope' WHEN step = 6 THEN 'ambiguous' ELSE 'resolved' END AS status,
  CASE step WHEN 3 THEN winner WHEN 4 THEN only_ WHEN 5 THEN single END AS selected_key,
  ['duplicate_candidate_key', 'no_verified_candidate', 'unique_ranked_candidate', 'unique_verified_candidate', 'unique_contextual_source_candidate', 'multiple_verified_candidates', 'context_not_demonstrated'][step] AS reason,
  CASE WHEN step IN (2, 3, 4, 5) THEN '' WHEN has THEN 'official_site,discriminating_hint' ELSE 'city,industry,employer,discriminating_hint' END AS clarification
FROM dd
"""

def i15_fact_backed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People known from facts alone: those that facts back resolve, through the support of their facts."""
    who, read = sql(spark, sf_dir, s.WHO), sql(spark, sf_dir, s.READ)
    support = s.s.fact_support(who, s.s.bind_terms(who, read, sql(spark, sf_dir, s.ASKED)), read, sql(spark, sf_dir, s.BACKING))
    requests = who.select("request_id", F.col("display_name").alias("name"), "has_context")
    c = who.select("request_id", "candidate_key", F.lit(0).alias("ord"), "display_name", "entity_type", F.col("entity_type").alias("entity_scope"), F.lit(True).alias("eligible"))
    evidence = read.select("request_id", "candidate_key", F.lit("verified_facts").alias("basis"))
    verified = who.select("request_id", "candidate_key", F.lit(None).cast("string").alias("legal_identifier"), F.lit(None).cast("string").alias("official_site"))
    signals = who.where("false").select("request_id", "candidate_key", F.lit("city").alias("kind"), F.lit("medium").alias("strength"))
    flagged = i.match_flag(requests, c, verified, signals, evidence, support)
    urls = flagged.withColumns({"method": F.lit("source_content"), "url": F.lit("https://p1.fr/")})
    return i.decide(requests, urls).join(flagged.select("request_id", "match_basis"), "request_id").select("request_id", "status", "reason", "match_basis")


I15_FACTS = f"""
WITH b AS (SELECT DISTINCT request_id FROM ({s.I11}) x)
SELECT c_custkey AS request_id, CASE WHEN b.request_id IS NULL AND c_custkey % 6 = 1 THEN 'insufficient_context' ELSE 'resolved' END AS status,
  CASE WHEN b.request_id IS NOT NULL THEN 'unique_verified_candidate' WHEN c_custkey % 6 = 1 THEN 'context_not_demonstrated' ELSE 'unique_contextual_source_candidate' END AS reason, 'facts' AS match_basis
FROM customer LEFT JOIN b ON b.request_id = c_custkey
"""

QUERIES = {q.__name__: q for q in (i2_derive_scope, i3_assemble_evidence, i5_context_signals, i12_eligible, i13_match_flag, i15_decide, i15_fact_backed)}
ORACLES = {"i2_derive_scope": I2, "i3_assemble_evidence": I3, "i5_context_signals": I5, "i12_eligible": I12, "i13_match_flag": I13, "i15_decide": I15, "i15_fact_backed": I15_FACTS}
